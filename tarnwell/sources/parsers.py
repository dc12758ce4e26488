"""Items and calls of source texts by exchangeable parsers.

A parser is a function of a text that yields facts (kind, name, line, within, target): an item it
defines, or a call of ``target`` inside the item ``within``. Parsers are registered by name;
executors run them over Arrow batches, a text at a time.

- ``lines``: items at the start of a line, no calls; for quick looks.
- ``braces``: a tokenizer that skips comments and literals and follows braces; items with their
  nesting, calls by name. It knows nothing of types, so a call names every item of that name.
- ``tree``: as ``braces``, with the module and impl path of each item and calls written with a path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

Fact = tuple[str, str, int, str | None, str | None]
Parser = Callable[[str], Iterable[Fact]]
PARSERS: dict[str, Parser] = {}

# Keywords that begin an item, and words before a bracket that are no call.
ITEM_WORDS = ("fn", "struct", "enum", "trait", "impl", "const", "static", "type", "mod", "use")
NO_CALL = frozenset("if while for match return loop fn let in as move where unsafe else impl struct enum trait use mod pub".split())

_LINE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn))*(fn|struct|enum|trait|const|static|type|mod)\s+([A-Za-z_]\w*)", re.M)
_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*|b?r(?P<hashes>\#*)"|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)')|(?P<path>[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)*)|(?P<sign>[{}();])|(?P<line>\n)""",
    re.S | re.X,
)


def parser(name: str) -> Callable[[Parser], Parser]:
    """Register a parser under ``name``."""

    def add(function: Parser) -> Parser:
        PARSERS[name] = function
        return function

    return add


@parser("lines")
def by_lines(text: str) -> Iterator[Fact]:
    line, at = 0, 0
    for m in _LINE.finditer(text):
        line += text.count("\n", at, m.start(1))
        at = m.start(1)
        yield m[1], m[2], line, None, None


def _comment_end(text: str, at: int) -> int:
    """Behind the block comment that opens before ``at``; comments nest. Open ones end with the text."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """(token, line): paths and signs; comments and literals are skipped."""
    at, line, last = 0, 0, 0
    while m := _TOKEN.search(text, at):
        line += text.count("\n", last, m.start())
        last, at = m.start(), m.end()
        if m["skip"]:
            if m[0] == "/*":
                at = _comment_end(text, at)
            elif m["hashes"] is not None:
                end = text.find('"' + m["hashes"], at)
                at = len(text) if end < 0 else end + 1 + len(m["hashes"])
        elif m["line"] is None:
            yield (re.sub(r"\s+", "", m[0]) if m["path"] else m[0]), line


def _nested(text: str, whole: bool) -> Iterator[Fact]:
    scopes: list[tuple[str, str] | None] = []  # (kind, name) of the item each open brace belongs to
    waiting: tuple[str, str] | None = None  # an item whose brace has not opened
    word, expected, header = "", "", False

    def path(name: str) -> str:
        return "::".join([s[1] for s in scopes if s and s[0] in ("mod", "impl", "trait")] + [name]) if whole else name

    def inside() -> str | None:
        for k in range(len(scopes) - 1, -1, -1):
            if scopes[k] and scopes[k][0] == "fn":
                return "::".join([s[1] for s in scopes[:k] if s and s[0] in ("mod", "impl", "trait")] + [scopes[k][1]]) if whole else scopes[k][1]
        return None

    for token, line in tokens(text):
        if token == "{":
            scopes.append(waiting)
            waiting, header = None, False
        elif token == "}":
            if scopes:
                scopes.pop()
        elif token == ";":
            waiting, expected, header = None, "", False
        elif token == "(":
            if word and word.split("::")[-1] not in NO_CALL and not header and (owner := inside()):
                yield "call", word, line, owner, word if whole else word.split("::")[-1]
        elif token == ")":
            pass
        elif header and waiting and waiting[0] == "impl":
            if token == "for":  # the type behind it names the block
                waiting = ("impl", "")
            elif not waiting[1]:
                waiting = ("impl", token)
        elif expected:
            if expected != "const" or token not in ("fn", "unsafe"):
                yield expected, path(token), line, inside(), None
                waiting, header = (expected, token), True
                expected = ""
            else:
                expected = "fn" if token == "fn" else expected
        elif token == "impl" and not header:
            waiting, header = ("impl", ""), True
        elif token in ITEM_WORDS and token not in ("use", "impl") and not header:
            expected = token
        word = token if token not in "{}();" else ""


@parser("braces")
def by_braces(text: str) -> Iterator[Fact]:
    return _nested(text, whole=False)


@parser("tree")
def by_tree(text: str) -> Iterator[Fact]:
    return _nested(text, whole=True)


_FACTS = pa.schema([("key", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("within", pa.string()), ("target", pa.string())])


ROWS = 20_000  # facts in a batch, from which the next one begins


def batched(found: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``found`` rows as batches of ROWS, so that small texts don't get a batch each."""
    rows = iter(found)
    while block := list(islice(rows, ROWS)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


def _run(parse: Parser):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for fact in parse(text or ""):
                    yield (key, *fact)

    return lambda batches: batched(facts(batches), _FACTS)


def parse_sources(texts: DataFrame, key: str, backend: str | Parser = "tree", text_col: str = "text") -> DataFrame:
    """(key, kind, name, line, within, target): the facts of each text (key, text); null texts have none.

    backend: a registered name, or a function of one's own that executors can unpickle.
    """
    parse = PARSERS[backend] if isinstance(backend, str) else backend
    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_run(parse), "key string, kind string, name string, line long, within string, target string")
    return out.withColumnRenamed("key", key) if key != "key" else out


def crate_sources(manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """(crate, path, text) of ``sources`` (path, text): the crate is that of the nearest folder above with a manifest.

    manifests: (path, text) with a [package] name, dashes as underscores; those without a name are
    workspaces and own nothing. Sources below no crate are left out. Crates are found for folders, of
    which there are few: a folder of sources has a row for each folder above it, a source only one.
    """
    name = F.regexp_extract("text", r"(?m)^\s*name\s*=\s*\"([^\"]+)\"", 1)
    folder = lambda path: F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    crates = manifests.select(folder(F.col("path")).alias("folder"), F.translate(name, "-", "_").alias("crate")).filter("crate <> ''").dropDuplicates(["folder"])
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    folders = sources.select(folder(F.col("path")).alias("folder")).distinct()
    owner = folders.select(F.col("folder").alias("own"), F.explode(above).alias("folder")).join(crates, "folder").groupBy("own").agg(F.max_by("crate", F.length("folder")).alias("crate"))
    return sources.withColumn("own", folder(F.col("path"))).join(owner, "own").select("crate", "path", "text")


def read_workspace(spark: SparkSession, path: str, manifest: str = "Cargo.toml", pattern: str = "*.rs") -> DataFrame:
    """(crate, path, text) of the source files below ``path``, see crate_sources; parse_sources takes them."""

    def read(glob: str) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
        return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    return crate_sources(read(manifest), read(pattern))


def call_graph(facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Items (id, key, kind, name, line) and calls (src, dst) between functions, resolved by name inside ``key``.

    A call reaches every function of that name, or whose path ends in it; ids are hashes of
    (key, name, line). A name that is defined often gives one edge for each definition. The facts
    are checkpointed, so that texts are parsed once.
    """
    facts = cut(facts)
    items = facts.filter("kind <> 'call'").select(F.xxhash64(key, "name", "line").alias("id"), key, "kind", "name", "line")
    functions = items.filter("kind = 'fn'")
    last = F.element_at(F.split("name", "::"), -1)
    callers = functions.select(F.col("id").alias("src"), key, F.col("name").alias("within"))
    called = functions.select(F.col("id").alias("dst"), key, last.alias("last"), F.col("name").alias("full"))
    calls = facts.filter("kind = 'call'").select(key, "within", "target").distinct().withColumn("last", F.element_at(F.split("target", "::"), -1))
    hits = calls.join(callers, [key, "within"]).join(called, [key, "last"])
    fits = (F.col("full") == F.col("target")) | F.col("full").endswith(F.concat(F.lit("::"), "target")) | ~F.col("target").contains("::")
    return items, hits.filter(fits).select("src", "dst").distinct()
