"""Calls of source texts resolved by scopes, imports, impl headers and declared types.

A recursive-descent reader runs on executors, a text at a time, and yields what is written: items,
imports, fields, impl headers, functions, and calls with what is known of their receiver. What a name
means depends on other files, so that is settled by joins over all files: imports, re-exports and
globs are followed to declared items; a call then names a free function, or the methods of its
receiver's type, of the traits that type implements, or of every implementation where the receiver
is a trait. Calls on a receiver of unknown type name every method of that name, as ``by_braces`` does.

Not seen: macros, types that only inference gives (results of method calls, closures), blanket
implementations. An import or function inside a body counts for the module around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .parsers import NO_CALL, _comment_end, batched

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*|b?r(?P<hashes>\#*)"|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'[A-Za-z_]\w*)|(?P<path>[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)*)|(?P<sign>::|->|=>|[^\s\w])""",
    re.S | re.X,
)
_OPEN = {"(": ")", "[": "]", "{": "}"}
# Wrappers that pass method calls on to what they hold, and words before a type or a variable.
_WRAPPERS = frozenset(("Box", "Rc", "Arc"))
_BEFORE = frozenset(("&", "mut", "dyn", "impl", "ref"))
DDL = "module string, kind string, name string, line long, owner string, trait string, target string, form string, caller string"
_ROW = pa.schema([("key", pa.string()), *((x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in DDL.split(", "))])


def _tokens(text: str) -> list[tuple[str, int]]:
    out, at, line, last = [], 0, 0, 0
    while m := _TOKEN.search(text, at):
        line += text.count("\n", last, m.start())
        last, at = m.start(), m.end()
        if not m["skip"]:
            out.append((re.sub(r"\s+", "", m[0]), line))
        elif m[0] == "/*":
            at = _comment_end(text, at)
        elif m["hashes"] is not None:
            end = text.find('"' + m["hashes"], at)
            at = len(text) if end < 0 else end + 1 + len(m["hashes"])
    return out


class _Reader:
    """One text; ``rows`` are its facts, modules relative to the file. Unclosed brackets end with the text."""

    def __init__(self, text: str):
        self.tokens, self.at, self.rows = _tokens(text), 0, []
        self.items("", len(self.tokens))

    def see(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if 0 <= self.at + ahead < len(self.tokens) else ""

    def fact(self, module, kind, name, owner=None, trait=None, target=None, form=None, caller=None):
        line = self.tokens[min(self.at, len(self.tokens) - 1)][1]
        self.rows.append((module, kind, name, line, owner, trait, target, form, caller))

    def behind(self, at: int) -> int:
        """Behind the bracket that opens at ``at``."""
        depth = 0
        for k in range(at, len(self.tokens)):
            token = self.tokens[k][0]
            depth += (token in _OPEN) - (token in ")]}")
            if depth == 0:
                return k + 1
        return len(self.tokens)

    def angles(self) -> None:
        """Skip <...> where it stands next."""
        depth = 0
        while self.see() and (depth or self.see() == "<"):
            depth += (self.see() == "<") - (self.see() == ">")
            self.at += 1
            if not depth:
                return

    def until(self, *stops: str) -> None:
        """On to the next of ``stops`` outside of brackets."""
        while self.see() and self.see() not in stops:
            self.at = self.behind(self.at) if self.see() in _OPEN else self.at + 1

    def type_(self) -> str | None:
        """The path of the type that stands next, without references and wrappers."""
        while self.see() in _BEFORE:
            self.at += 1
        if not re.match(r"[A-Za-z_]", self.see()):
            return None
        path = self.see()
        self.at += 1
        if path.split("::")[-1] in _WRAPPERS and self.see() == "<":
            self.at += 1
            inner = self.type_()
            self.until(">", ",", ";", ")", "{")
            self.at += self.see() == ">"
            return inner
        self.angles()
        return path

    def items(self, module: str, end: int) -> None:
        while self.at < end:
            word = self.see()
            self.at += 1
            if word == "#":
                self.at += self.see() == "!"
                self.at = self.behind(self.at) if self.see() == "[" else self.at
            elif word == "use":
                self.use(module, "")
            elif word == "mod":
                name = self.see()
                self.fact(module, "mod", name)
                self.at += 1
                if self.see() == "{":
                    close = self.behind(self.at)
                    self.at += 1
                    self.items(f"{module}::{name}".lstrip(":"), close - 1)
                    self.at = close
            elif word == "struct":
                self.struct(module)
            elif word in ("enum", "union", "const", "static", "type") and re.match(r"[A-Za-z_]", self.see()) and self.see() not in ("fn", "unsafe", "extern", "async"):
                self.at += self.see() == "mut"
                name, at = self.see(), self.at
                self.at += 1
                target = None
                if word == "type":
                    self.angles()
                    if self.see() == "=":
                        self.at += 1
                        target = self.type_()
                self.until("{" if word in ("enum", "union") else ";", ";")
                here, self.at = self.at, at
                self.fact(module, word, name, target=target)
                self.at = self.behind(here) if here < len(self.tokens) and self.tokens[here][0] == "{" else here + 1
            elif word in ("trait", "impl"):
                self.block(module, word)
            elif word == "fn":
                self.function(module, None, None, None)
            elif word in _OPEN:
                self.at = self.behind(self.at - 1)

    def use(self, module: str, before: str) -> None:
        path = before
        while self.see() and self.see() not in (";", ",", "}"):
            token = self.see()
            self.at += 1
            if token == "{":
                while self.see() not in ("}", ""):
                    self.use(module, path)
                    self.at += self.see() == ","
                self.at += 1
                path = ""
            elif token == "*":
                self.fact(module, "use", "*", target=path)
                path = ""
            elif token == "as":
                self.fact(module, "use", self.see(), target=path)
                self.at += 1
                path = ""
            elif token != "::":
                path = before if token == "self" and before else f"{path}::{token}".lstrip(":")
        if path and path != before or path and self.tokens[self.at - 1][0] == "self":
            self.fact(module, "use", path.split("::")[-1], target=path)

    def struct(self, module: str) -> None:
        name = self.see()
        self.fact(module, "struct", name)
        self.at += 1
        self.angles()
        self.until("{", "(", ";")
        if self.see() == "{":
            close = self.behind(self.at)
            self.at += 1
            while self.at < close - 1:
                if self.see() == "#":
                    self.at = self.behind(self.at + 1)
                elif self.see(1) == ":":
                    field = self.see()
                    self.at += 2
                    if kind := self.type_():
                        self.fact(module, "field", field, owner=name, target=kind)
                    self.until(",", "}")
                else:
                    self.at += 1
            self.at = close

    def block(self, module: str, word: str) -> None:
        if word == "trait":
            owner, trait = self.see(), None
            self.fact(module, "trait", owner)
        else:
            self.angles()
            owner, trait = self.type_(), None
            if self.see() == "for":
                self.at += 1
                owner, trait = self.type_(), owner
            self.fact(module, "impl", owner, owner=owner, trait=trait)
        self.until("{", ";")
        close = self.behind(self.at)
        self.at += 1
        while self.at < close - 1:
            if self.see() == "fn":
                self.at += 1
                self.function(module, owner, trait, "trait" if word == "trait" else None)
            else:
                self.at = self.behind(self.at) if self.see() in _OPEN else self.at + 1
        self.at = close

    def bounds(self, known: dict[str, str | None], *stops: str) -> None:
        """Type parameters and the first trait each is bound by."""
        while self.see() and self.see() not in stops:
            if self.see(1) == ":":
                name = self.see()
                self.at += 2
                known[name] = self.type_()
            else:
                if re.match(r"[A-Z]\w*$", self.see()):
                    known.setdefault(self.see(), None)
                self.at += 1

    def function(self, module: str, owner: str | None, trait: str | None, form: str | None) -> None:
        start, name, types = self.at, self.see(), {}
        self.at += 1
        if self.see() == "<":
            self.bounds(types, ">", "(")
            self.at += self.see() == ">"
        known: dict[str, tuple[str, str, str | None] | None] = {"self": ("type", owner, None)} if owner else {}

        def meant(path: str | None) -> str | None:
            if path in types:
                return types[path]
            if path and owner and (path == "Self" or path.startswith("Self::")):
                return owner + path[4:]
            return path

        arguments: list[tuple[str, str | None]] = []
        self.until("(", "{", ";")
        if self.see() == "(":
            close = self.behind(self.at)
            self.at += 1
            while self.at < close - 1:
                while self.see() in _BEFORE:
                    self.at += 1
                variable = self.see()
                self.at += 1
                if self.see() == ":":
                    self.at += 1
                    arguments.append((variable, self.type_()))
                depth = 0
                while self.at < close - 1 and (depth > 0 or self.see() != ","):
                    depth += (self.see() == "<") - (self.see() == ">")
                    self.at = self.behind(self.at) if self.see() in _OPEN else self.at + 1
                self.at += 1
            self.at = close
        gives = None
        if self.see() == "->":
            self.at += 1
            gives = self.type_()
        self.until("where", "{", ";")
        if self.see() == "where":
            self.bounds(types, "{", ";")
        body, self.at = self.at, start
        caller = f"{name}:{self.tokens[min(start, len(self.tokens) - 1)][1]}"
        self.fact(module, "fn", name, owner=owner, trait=trait, target=meant(gives), form=form, caller=caller)
        self.at = body
        known |= {v: ("type", t, None) for v, kind in arguments if v != "self" and (t := meant(kind))}
        if self.see() == "{":
            close = self.behind(self.at)
            self.at += 1
            self.body(module, known, meant, caller, close - 1)
            self.at = close
        else:
            self.at += 1

    def body(self, module, known, meant, caller, end) -> None:
        """The calls between here and ``end``; known: variable -> (form, target, field) of its type."""
        scopes, open_, closed = [dict(known)], [], None
        while self.at < end:
            token, before = self.see(), self.see(-1)
            if token in ("fn", "use", "struct", "enum", "impl", "trait", "const", "static", "mod", "type") and before not in (".", ":", "&") or token == "#":
                # an item of its own, up to its end
                stop = self.at
                self.until("{", ";")
                close = min(self.behind(self.at) if self.see() == "{" and token != "#" else self.at + 1, end)
                if token == "#":
                    close = self.behind(stop + 1)
                elif token == "use":
                    self.at = stop
                    self.until(";")
                    close = self.at + 1
                self.at = stop
                self.items(module, close)
                self.at = max(self.at, close)
                continue
            self.at += 1
            if token == "{":
                scopes.append(dict(scopes[-1]))
            elif token == "}":
                scopes = scopes[:-1] or [{}]
            elif token == "let":
                self.let(scopes, meant)
            elif token == "(":
                open_.append(None)
            elif token == ")":
                closed = open_.pop() if open_ else None
            elif token == "<" and self.see(1) == "as" and self.see(3) == ">" and self.see(4) == "::" and self.see(6) == "(":
                self.fact(module, "call", self.see(5), target=meant(self.see()), form="type", caller=caller)
                self.at += 7
                open_.append(None)
            elif re.match(r"[A-Za-z_]", token):
                start = self.at - 1
                while self.see() == "::" and self.see(1) == "<":
                    self.at += 1
                    self.angles()
                    if self.see() == "::" and re.match(r"[A-Za-z_]", self.see(1)):
                        token += "::" + self.see(1)
                        self.at += 2
                if self.see() != "(":
                    continue
                self.at += 1
                if before == ".":
                    form, target, field = self.receiver(start - 2, scopes[-1], closed)
                    self.fact(module, "call", token, owner=field, target=target, form=form, caller=caller)
                    open_.append(None)
                elif token in NO_CALL or token in scopes[-1]:  # a keyword, or a closure in a variable
                    open_.append(None)
                elif path := meant(token):
                    self.fact(module, "call", path.split("::")[-1], target=path, form="path", caller=caller)
                    open_.append(path)
                else:
                    open_.append(None)

    def let(self, scopes, meant) -> None:
        self.at += self.see() == "mut"
        name = self.see()
        if not re.match(r"[a-z_]\w*$", name):
            return
        self.at += 1
        kind = None
        if self.see() == ":":
            self.at += 1
            kind = ("type", t, None) if (t := meant(self.type_())) else None
        elif self.see() == "=":
            ahead = 1 + sum(1 for k in (1, 2) if self.see(k) in ("&", "mut"))
            path = self.see(ahead)
            if re.match(r"[A-Za-z_]", path) and path not in NO_CALL:
                if self.see(ahead + 1) == "{":
                    kind = ("type", meant(path), None)
                elif self.see(ahead + 1) == "(":
                    after = self.behind(self.at + ahead + 1)
                    if after < len(self.tokens) and self.tokens[after][0] == ";":  # nothing is called on the result
                        kind = ("result", meant(path), None)
                elif self.see(ahead + 1) == ";":
                    kind = scopes[-1].get(path)
        scopes[-1][name] = kind

    def receiver(self, at: int, known, closed) -> tuple[str, str | None, str | None]:
        """(form, target, field) of what stands before the dot behind ``at``."""
        token = self.tokens[at][0] if at >= 0 else ""
        if token == ")" and closed:
            return "result", closed, None
        before = self.tokens[at - 1][0] if at > 0 else ""
        if before == "." and at > 1 and self.tokens[at - 3][0] != ".":
            got = known.get(self.tokens[at - 2][0])
            return ("field", got[1], token) if got and got[0] == "type" else ("any", None, None)
        got = known.get(token) if before != "." else None
        return got or ("any", None, None)


def read_names(text: str) -> list[tuple]:
    """(module, kind, name, line, owner, trait, target, form, caller) of a text, modules relative to it."""
    return _Reader(text).rows if text else []


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def facts() -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for fact in read_names(text or ""):
                    yield (key, *fact)

    return batched(facts(), _ROW)


def _joined(*parts) -> Column:
    """Path of the parts that are not empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "::")


def _parent(path) -> Column:
    return F.regexp_replace(path, r"(^|::)[^:]*$", "")


def _last(path) -> Column:
    return F.element_at(F.split(path, "::"), -1)


def source_names(sources: DataFrame) -> DataFrame:
    """(crate, key, module, kind, name, line, owner, trait, target, form, caller) of sources (crate, path, text), see parsers.crate_sources.

    module: the crate, the folders and file below src, and modules in the text. Null texts have no facts.
    """
    file = F.regexp_replace(F.regexp_extract("key", r"(?:^|/)src/(.*)\.rs$", 1), "/", "::")
    own = F.regexp_replace(file, r"(^|::)(mod|lib|main)$", "")
    facts = sources.select("path", "text").mapInArrow(_read, f"key string, {DDL}")
    crates = sources.select(F.col("path").alias("key"), "crate").dropDuplicates(["key"])
    return facts.join(crates, "key").withColumn("module", _joined("crate", own, "module"))


def _absolute(rows: DataFrame, known: DataFrame, crates: DataFrame, importing: bool) -> DataFrame:
    """``rows`` (crate, module, target) with path: where the target begins; names of the module before crates, in imports after them."""
    first = F.substring_index("target", "::", 1)
    rest = F.regexp_replace("target", r"^[^:]*(::)?", "")
    ups = F.regexp_extract("target", r"^((?:super::)*super)(::|$)", 1)
    n_up = F.when(ups != "", (F.length(ups) + 2) / 7).otherwise(0).cast("int")
    above = F.array_join(F.slice(F.split("module", "::"), F.lit(1), F.greatest(F.size(F.split("module", "::")) - n_up, F.lit(0))), "::")
    below = F.regexp_replace("target", r"^(super::)*super(::)?", "")
    local = known.select(F.col("path").alias("begin"), F.lit(True).alias("local"))
    out = rows.withColumn("begin", _joined("module", first)).join(local, "begin", "left").withColumn("outer", first).join(crates.select(F.col("crate").alias("outer"), F.lit(True).alias("foreign")), "outer", "left")
    foreign = F.col("foreign") if importing else F.col("foreign") & F.col("local").isNull()
    path = (
        F.when(first == "crate", _joined("crate", rest)).when(first == "self", _joined("module", rest)).when(n_up > 0, _joined(above, below))
        .when(foreign, F.col("target")).otherwise(_joined("module", "target"))
    )
    return out.withColumn("path", path).drop("begin", "local", "outer", "foreign")


def _settled(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, final): each path with its imported beginnings replaced until none is left; circles have no end.

    A step replaces the shortest beginning that is imported, and moves only paths that changed.
    """
    parts = F.split("at", "::")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))
    front = cut(paths.select("path", F.col("path").alias("at")).distinct())
    seen, ends = front, []
    while not front.isEmpty():
        hits = front.select("path", "at", F.explode(begins).alias("from")).join(aliases, "from")
        hits = hits.withColumn("short", F.min(F.length("from")).over(_by("path", "at"))).filter(F.length("from") == F.col("short"))
        moved = cut(hits.select("path", F.col("at").alias("was"), F.concat("to", F.expr("substr(at, length(from) + 1)")).alias("at")))
        ends.append(front.join(moved.select("path", F.col("was").alias("at")), ["path", "at"], "left_anti"))
        front = cut(moved.select("path", "at").distinct().join(seen, ["path", "at"], "left_anti"))
        seen = seen.unionByName(front)
    out = ends[0] if ends else front
    for more in ends[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("at", "final")


def _by(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def resolved_calls(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, crate, module, owner, trait, name, line) of functions and (src, dst, how) of calls, from source_names.

    how: ``path`` (named by its path), ``receiver`` (a method of the receiver's type), ``trait`` (an
    implementation or default of a trait) or ``name`` (receiver unknown: every method of the name).
    Calls of what no text defines give no row. Names in circles of imports mean nothing.
    """
    facts = cut(facts.withColumn("n", F.xxhash64("key", "kind", "line", "name", "caller", "target", "form")))
    crates = facts.select("crate").distinct()
    named = facts.filter("kind in ('mod', 'struct', 'enum', 'union', 'trait', 'const', 'static') or kind = 'fn' and owner is null or kind = 'type' and target is null")
    declared = named.select(_joined("module", "name").alias("path")).union(facts.select("module")).union(crates).distinct()

    # imports, then globs until they bring nothing new
    imports = facts.filter("kind = 'use' or kind = 'type' and target is not null")
    single = imports.filter("name <> '*' and name <> '_'").select(_joined("module", "name").alias("path"), "crate", "module", "target")
    known = declared.union(single.select("path")).distinct()
    begin = _absolute(single.withColumnRenamed("path", "from"), known, crates, importing=True)
    aliases = cut(begin.filter("path <> from").select("from", F.col("path").alias("to")).distinct())
    globs = cut(_absolute(imports.filter("name = '*'").select("crate", "module", "target"), known, crates, importing=True).select("module", "path").distinct())
    while not globs.isEmpty():
        names = declared.union(aliases.select("from")).distinct()
        open_ = globs.join(_settled(globs, aliases), "path").select("module", F.col("final").alias("above"))
        offered = names.select(F.col("path").alias("to"), _parent("path").alias("above"), _last("path").alias("name"))
        more = open_.join(offered, "above").select(_joined("module", "name").alias("from"), "to").distinct().join(names.withColumnRenamed("path", "from"), "from", "left_anti")
        more = cut(more.filter(F.col("from") != F.col("to")))
        if more.isEmpty():
            break
        aliases = cut(aliases.union(more))
    known = declared.union(aliases.select("from")).distinct()

    # every path that is written anywhere; one that ends at nothing declared is known by its last name
    sites = facts.filter("kind in ('fn', 'impl', 'field', 'call')")
    free = F.col("kind").isin("fn", "impl", "field")
    wanted = sites.select("crate", "module", F.explode(F.array_compact(F.array(
        F.when(free | (F.col("form") == "field"), F.when(F.col("kind") != "call", F.col("owner"))), "trait", "target",
        F.when(F.col("kind").isin("call") & F.col("form").isin("path", "result"), F.when(F.col("target").contains("::"), _parent("target"))),
    ))).alias("target")).distinct()
    starts = cut(_absolute(wanted, known, crates, importing=False))
    ends = _settled(starts.select("path"), aliases)
    real = ends.join(declared.select(F.col("path").alias("final"), F.lit(True).alias("real")), "final", "left")
    final = F.when(F.col("real"), F.col("final")).otherwise(F.concat(F.lit("::"), _last("final")))
    meaning = cut(starts.join(real.select("path", final.alias("means")), "path").select("module", F.col("target").alias("written"), "means").distinct())

    def meant(rows: DataFrame, column: str, to: str) -> DataFrame:
        return rows.join(meaning.select("module", F.col("written").alias(column), F.col("means").alias(to)), ["module", column], "left")

    fns = meant(meant(meant(facts.filter("kind = 'fn'"), "owner", "of"), "trait", "by"), "target", "gives")
    fns = cut(fns.select(F.xxhash64("key", "line", "name").alias("id"), "crate", "key", "module", "name", "line", "of", "by", "gives", "caller", (F.col("form") == "trait").alias("open")))
    impls = meant(meant(facts.filter("kind = 'impl' and trait is not null"), "owner", "of"), "trait", "by").select("of", "by").distinct()
    fields = meant(facts.filter("kind = 'field'"), "target", "holds").select("module", "owner", "name", "holds")
    fields = meant(fields, "owner", "of").select("of", F.col("name").alias("field"), "holds").distinct()
    paths = fns.filter("of is null").select(_joined("module", "name").alias("full"), F.col("id").alias("dst"), "gives")
    methods = fns.filter("of is not null").select("of", "by", "name", F.col("id").alias("dst"), "gives", F.coalesce("open", F.lit(False)).alias("open"))

    calls = facts.filter("kind = 'call'").withColumnRenamed("owner", "field").select("n", "crate", "key", "module", "name", "target", "form", "field", "caller")
    calls = cut(calls.join(fns.select("key", "caller", F.col("id").alias("src")), ["key", "caller"]).drop("key", "caller"))
    by_path = calls.filter("form in ('path', 'result')").withColumn("head", F.when(F.col("target").contains("::"), _parent("target"))).withColumn("tail", _last("target"))
    direct = meant(by_path, "target", "means").join(paths, F.col("means") == F.col("full")).select("n", "src", "name", "form", "dst", "gives")
    inside = meant(by_path, "head", "of").join(methods.withColumnRenamed("name", "tail"), ["of", "tail"]).select("n", "src", "name", "form", "dst", "gives")
    got = cut(direct.union(inside))
    named_calls = got.filter("form = 'path'").select("src", "dst", F.lit("path").alias("how"))

    # receivers: declared types, what called functions give, what fields hold, and types before ::
    typed = meant(calls.filter("form = 'type'"), "target", "of").select("n", "src", "name", "of")
    given = got.filter("form = 'result' and gives is not null").select("n", "src", "name", F.col("gives").alias("of"))
    held = meant(calls.filter("form = 'field'"), "target", "of").join(fields, ["of", "field"]).select("n", "src", "name", F.col("holds").alias("of"))
    heads = meant(by_path.filter("form = 'path' and head is not null"), "head", "of").select("n", "src", "name", "of")
    receivers = cut(typed.union(given).union(held).union(heads).filter("of is not null").distinct())
    own = receivers.join(methods.filter("not open"), ["of", "name"]).select("n", "src", "dst", "of", "name")
    of_trait = methods.filter("by is not null").select(F.col("by").alias("of"), "name", "dst").union(methods.filter("open").select("of", "name", "dst"))
    any_of = receivers.join(of_trait, ["of", "name"]).select("src", "dst", F.lit("trait").alias("how"))
    lacking = receivers.join(own.select("n", "of", "name"), ["n", "of", "name"], "left_anti")
    defaults = methods.filter("open").select(F.col("of").alias("by"), "name", "dst")
    brought = lacking.join(impls, "of").join(defaults, ["by", "name"]).select("src", "dst", F.lit("trait").alias("how"))
    unknown = calls.filter("form <> 'path'").join(receivers.select("n", "src"), ["n", "src"], "left_anti")
    by_name = unknown.join(methods.select("name", "dst"), "name").select("src", "dst", F.lit("name").alias("how"))
    edges = named_calls.union(own.select("src", "dst", F.lit("receiver").alias("how"))).union(any_of).union(brought).union(by_name)
    rank = F.when(F.col("how") == "path", 0).when(F.col("how") == "receiver", 1).when(F.col("how") == "trait", 2).otherwise(3)
    out = edges.groupBy("src", "dst").agg(F.min_by("how", rank).alias("how"))
    functions = fns.select("id", "crate", "module", F.col("of").alias("owner"), F.col("by").alias("trait"), "name", "line")
    return functions, out
