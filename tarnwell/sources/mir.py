"""Textual dumps of compiled bodies as the tables that ``operators.extraction`` takes.

A dump is a sequence of bodies, ``fn path(_1: T) -> T {`` and so on, each closed by a brace at the
start of a line. Files are read by bodies, as records that end with this brace, so a large file is
split between tasks and no file is read whole. All is expressions over the lines of a body; what a
query doesn't use is not computed.

Functions are known by their path without generic arguments; keys are hashes of it. Closures are
named in statements by where they stand in the source, and the body of a closure has this place in
the type of its first argument. Null and malformed records have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format of the dumps.
_ANGLES = r"<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)*>"  # brackets nested four deep
_BODY = r"(?m)^fn (.*?)\((?=_1: |\))"
_PLACE = r"\{(?:async )?(?:closure|coroutine)@([^}#]*?)(?: \(#\d+\))?\}"
_FIRST = r"(?m)^fn .*?\(_1: [^,)]*?" + _PLACE
_CALL = rf"^(?:\S+ = )?((?:{_ANGLES}|[^(<=]|<)+?)\((.*)\) -> (?:\[|unwind|bb\d)"
_ASSIGN = r"^(\S+) = (.*);$"
_CAST = r"^(.*) as .* \((?:PointerCoercion\()?(\w+)"
_BINARY = r"^(?:Add|Sub|Mul|Div|Rem|BitXor|BitAnd|BitOr|Shl|Shr|Eq|Lt|Le|Ne|Ge|Gt|Cmp|Offset)\w*\((.*)\)$"
_MANY = r"^(?:\[(.*)\]|\((.*)\)|[\w:<>, ]+ \{ (.*) \}|[A-Z][\w:<>, ]*\((.*)\))$"


def _plain(path: Column) -> Column:
    """A function's path without generic arguments."""
    return F.trim(F.regexp_replace(F.regexp_replace(path, f"::{_ANGLES}", ""), r"^const ", ""))


def _operands(text: Column) -> Column:
    """array<struct<kind, name>> of a list of operands: fn for what is written as a path, place for others."""
    parts = F.filter(F.transform(F.split(text, r",\s+"), lambda x: F.regexp_replace(F.trim(x), r"^\w+: ", "")), lambda x: x != "")
    named = lambda x: x.rlike(r"^(?:const )?[A-Za-z_<][\w:<>{}#@ ]*$") & ~x.rlike(r"^(?:move|copy) |^_\d|^const (?:true|false|-?\d|[\"'(])")
    return F.transform(parts, lambda x: F.struct(F.when(named(x), "fn").otherwise("place").alias("kind"), F.when(named(x), _plain(x)).alias("name")))


def read_mir(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): the bodies of the dumps below ``path``."""
    return spark.read.option("lineSep", "\n}\n").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def functions(bodies: DataFrame) -> DataFrame:
    """(key, name, place): the functions that have a body; place: of a closure, else null."""
    name = _plain(F.regexp_extract("body", _BODY, 1))
    place = F.regexp_extract("body", _FIRST, 1)
    return bodies.filter(F.regexp_extract("body", _BODY, 1) != "").select(F.xxhash64(name).alias("key"), name.alias("name"), F.when(place != "", place).alias("place")).distinct()


def _lines(bodies: DataFrame) -> DataFrame:
    """(name, line): the trimmed lines behind the first of each function."""
    rows = bodies.filter(F.regexp_extract("body", _BODY, 1) != "").select(_plain(F.regexp_extract("body", _BODY, 1)).alias("name"), F.explode(F.split(F.regexp_extract("body", r"(?s)\nfn [^\n]*\n(.*)|^fn [^\n]*\n(.*)", 0), "\n")).alias("line"))
    arrow = F.regexp_replace(F.trim("line"), r"->(?! (?:\[|unwind|bb\d))", "~")  # of a function's type, whose sign would close a bracket
    return rows.select("name", arrow.alias("line")).filter("line <> '' and not startswith(line, 'fn ')")


def named_statements(bodies: DataFrame) -> DataFrame:
    """(name, kind, target, place, rvalue, cast, operands): calls and assignments of each function, by names.

    kind: call, closure or assign. target: the called path, null for a call through a value; place:
    where a closure stands. cast: the kind of a cast.
    """
    lines = _lines(bodies)
    line = F.col("line")
    call, whole = F.regexp_extract(line, _CALL, 1), F.regexp_extract(line, _ASSIGN, 2)
    place, cast = F.regexp_extract(whole, "^" + _PLACE, 1), F.regexp_extract(whole, _CAST, 2)
    many = F.coalesce(*[F.nullif(F.regexp_extract(whole, _MANY, k), F.lit("")) for k in (1, 2, 3, 4)], F.lit(""))
    binary = F.regexp_extract(whole, _BINARY, 1)
    is_call, is_closure = call != "", place != ""
    rvalue = F.when(is_call | is_closure, None).when(cast != "", "Cast").when(binary != "", "BinaryOp").when(many != "", "Aggregate").otherwise("Use")
    listed = F.when(is_call, F.regexp_extract(line, _CALL, 2)).when(cast != "", F.regexp_extract(whole, _CAST, 1)).when(binary != "", binary).when(many != "", many).otherwise(whole)
    rows = lines.filter(is_call | (whole != ""))
    return rows.select(
        "name", F.when(is_call, "call").when(is_closure, "closure").otherwise("assign").alias("kind"),
        F.when(is_call & ~call.rlike(r"^(?:move|copy) |^_\d|^\("), _plain(call)).alias("target"), F.when(~is_call & is_closure, place).alias("place"),
        rvalue.alias("rvalue"), F.when(~is_call & (cast != ""), cast).alias("cast"), _operands(listed).alias("operands"),
    )


def statements(bodies: DataFrame) -> DataFrame:
    """(src, kind, target, rvalue, operands array<struct<kind, target>>): what ``extraction.body_edges`` takes, by keys.

    Paths that no body has stay as keys, as of functions of another crate; closures are found by their place.
    """
    named = named_statements(bodies)
    places = functions(bodies).filter("place is not null").groupBy("place").agg(F.min("key").alias("closure"))
    of = F.xxhash64
    listed = F.transform("operands", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["name"].isNotNull(), of(x["name"])).alias("target")))
    # most statements have no place: a second key deals them over all tasks, and no closure has theirs.
    # A task holds its share of the closures, each a short row, and sorts no statements.
    spread = F.when(F.col("place").isNull(), of("name")).otherwise(F.lit(0).cast("long")).alias("spread")
    rows = named.select("place", spread, of("name").alias("src"), "kind", F.when(F.col("target").isNotNull(), of("target")).alias("to"), "rvalue", listed.alias("operands"))
    rows = rows.join(places.withColumn("spread", F.lit(0).cast("long")).hint("shuffle_hash"), ["place", "spread"], "left")
    return rows.select("src", "kind", F.when(F.col("kind") == "closure", F.col("closure")).otherwise(F.col("to")).alias("target"), "rvalue", "operands")


def casts(bodies: DataFrame) -> DataFrame:
    """(kind, target, is_fn, type_id): what ``extraction.cast_facts`` takes; type_id: hash of the type that an Unsize cast makes."""
    rows = _lines(bodies).withColumn("whole", F.regexp_extract("line", _ASSIGN, 2)).withColumn("kind", F.regexp_extract("whole", _CAST, 2)).filter("kind <> ''")
    operand = _operands(F.regexp_extract("whole", _CAST, 1))[0]
    made = F.regexp_extract("whole", r"^.* as (.*) \(PointerCoercion\(Unsize", 1)
    return rows.select("kind", F.when(operand["name"].isNotNull(), F.xxhash64(operand["name"])).alias("target"), operand["name"].isNotNull().alias("is_fn"), F.when(made != "", F.xxhash64(made)).alias("type_id"))
