"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its distinct word shingles. Its signature has ``coordinates`` values; each
is the joint minimum of ``width`` hash permutations, so two documents agree in one with probability
J ** width. The join works on these coordinates:

1. Texts with the same set are one class, which its smallest id stands for. Of several classes with
   the same smallest id all but one get a number behind all ids. Classes that share an id are linked.
2. Each class is posted under all its (coordinate, value) pairs; lists with one member go.
3. Prefix: lists are ordered by length, then key. Of its k lists a class keeps all but the last
   ``matches - 1``. Two classes that collide in ``matches`` lists or more meet in the first list they
   share, which both keep; classes with fewer lists than ``matches`` collide with nobody and go.
4. Lists are worked off in two rounds of hubs: each member is held against one hub of its list, so a
   list of n classes gives n pairs and not n * n. Collisions of a pair are counted by merging the
   lists it was met in; pairs with ``matches`` or more are verified.
5. What is left are lists whose members are still in several components. There every class outside
   the list's largest component is compared with the list, in blocks of bounded size: collisions are
   counted over whole signatures, pairs below ``matches`` go, and a pair is taken in the first list
   it shares only (later lists skip it).

Every link is confirmed on the full sets: 100 * intersection >= percent * union. At the defaults a
pair of similarity 0.8 is missed with a probability of 1.5e-6; no list is cut, whatever its size.
Pairs inside one component are not enumerated; no link between components is lost.

Long lists are rows of joins on the list. Both sides of such a join are written tables, so that
adaptive execution can split a long list; groupings are by partial aggregates or by blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .components import components
from .kernels import mix64, pieces, word_lists
from .scratch import Scratch


@dataclass(frozen=True)
class MinHash:
    """Parameters. shingle: words; percent: least similarity; block: documents compared at a time."""

    shingle: int = 5
    percent: int = 80
    coordinates: int = 48
    width: int = 5
    matches: int = 3
    seed: int = 20240229
    block: int = 1024


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``size``: one shingle."""
    out: list[np.ndarray] = []
    for part in pieces(texts):
        value, bounds = word_lists(texts[part], lower=True)
        joint = np.zeros(max(len(value) - size + 1, 0), np.uint64)
        for k in range(size if len(joint) else 0):
            joint = mix64(joint * np.uint64(0x9E3779B97F4A7C15) + value[k : k + len(joint)])
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            n = end - begin
            if n >= size:
                out.append(np.unique(joint[begin : end - size + 1]))
            elif n:
                whole = np.zeros(1, np.uint64)
                for word in value[begin:end]:
                    whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + word)
                out.append(mix64(whole + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], how: MinHash) -> np.ndarray:
    """One row of ``how.coordinates`` uint64 for each non-empty set."""
    rng = np.random.default_rng(how.seed)
    factors = (rng.integers(0, 1 << 32, how.coordinates * how.width, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    out = np.empty((len(sets), how.coordinates), np.uint64)
    begin = 0
    while begin < len(sets):  # about 64k shingles at a time, so that a pass stays in cache
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 65536):
            size += len(sets[end])
            end += 1
        some = sets[begin:end]
        offset = np.cumsum([0, *map(len, some[:-1])])
        low = mix64(np.concatenate(some)).astype(np.uint32)
        joint = np.zeros((how.coordinates, len(some)), np.uint64)
        for i, factor in enumerate(factors):
            least = np.minimum.reduceat(low * factor, offset)
            joint[i // how.width] = mix64(joint[i // how.width] * np.uint64(31) + least + np.uint64(1))
        out[begin:end] = joint.T
        begin = end
    return out


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _features(how: MinHash):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch.column("text")), how.shingle)
            full = [i for i, x in enumerate(sets) if len(x)]
            rows = dict(zip(full, signatures([sets[i] for i in full], how), strict=True)) if full else {}
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([rows[i].tobytes() if i in rows else None for i in range(len(sets))], pa.binary()),
                ],
                schema=schema,
            )

    return run


def _sets(how: MinHash):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(_texts(batch.column("text")), how.shingle)]
            # an id can come with other texts than that of its class
            own = pa.array([_digest(x) == d for x, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], schema=schema).filter(own)

    return run


def _list_keys(table: np.ndarray) -> np.ndarray:
    """The list of each coordinate's value: a 64-bit key of (coordinate, value)."""
    coordinate = np.arange(1, table.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(table + coordinate).view(np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("list", pa.int64()), ("id", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), table.shape[1])
        yield pa.record_batch([pa.array(_list_keys(table).ravel()), pa.array(ids, pa.int64())], schema=schema)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; sizes too far apart are not compared."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(how: MinHash):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("a", "b", "set_a", "set_b")), strict=True)
            kept = [(a, b) for a, b, x, y in rows if _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), how.percent)]
            yield pa.record_batch([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _collisions(how: MinHash):
    """In one block of one list: the pairs to verify, packed by the class outside the component."""

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, list[int]]] = []
        ids, comp, outside, asks = (group.column(x).to_numpy() for x in ("id", "component", "outside", "asks"))
        lists = _list_keys(np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(len(ids), -1))
        pair = pa.concat_arrays([x.flatten() for x in group.column("lists").chunks])
        key, first = np.unique(pair.field("list").to_numpy(), return_index=True)
        place = np.empty(len(key), np.int64)
        place[np.lexsort((key, pair.field("n").to_numpy()[first]))] = np.arange(len(key))  # in the order of prefixes
        at = np.minimum(np.searchsorted(key, lists), len(key) - 1)
        rank = np.where(key[at] == lists, place[at], len(key))
        this, blocks = int(place[np.searchsorted(key, group.column("list")[0].as_py())]), group.column("blocks")[0].as_py()
        members = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            # a pair of two classes outside is taken once, by the larger id
            other = members[(comp[members] != comp[i]) & ((ids[members] < ids[i]) | ~outside[members])]
            same = lists[other] == lists[i]
            enough = same.sum(axis=1) >= how.matches
            first = np.where(same[enough], rank[i], len(key)).min(axis=1, initial=len(key)) == this  # else met in an earlier list
            hit = ids[other[enough][first]]
            for block in np.unique(hit % blocks):
                out.append((int(ids[i]), int(block), hit[hit % blocks == block].tolist()))
        return pa.table(
            {
                "a": pa.array([x[0] for x in out], pa.int64()),
                "block": pa.array([x[1] for x in out], pa.int64()),
                "others": pa.array([x[2] for x in out], pa.list_(pa.int64())),
            }
        )

    return run


def _confirm_blocks(how: MinHash):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = dict(zip(right.column("id").to_pylist(), (np.frombuffer(x, np.uint64) for x in right.column("shingles").to_pylist()), strict=True))
        found = []
        for a, others, text in zip(*(left.column(x).to_pylist() for x in ("a", "others", "set_a")), strict=True):
            mine = np.frombuffer(text, np.uint64)
            found += [(a, b) for b in set(others) if b in sets and _linked(mine, sets[b], how.percent)]
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, n_shingles, component_id, kept).

    component_id is the smallest id reachable over links, itself included; kept marks the document
    whose id that is. Null or blank texts have no shingles and link with nothing. Rows with a null
    id come back with a null component and kept true. Rows that repeat an id are one document that
    links by any of its texts, and come back as often as they came in. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = scratch.save(source.mapInArrow(_features(how), "id long, n long, digest binary, signature binary"), "features")
    full = features.filter("id is not null and digest is not null")
    classes = scratch.save(_classes(full, scratch), "classes")
    members = scratch.save(full.select("id", "n", "digest").join(classes, "digest").select("id", "n", "node"), "members")
    nodes = full.join(classes.select(F.col("digest").alias("d"), "least", "node"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("least")))
    signed = scratch.save(nodes.select(F.col("node").alias("id"), "signature").dropDuplicates(["id", "signature"]), "signatures")
    bare = scratch.save(features.filter("id is null or digest is null").select("id", "n"), "bare")
    scratch.drop(features)

    profiles = scratch.save(_profiles(signed, how, scratch), "profiles")
    scratch.drop(signed)
    lists = scratch.save(_lists(profiles, how, scratch), "lists")
    listed = scratch.save(lists.select("id").distinct(), "listed")
    n_listed = listed.count()
    texts = classes.join(listed.withColumnRenamed("id", "node"), "node", "left_semi")
    wanted = F.broadcast(texts) if n_listed <= 100_000 else texts.hint("shuffle_hash")
    sets = scratch.save(source.join(wanted, F.col("id") == F.col("least")).select(F.col("node").alias("id"), "digest", "text").mapInArrow(_sets(how), "id long, shingles binary"), "sets")

    def confirm(met: DataFrame) -> DataFrame:
        """Links (u, v) of pairs (a, b), one row for each list they were met in."""
        pairs = met.groupBy("a", "b").agg(F.count("*").alias("collisions")).filter(F.col("collisions") >= how.matches)
        joined = (
            pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        )
        return joined.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(how), "u long, v long")

    def join_up(known: DataFrame | None, links: DataFrame) -> DataFrame:
        """Labels (id, component) after more links; labels stand for the links before."""
        if known is not None:
            links = links.union(known.select(F.col("id").alias("u"), F.col("component").alias("v")))
        return scratch.save(components(links, scratch).withColumnRenamed("node", "id"), "labels")

    several = scratch.save(members.groupBy("id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last"), "several")
    own = members.join(several, "id").select(F.col("node").alias("u"), F.col("first").alias("v"))  # the texts of one id
    star = lists.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    labels = join_up(None, confirm(star).union(own))

    for again in (True, False):
        active = _active(lists, labels, scratch)
        if active.isEmpty():
            break
        links = confirm(_second_hubs(active, scratch)) if again else _remainder(active, profiles, sets, n_listed, how, scratch)
        labels = join_up(labels, links)

    def component_of(rows: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component_id", F.coalesce("component", "node"))

    found = component_of(members).select("id", "n", "component_id")
    # rows without shingles go with the other texts of their id
    other = scratch.save(members.join(bare.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("node").alias("node")), "other")
    bare = bare.join(component_of(other).select("id", "component_id"), "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return found.union(bare).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _second_hubs(active: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), one row for each list: its members against another hub of it, the first in an order of all ids."""
    hubs = scratch.save(active.groupBy("list").agg(F.min_by(F.struct("id", "component"), F.struct(F.xxhash64("id"), "id")).alias("hub")), "hubs")
    apart = active.join(hubs, "list").filter("component <> hub.component")
    return apart.select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b"))


def _remainder(active: DataFrame, profiles: DataFrame, sets: DataFrame, n_listed: int, how: MinHash, scratch: Scratch) -> DataFrame:
    """All links (u, v) that are left, exactly: classes outside the largest component of their list against the list."""
    sized = active.groupBy("list", "component").agg(F.count("*").alias("k"), F.min("id").alias("least"))
    largest = scratch.save(sized.groupBy("list").agg(F.max_by("component", F.struct("k", "least")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("k")), "largest")
    cuts, block = F.ceil(F.col("n") / F.lit(how.block)).cast("long"), F.lit(max(1, n_listed // how.block))
    rows = (
        active.join(largest, "list")
        .select("list", "id", "component", (F.col("component") != F.col("main")).alias("outside"), cuts.alias("cuts"), F.ceil((F.col("n") - F.col("k")) / F.lit(how.block)).cast("long").alias("turns"))
        .join(profiles, "id")
    )
    # a member lies in one cut of its list, a class outside asks every cut; those who ask are split into turns
    zero = F.lit(0).cast("long")
    cut, turn = F.pmod(F.xxhash64("id"), "cuts"), F.pmod(F.xxhash64("id", F.lit(1)), "turns")
    member = rows.select("*", cut.alias("cut"), F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"))
    asking = rows.filter("outside").select("*", F.explode(F.sequence(zero, F.col("cuts") - 1)).alias("cut"), turn.alias("turn"), F.lit(True).alias("asks"))
    packed = (
        member.unionByName(asking)
        .select("list", "cut", "turn", "id", "component", "outside", "asks", "signature", "lists", block.cast("long").alias("blocks"))
        .groupBy("list", "cut", "turn")
        .applyInArrow(_collisions(how), "a long, block long, others array<long>")
    )
    packed = scratch.save(packed.groupBy("a", "block").agg(F.flatten(F.collect_list("others")).alias("others")), "packed")
    salts = packed.count() // (max(1, n_listed // how.block) * 512) + 1
    left = packed.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    right = sets.join(active.select("id").distinct(), "id", "left_semi").select(
        "*", F.pmod("id", block.cast("long")).alias("block"), F.explode(F.sequence(zero, F.lit(salts - 1).cast("long"))).alias("salt")
    )
    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_confirm_blocks(how), "u long, v long")


def _classes(full: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, least, node): the smallest id of each set, and the number that stands for the set.

    That is least, but for sets whose least already stands for another one: they follow the
    largest id. They share their least with a set of a smaller number, so no component is named by them.
    """
    classes = full.groupBy("digest").agg(F.min("id").alias("least"))
    taken = classes.groupBy("least").agg(F.count("*").alias("k"), F.min("digest").alias("first")).filter("k > 1")
    extra = scratch.save(classes.join(taken, "least").filter("digest <> first").select("digest"), "extra")
    if extra.isEmpty():
        return classes.withColumn("node", F.col("least"))
    last = full.agg(F.max("id")).first()[0]
    numbers = numbered(extra, ["digest"], "number").select("digest", (F.col("number") + F.lit(last)).alias("number"))
    return classes.join(numbers, "digest", "left").select("digest", "least", F.coalesce("number", "least").alias("node"))


def _profiles(signed: DataFrame, how: MinHash, scratch: Scratch) -> DataFrame:
    """(id, lists, signature) of the classes in ``matches`` or more lists of two members or more.

    lists: array of (n, list), n the list's members, in ascending order.
    """
    posted = signed.select("id", "signature").mapInArrow(_postings, "list long, id long")
    shared = scratch.save(posted.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    own = posted.join(shared, "list").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "list"))).alias("lists"))
    return own.filter(F.size("lists") >= how.matches).join(signed, "id")


def _lists(profiles: DataFrame, how: MinHash, scratch: Scratch) -> DataFrame:
    """(list, id, hub): the members of each list in whose prefix it is, if there are two; hub: the least of them."""
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (how.matches - 1))
    kept = profiles.select(F.explode(F.transform(prefix, lambda x: x["list"])).alias("list"), "id")
    hubs = scratch.save(kept.groupBy("list").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1").drop("n"), "hubs")
    return kept.join(hubs, "list")


def _active(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(list, id, component) of the lists whose members are in more than one component."""
    known = scratch.save(lists.select("list", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
    mixed = scratch.save(known.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("list"), "mixed")
    return scratch.save(known.join(mixed, "list"), "active")
