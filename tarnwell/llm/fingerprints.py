"""SpotSigs fingerprints of documents, with DataFrame functions only.

Words are runs of letters and digits, in lower case. At every anchor (a common word) starts a chain:
the anchor and the next content words, other common words skipped. The set of a document's chains,
as 64-bit hashes, is its signature set; frequent function words make such chains follow the flowing
text and not lists and menus. Where no anchor stands among GAP words (lists, other languages), every
content word starts a chain, until an anchor comes: what a chain is depends on the words around it
only, so an edit changes chains nearby and no others. A text without a complete chain has its whole
word sequence as one.

The fingerprint is the signature set written out, so two fingerprints can be compared by themselves:
their likeness is the Jaccard similarity of the sets. The comparison is pruned. Sets that are empty,
or whose ranges of hashes do not meet, are not intersected. A caller who asks for pairs above a
least likeness puts sets in length partitions whose bounds grow by 1 / least; sets that are two
partitions apart, or whose lengths rule it out, are then given 0 without a look at them. By default
every value is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .secret_scan import let

# Common words of English, German, French and Spanish.
ANCHORS = tuple(
    sorted(
        set(
            "the of and a an to in is are was were be it that this for on with as at by from or not they have"
            " der die das den dem des ein eine einen und oder ist sind war im zu von mit auf für nicht auch sich dass"
            " le la les un une des du de et ou est sont dans que qui pour sur par avec pas ce au aux en"
            " el los las una unos unas y o es son del al que se con por para su como más lo".split()
        )
    )
)
CHAIN = 2  # content words that follow an anchor
GAP = 12  # words without an anchor behind which content words start chains


def signature_set(text: Column, chain: int = CHAIN) -> Column:
    """Distinct chain hashes of a text in ascending order; [] for texts without words.

    The k-th anchor (from 0) stands at word i, so i - k content words precede it: its chain begins
    with content word number i - k. Likewise, p - k anchors precede the k-th content word, at word p.
    """
    stands = lambda w: w.isin(*ANCHORS)

    def chains(words: Column, at: Column, anchors: Column) -> Column:
        """Of words, the positions of content words and those of anchors."""
        follow = lambda k: [F.get(words, F.get(at, k + j)) for j in range(chain)]
        of_anchors = F.transform(anchors, lambda i, k: F.when(i - k + chain <= F.size(at), F.xxhash64(words[i], *follow(i - k))))
        alone = lambda p, k: p - F.coalesce(F.get(anchors, p - k - 1), F.lit(-1)) > GAP
        of_gaps = F.transform(at, lambda p, k: F.when((k + 1 + chain <= F.size(at)) & alone(p, k), F.xxhash64(words[p], *follow(k + 1))))
        return F.array_sort(F.array_distinct(F.filter(F.concat(of_anchors, of_gaps), lambda h: h.isNotNull())))

    def sets(words: Column) -> Column:
        placed = lambda own: F.filter(F.transform(words, lambda w, i: F.when(own(w), i)), lambda i: i.isNotNull())
        made = let(placed(lambda w: ~stands(w)), lambda at: let(placed(stands), lambda anchors: chains(words, at, anchors)))
        whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
        return let(made, lambda m: F.when(F.size(m) > 0, m).otherwise(whole))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0), sets)


def fingerprint(signatures: Column) -> Column:
    """The signatures in hexadecimal digits, in ascending order, comma-joined; '' for an empty set."""
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.hex(h))), ",")


def length_partition(signatures: Column, least: float) -> Column:
    """Number of the set's length partition: sets that reach ``least`` lie in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / F.lit(math.log(1 / least))).cast("int")


def likeness(a: Column, b: Column, least: float | None = None) -> Column:
    """Jaccard similarity of two ascending signature sets; two empty sets are alike (1). Below ``least``, if given, it may be 0."""

    def of(x: Column, y: Column) -> Column:
        small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        apart = (F.get(x, F.size(x) - 1) < F.get(y, F.lit(0))) | (F.get(y, F.size(y) - 1) < F.get(x, F.lit(0)))
        if least:
            apart = (F.abs(length_partition(x, least) - length_partition(y, least)) > 1) | (small < F.lit(least) * large) | apart
        exact = let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))
        return F.when(large == 0, F.lit(1.0)).when((small == 0) | apart, F.lit(0.0)).otherwise(exact)

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def fingerprint_likeness(a: Column, b: Column, least: float | None = None) -> Column:
    """``likeness`` of two written fingerprints."""
    read = lambda f: F.array_sort(F.transform(F.filter(F.split(f, ","), lambda h: h != ""), lambda h: F.conv(h, 16, -10).cast("bigint")))
    return likeness(read(a), read(b), least)


def spot_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, signatures array<long>, fingerprint) of each row; null texts count as empty, null ids stay."""
    sets = docs.select(F.col(id_col), signature_set(F.col(text_col)).alias("signatures"))
    return sets.select(id_col, "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def following(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, next) of distinct ``ids``: the next larger id; the smallest one for the largest.

    Ids are dealt into ranges and written; windows then run inside a range, and over one row a range
    for the step from the last id of a range to the first of the next.
    """
    dealt = scratch.save(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("range")), "ranges")
    inside = dealt.select("id", "range", F.lead("id").over(Window.partitionBy("range").orderBy("id")).alias("next"))
    heads = dealt.groupBy("range").agg(F.min("id").alias("head"))
    order = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    return inside.join(heads, "range").select("id", F.coalesce("next", "head").alias("next"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    One row a document: id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document in ascending order of ids; after the last comes the first.
    Null texts count as empty. Rows with a null id have no next document: their edit is a cut, and
    near_next is 0. Rows that repeat an id share their next document; as a next document, such an
    id stands for the least of its texts. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.filter("id is not null")
    ids = known.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("quarter"))
    order = scratch.save(following(ids.select("id"), scratch).join(ids, "id"), "order")

    texts = known.repartition("id")
    least = texts.join(order.select(F.col("next").alias("id"), F.col("id").alias("asks"), "quarter").hint("shuffle_hash"), "id")
    least = least.select("asks", F.substring("text", F.lit(1), F.col("quarter")).alias("head"), F.col("text").alias("next_text"))
    repeated = known.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        least = least.groupBy("asks").agg(F.min(F.struct("next_text", "head")).alias("x")).select("asks", "x.head", "x.next_text")
    given = least.select(F.col("asks").alias("id"), "head", signature_set(F.col("next_text")).alias("next_signatures"))
    paired = texts.join(given.hint("shuffle_hash"), "id").unionByName(rows.filter("id is null"), allowMissingColumns=True)

    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    head = F.coalesce(F.substring(F.coalesce(F.col("head"), F.lit("")), F.lit(1), k), F.lit(""))
    edited = paired.select("id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - k), head).alias("edited"), "next_signatures")
    sets = edited.select("id", "n_chars", "edited", "next_signatures", signature_set(F.col("text")).alias("own"), signature_set(F.col("edited")).alias("other"))
    return sets.select(
        F.col("id").alias(id_col), "n_chars", "edited",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        F.when(F.col("next_signatures").isNull(), F.lit(0.0)).otherwise(likeness(F.col("own"), F.col("next_signatures"))).alias("near_next"),
    )
