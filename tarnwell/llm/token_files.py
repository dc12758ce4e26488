"""Token ids of a corpus as compressed planes, with a chunk index.

Documents are dealt into shards by ranges of their id and sorted within a shard, so shard order and
row order together are the order of ids. A shard's token stream is cut into blocks of a fixed
number of ids. A block's ids are transposed into byte planes (or bit planes), each plane is
compressed with zstandard, and the block is one chunk: a header, the plane lengths, the planes.

The files are Parquet with one chunk a row, beside it the chunk's index entry: shard, chunk number,
offset of its first id in the shard, number of ids, and the documents it holds with their offset
and length. Readers of the index alone touch those columns only. Spark's own writer makes them, so
they can lie in any store, and a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import BLOCK, FIRST_BYTES, eights_of, pieces, span_hashes
from .scratch import Scratch, arrow_batches

_HEAD = struct.Struct("<4sBBI")  # magic, 1 for bit planes, number of planes, number of ids
_MAGIC = b"TWP1"
REMEMBERED = 700_000  # segments


@dataclass(frozen=True)
class Files:
    """block_ids: ids of a chunk. bits: bit planes in place of byte planes. shard_bytes: least text of a shard.

    most_shards: beyond so many, shards grow; a shard is written a chunk at a time, whatever its size.
    """

    block_ids: int = 1 << 17
    bits: bool = False
    level: int = 3
    shard_bytes: int = 24 << 20
    most_shards: int = 50_000


def pack(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """One chunk of ids below 2**32; planes above the largest id are left out."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    most = int(ids.max()) if len(ids) else 0
    if bits:
        lit = np.unpackbits(raw, axis=1, bitorder="little")[:, : most.bit_length()]
        planes = [np.packbits(lit[:, k]).tobytes() for k in range(lit.shape[1])]
    else:
        planes = [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((most.bit_length() + 7) // 8)]
    small = [zstandard.compress(x, level) for x in planes]
    return _HEAD.pack(_MAGIC, bits, len(small), len(ids)) + struct.pack(f"<{len(small)}I", *map(len, small)) + b"".join(small)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk, uint32."""
    magic, bits, planes, n = _HEAD.unpack_from(chunk)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    sizes = struct.unpack_from(f"<{planes}I", chunk, _HEAD.size)
    at, out = _HEAD.size + 4 * planes, np.zeros((n, 32 if bits else 4), np.uint8)
    for k, size in enumerate(sizes):
        plane = np.frombuffer(zstandard.decompress(chunk[at : at + size]), np.uint8)
        out[:, k] = np.unpackbits(plane, count=n) if bits else plane
        at += size
    return (np.packbits(out, axis=1, bitorder="little") if bits else out).reshape(-1).view("<u4")


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``pool`` in a row."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """Ids of segments by a 64-bit hash: an open-addressed table in arrays. The bytes are kept and compared.

    When it is full, segments not used since the last time go.
    """

    def __init__(self, most: int):
        self.most = most
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        n = self.mask + 1
        self.keys = np.zeros(n, np.uint64)  # 0: free
        self.start, self.size, self.used = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
        self.begin, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.text, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint8), 0
        self.eights = eights_of(self.text)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would go."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
        return at

    def find(self, keys: np.ndarray, eights: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether it holds the segment) of each; the segments' bytes lie in ``eights`` (see eights_of)."""
        at = self.slots(keys)
        hit = (self.keys[at] == keys) & (self.length[at] == size)
        rows, place = np.flatnonzero(hit), 0
        while len(rows):
            left = size[rows] - 8 * place
            differ = ((eights[start[rows] + 8 * place] ^ self.eights[self.begin[at[rows]] + 8 * place]) & FIRST_BYTES[np.minimum(left, 8)]) != 0
            hit[rows[differ]] = False
            rows, place = rows[(left > 8) & ~differ], place + 1
        return at, hit

    def _add(self, keys: np.ndarray, text: np.ndarray, length: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Segments with distinct keys, none of which is known; their bytes and ids in a row."""
        begin, start = len(self.text) + np.cumsum(length) - length, len(self.pool) + np.cumsum(size) - size
        self.text, self.pool = np.concatenate([self.text, text]), np.concatenate([self.pool, ids])
        self.eights = eights_of(self.text)
        self.count += len(keys)
        left = np.arange(len(keys))
        while len(left):
            at = self.slots(keys[left])
            self.keys[at] = keys[left]  # of several for one free slot, one stays
            won = self.keys[at] == keys[left]
            own, at = left[won], at[won]
            self.begin[at], self.length[at], self.start[at], self.size[at], self.used[at] = begin[own], length[own], start[own], size[own], True
            left = left[~won]

    def learn(self, keys: np.ndarray, text: np.ndarray, length: np.ndarray, ids: list[np.ndarray]) -> None:
        self._add(keys, text, length, np.concatenate([self.pool[:0], *ids]), np.array([len(x) for x in ids], np.int64))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots in a row, and how many each has."""
        self.used[at] = True
        n = self.size[at].astype(np.int64)
        return _gathered(self.pool, self.start[at], n), n

    def shrink(self) -> None:
        if self.count <= self.most:
            return
        kept = np.flatnonzero(self.used & (self.keys != 0))
        if len(kept) > 3 * self.most // 4:
            self.clear()
            return
        pool, n = self.ids(kept)
        keys, length = self.keys[kept], self.length[kept].astype(np.int64)
        text = _gathered(self.text, self.begin[kept], length)
        self.clear()
        self._add(keys, text, length, pool, n)
        self.used[:] = False


class SegmentEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct segment.

    The pre-tokenizer of byte-level vocabularies puts a boundary behind a character that is not
    white space where white space follows, and between a letter and an ASCII sign. The text is cut
    at such places; texts with other white space or with an added token go to the library whole. New segments
    are handed to the library as one text, and its ids are dealt back by their byte lengths.
    """

    _other_space = re.compile(r"[^\S \t\n\r]")
    _BLANK, _LETTER, _SIGN, _LATIN, _TRAIL = 1, 2, 4, 8, 16
    _kind = np.zeros(256, np.uint8)
    _kind[[c for c in range(128) if not chr(c).isalnum()]] = _SIGN
    _kind[[9, 10, 13, 32]] = _BLANK
    _kind[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
    _kind[0xC3:0xC9] = _LATIN  # first byte of a Latin letter, but for two signs
    _kind[0x80:0xC0] = _TRAIL

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        known = json.loads(self.library.to_str())
        before = known.get("pre_tokenizer") or {}
        self.by_segment = known.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        # in byte-level vocabularies every character of a token stands for a byte
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.sizes[i] = len(token)
        self.added = [x["content"] for x in known.get("added_tokens", [])]
        self.known = _Known(REMEMBERED)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _segments(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of new segments."""
        spaces = " \t\n\r"
        # a line end before a segment that begins without white space is a token of its own
        joined = [x if x[0] in spaces else "\n" + x for x in segments]
        lead = np.fromiter((x[0] not in spaces for x in segments), np.int64, len(segments))
        if any(x[-1] in spaces for x in segments):  # at the end of a text
            return self._library(segments)
        ids = np.array(self.library.encode("".join(joined), add_special_tokens=False).ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in joined), np.int64, len(joined)))
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends) + 1
        if last[-1] != len(ids) or (reached[last - 1] != ends).any():  # not cut where expected
            return self._library(segments)
        return [ids[a:b] for a, b in zip((np.concatenate([[0], last[:-1]]) + lead).tolist(), last.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        whole = [i for i, x in enumerate(texts) if not self.by_segment or len(x) > 4 * BLOCK or self._other_space.search(x) or any(a in x for a in self.added)]
        direct = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True)) if whole else {}
        raw = [b"" if i in direct else x.encode() for i, x in enumerate(texts)]
        bounds = np.cumsum([0, *map(len, raw)])
        flat = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        kind = self._kind[flat[:-8]]
        n = len(kind)
        if not n:
            return [direct.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        letter = (kind == self._LETTER)
        signs = (flat[1:n] == 0x97) | (flat[1:n] == 0xB7)
        letter[1:] |= (kind[1:] == self._TRAIL) & (kind[:-1] == self._LATIN) & ~((flat[: n - 1] == 0xC3) & signs)
        cut = np.zeros(n, bool)
        cut[1:] = ((kind[1:] == self._BLANK) & (kind[:-1] != self._BLANK)) | ((kind[1:] == self._SIGN) & letter[:-1])
        cut[bounds[:-1][bounds[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        key = span_hashes(flat[:n], start, end) | np.uint64(1)
        size, eights = end - start, eights_of(flat)
        entry, hit = self.known.find(key, eights, start, size)
        if not hit.all():
            new, first = np.unique(key[~hit], return_index=True)
            at = np.flatnonzero(~hit)[first]
            found = self._segments([flat[a:b].tobytes().decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            clash = self.known.keys[self.known.slots(new)] == new  # another segment has this hash: such texts go whole
            own = at[~clash]
            self.known.learn(new[~clash], _gathered(flat, start[own], size[own]), size[own], [x for x, c in zip(found, clash.tolist(), strict=True) if not c])
            late = np.flatnonzero(~hit)
            entry[late], hit[late] = self.known.find(key[late], eights, start[late], size[late])
        ids, many = self.known.ids(entry)
        ends = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, bounds)]
        for i in {int(np.searchsorted(bounds, a, "right")) - 1 for a in start[~hit].tolist()}:
            direct[i] = self._library([texts[i]])[0]
        self.known.shrink()
        return [direct[i] if i in direct else ids[a:b] for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]


@lru_cache(maxsize=4)
def encoder(path: str) -> SegmentEncoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    return SegmentEncoder(path)


_CHUNK_DDL = "shard int, chunk int, first long, n long, payload binary, docs array<struct<id: long, start: long, n: long>>"
_CHUNK = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()),
        ("docs", pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))),
    ]
)


def _write(path: str, how: Files, end_id: int):
    """Chunks of one shard, from its documents in order; holds a block and a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        n_held, docs, at = 0, [], 0
        tail = np.array([end_id], "<u4")

        def chunk(n: int) -> pa.RecordBatch:
            nonlocal held, n_held, docs, number, first
            ids = np.concatenate(held) if len(held) > 1 else held[0]
            inside = [x for x in docs if x["start"] < first + n]
            row = pa.RecordBatch.from_pylist([{"shard": shard, "chunk": number, "first": first, "n": n, "payload": pack(ids[:n], how.bits, how.level), "docs": inside}], schema=_CHUNK)
            number, first, n_held = number + 1, first + n, n_held - n
            held = [ids[n:]] if n_held else []
            docs = [x for x in docs if x["start"] + x["n"] > first]
            return row

        for batch in batches:
            texts, codes = [x or "" for x in batch.column("text").to_pylist()], encoder(path)
            encoded = (ids for part in pieces(texts) for ids in codes.encode(texts[part]))
            for doc, ids in zip(batch.column("id").to_pylist(), encoded, strict=True):
                docs.append({"id": doc, "start": at, "n": len(ids) + 1})
                at += len(ids) + 1
                held += [ids, tail]
                n_held += len(ids) + 1
                if n_held >= how.block_ids:
                    while n_held >= how.block_ids:
                        yield chunk(how.block_ids)
        if n_held:
            yield chunk(n_held)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, how: Files = Files(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write their chunks to ``path`` (a folder in a shared store).

    Order: ascending id, nulls first; rows that repeat an id follow a hash of their text. Null and
    empty texts have the end id alone. An empty table gives files without rows. Other columns are
    ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(min(how.most_shards, n_bytes // how.shard_bytes + 1), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_write(vocabulary, how, end_id), _CHUNK_DDL).write.parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNK_DDL).parquet(path)


def _parts(values: bool):
    """For each document of each chunk: the part of its ids in the chunk, or only the part's crc32."""
    kind = pa.list_(pa.int64()) if values else pa.int64()
    names = ["shard", "start", "id", "n", "offset", "length", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = unpack(row["payload"]), []
                for doc in row["docs"]:
                    a, b = max(doc["start"], row["first"]), min(doc["start"] + doc["n"], row["first"] + row["n"])
                    part = ids[a - row["first"] : b - row["first"]]
                    rows.append((row["shard"], doc["start"], doc["id"], doc["n"], a - doc["start"], b - a, part.astype(np.int64) if values else zlib.crc32(part.tobytes())))
                types = [pa.int32(), *[pa.int64()] * 5, kind]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def _shard_starts(files: DataFrame) -> DataFrame:
    """(shard, base): ids before each shard. One small row a shard; the window runs over those."""
    sums = files.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, ids array<long>) of each document in the files; documents in several chunks are put together."""
    files = _files(spark, path)
    parts = files.mapInArrow(_parts(True), "shard int, start long, id long, n long, offset long, length long, part array<long>")
    whole = parts.groupBy("shard", "start").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return whole.join(_shard_starts(files), "shard").select("id", (F.col("base") + F.col("start")).alias("start"), "n", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"))


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of a text from those of its two parts and the byte length of the second one."""

    def times(matrix: list[int], vector: int) -> int:
        out = k = 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    # the operator that appends one zero bit, squared as the length asks
    step = [0xEDB88320, *(1 << k for k in range(31))]
    bits = 8 * length
    while bits:
        if bits & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        bits >>= 1
    return first ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            crc = parts[0]["part"]
            for part in parts[1:]:
                crc = crc32_joined(crc, part["part"], 4 * part["length"])
            out.append(crc)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "parts"]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(out, pa.int64())], names=[*(batch.schema.names[i] for i in keep), "crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, crc32) of each document in the files; the ids themselves are not moved."""
    files = _files(spark, path)
    names = ["shard", "start", "id", "n", "offset", "length", "part"]
    parts = Scratch(spark, "digests").save(files.mapInArrow(_parts(False), "shard int, start long, id long, n long, offset long, length long, part long").select(*names), "parts")
    whole = parts.filter("length = n").select("id", "shard", "start", "n", F.col("part").alias("crc32"))
    split = parts.filter("length < n").groupBy("shard", "start").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "length", "part"))).alias("parts"))
    joined = split.select("id", "shard", "start", "n", "parts").mapInArrow(_joined, "id long, shard int, start long, n long, crc32 long")
    return whole.union(joined).join(_shard_starts(files), "shard").select("id", (F.col("base") + F.col("start")).alias("start"), "n", "crc32")


def tokens_round_trip(docs: DataFrame, vocabulary: str, how: Files = Files(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return (id_col, start, n_tokens, ids_crc32) read back from them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.path("files")
    write_tokens(docs, path, vocabulary, how, 0, id_col, text_col)
    return token_digests(docs.sparkSession, path).select(F.col("id").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
