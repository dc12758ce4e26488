"""SentencePiece ids of texts with merge-type (BPE) vocabularies, and back.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make, ties
from the left, and merges until no pair makes a piece. Merges cannot cross a place where white
space follows another character, nor a line feed, if no piece of the vocabulary does; the text is
cut there, and what a segment becomes is remembered. In each Arrow batch, the segments met for the
first time are checked against the sentencepiece library in one call; were one to differ, the job
fails with the segment (``strict``, the default), or the library's ids are taken and the codec's
``disagreements`` counts it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pieces
from .scratch import arrow_batches

REMEMBERED = 250_000  # segments in each of two generations
SHORT = 24  # characters up to which segments share a step
_NEVER = np.iinfo(np.int32).max
_SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one model file. Models that rewrite their input are refused."""

    def __init__(self, path: str, strict: bool = True):
        import sentencepiece

        self.strict, self.disagreements = strict, 0

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i))]
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in usual}, reverse=True))}
        self.rank = {pieces[i].replace(_SPACE, " "): order[lib.get_score(i)] for i in usual}
        self.ids = {pieces[i].replace(_SPACE, " "): i for i in usual}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.raw = [b"" if lib.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if lib.is_byte(i) else pieces[i].replace(_SPACE, " ").encode() for i in range(n)]
        if lib.normalize("a  b ") != f"{_SPACE}a{_SPACE * 2}b{_SPACE}" or lib.normalize("ﬁ") != f"{_SPACE}ﬁ":
            raise ValueError("the model's text normalisation is not supported")
        if any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("pieces that join words or lines are not supported")
        self._tables(pieces, usual, order)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _tables(self, pieces: list[str], usual: list[int], order: dict[float, int]) -> None:
        """Symbols as numbers: single characters by code point, and which two symbols make a piece."""
        letters = {c for p in self.ids for c in p}
        number = dict(self.ids)
        for c in sorted(letters - number.keys()):  # characters of pieces that are no piece themselves
            number[c] = len(pieces) + len(number) - len(self.ids)
        self.by_code = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.by_code[ord(c)] = number[c]
        joins = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    joins[a << 20 | b] = (self.rank[piece], i)
        self.join_keys = np.array(sorted(joins) + [np.iinfo(np.int64).max], dtype=np.int64)
        self.join_ranks = np.array([joins[k][0] for k in sorted(joins)] + [_NEVER], dtype=np.int32)
        self.join_ids = np.array([joins[k][1] for k in sorted(joins)] + [-1], dtype=np.int32)
        self.n_pieces = len(pieces)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two symbols make; _NEVER where they make none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << 20 | right, -1)
        at = np.searchsorted(self.join_keys, key)
        hit = self.join_keys[at] == key
        return np.where(hit, self.join_ranks[at], _NEVER), self.join_ids[at]

    def agendas(self, segments: list[str]) -> list[bytes]:
        """Ids of many short segments at once, as little-endian int32: each step takes the first of every agenda."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        width = int(lengths.max()) + 2
        inside = np.arange(width) < lengths[:, None]
        symbol = np.full((len(segments), width), -2, np.int32)  # -2: behind the end, -1: in no piece
        symbol[inside] = self.by_code[codes]
        final = symbol.copy()
        rows = np.arange(len(segments))
        rank = np.full((len(segments), width), _NEVER, np.int32)
        piece = np.full((len(segments), width), -1, np.int32)
        rank[:, :-1], piece[:, :-1] = self._pairs(symbol[:, :-1], symbol[:, 1:])
        column = np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            line = np.arange(len(rows))
            going = rank[line, best] < _NEVER
            if not going.all():
                final[rows[~going]] = symbol[~going]
                rows, symbol, rank, piece, best = rows[going], symbol[going], rank[going], piece[going], best[going]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            joined = piece[line, best]
            shift = np.minimum(column + (column > best[:, None]), width - 1)
            symbol = np.take_along_axis(symbol, shift, 1)
            symbol[line, best] = joined
            shift = np.minimum(column + (column >= best[:, None]), width - 1)
            rank, piece = np.take_along_axis(rank, shift, 1), np.take_along_axis(piece, shift, 1)
            rank[line, best], piece[line, best] = self._pairs(joined, symbol[line, best + 1])
            before = np.flatnonzero(best > 0)
            k = best[before] - 1
            rank[before, k], piece[before, k] = self._pairs(symbol[before, k], joined[before])
        # symbols that are no pieces become bytes
        out = []
        odd = ((final == -1) | (final >= self.n_pieces)).any(axis=1)
        counts = (final != -2).sum(axis=1)
        flat = final.astype("<i4")
        for i, (n, strange) in enumerate(zip(counts.tolist(), odd.tolist(), strict=True)):
            out.append(np.array(self.agenda(segments[i]), "<i4").tobytes() if strange else flat[i, :n].tobytes())
        return out

    def agenda(self, text: str) -> list[int]:
        """Ids of one segment by score-ordered merging of adjacent symbols."""
        rank, n = self.rank, len(text)
        parts, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                pairs.append((r, i, i + 1, 2))
        heapify(pairs)
        while pairs:
            _, i, j, size = heappop(pairs)
            left, right = parts[i], parts[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            joined = parts[i] = left + right
            parts[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(joined + parts[k])
                if r is not None:
                    heappush(pairs, (r, i, k, size + len(parts[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(parts[h] + joined)
                if r is not None:
                    heappush(pairs, (r, h, i, len(parts[h]) + size))
        out = []
        for part in parts:
            if part:
                i = self.ids.get(part)
                if i is not None:
                    out.append(i)
                elif self.byte_ids:
                    out.extend(self.byte_ids[b] for b in part.encode("utf-8", "replace"))
                else:
                    out.append(self.unknown)
        return out

    def _checked(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of new segments, each compared with the library's."""
        # the library puts a blank before a text; a segment that begins without one stands behind a line feed
        texts = [x[1:] if x[0] == " " else "\n" + x for x in segments]
        want = self.library.encode(texts, num_threads=1)
        lead = len(self.library.encode("\n"))
        own: dict[str, bytes] = {}
        short = sorted((x for x in segments if len(x) <= SHORT), key=len)
        for at in range(0, len(short), 2048):
            some = short[at : at + 2048]
            own.update(zip(some, self.agendas(some), strict=True))
        for segment, ids in zip(segments, want, strict=True):
            mine = own.get(segment)
            if mine is None:
                mine = np.array(self.agenda(segment), dtype="<i4").tobytes()
            right = array("i", ids if segment[0] == " " else ids[lead:]).tobytes()
            if mine != right and segment != " ":  # of a lone blank the library is given nothing
                self.disagreements += 1
                if self.strict:
                    raise ValueError(f"the agenda gives other ids than the library for {segment[:80]!r}")
                mine = right
            own[segment] = mine
        return own

    _cut = re.compile(r"\n| +[^ \n]*|[^ \n]+")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        cut = [self._cut.findall((" " + x).replace(_SPACE, " ")) if x else [] for x in texts]
        new, old = self.new, self.old
        fresh = dict.fromkeys(set().union(*cut).difference(new))
        for x in fresh:
            fresh[x] = old.get(x)
        missing = [x for x, known in fresh.items() if known is None]
        if missing:
            fresh.update(self._checked(missing))
        new.update(fresh)
        tail, of = array("i", [self.end]).tobytes(), new.__getitem__
        out = [np.frombuffer(b"".join(map(of, segments)) + tail, "<i4") for segments in cut]
        for x in missing:
            if len(x) > 2 * SHORT:
                del new[x]
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, as the library's decode(ids)."""
        raw, every = self.raw, ids.tolist()
        if not every:
            return ""
        if min(every) < 0 or max(every) >= len(raw) or self.unknown in every or self.end in every[:-1]:
            return self.library.decode(every)
        try:
            out = b"".join([raw[i] for i in every]).decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode(every)
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    """The codec of a model file, one for each Python worker."""
    return PieceCodec(path)


def _encode(path: str, text_col: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = batch.schema.get_field_index(text_col), codec(path)
            texts = [x or "" for x in batch.column(at).to_pylist()]
            rows = [ids for part in pieces(texts) for ids in own.encode(texts[part])]
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))
            rest = [i for i in range(batch.num_columns) if i != at]
            more = [pa.array([own.decode(x) for x in rows], pa.string())] if decoded else []
            yield pa.record_batch([*(batch.column(i) for i in rest), ids, *more], names=[*(batch.schema.names[i] for i in rest), "ids", *["decoded"] * decoded])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            rows = [codec(path).decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(rows, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``ids`` array<int> (end id included) in place of ``text_col``.

    path: model file, at the same place on every executor. decoded: add the text of the ids as
    column ``decoded``, in the same pass. Null and empty texts have the end id alone. Repeated rows
    are each encoded; columns named like the added ones are replaced.
    """
    arrow_batches(docs.sparkSession)
    added = ("ids", "decoded") if decoded else ("ids",)
    rest = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>", *["decoded string"] * decoded])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], text_col).mapInArrow(_encode(path, text_col, decoded), schema)


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """The rows of ``rows`` with the text of ``ids`` as column ``decoded``; null ids give an empty text."""
    arrow_batches(rows.sparkSession)
    rest = [f for f in rows.schema.fields if f.name != "decoded"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "decoded string"])
    return rows.select(*[F.coalesce("ids", F.array().cast("array<int>")).alias("ids") if f.name == "ids" else F.col(f"`{f.name}`") for f in rest]).mapInArrow(_decode(path), schema)
