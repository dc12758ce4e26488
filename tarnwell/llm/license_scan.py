"""Short licence notices in whole texts: exact places, and places with a bounded number of edits.

A text is lower-cased (A-Z) and reduced to its words joined by one blank. Exact places of a phrase
are found by its bytes. For places with up to k edits, the phrase is split into k + 1 seeds: k edits
cannot touch all of them (pigeonhole), so one seed stands there unchanged. Each seed found opens a
window of the phrase's length and k characters on both sides, in which the regex library's
bounded-error matching looks for the whole phrase; a hit is reported with its words and edits.
Digits of a phrase never match with edits: version 1 is not a misspelt version 2.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words, its label, the edits allowed; base: its exact places are counted."""

    label: str
    phrase: str
    edits: int
    base: bool = False


# Phrases of short notices, their labels, and edits (about one in ten characters, at most 4).
NOTICES = (
    Notice("mit", "under the mit license", 2, base=True),
    Notice("apache-2", "apache license version 2", 2, base=True),
    Notice("cc-by-nc", "cc by nc", 0, base=True),
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nd", "creative commons attribution noderivs", 3),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc0", "cc0 1 0 universal", 0),
    Notice("apache-2", "licensed under the apache license", 3),
    Notice("mit", "provided as is without warranty of any kind", 4),
    Notice("bsd", "nor the names of its contributors", 3),
    Notice("bsd", "this list of conditions and the following disclaimer", 4),
    Notice("isc", "to use copy modify and or distribute", 3),
    Notice("zlib", "without any express or implied warranty", 3),
    Notice("unlicense", "free and unencumbered software", 3),
    Notice("bsl-1", "boost software license version 1", 2),
    Notice("artistic-2", "artistic license 2", 1),
    Notice("lgpl", "gnu library general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("gpl-2", "gnu general public license version 2", 3),
    Notice("gpl-3", "gnu general public license version 3", 3),
    Notice("gfdl", "gnu free documentation license", 3),
    Notice("epl", "eclipse public license", 2),
    Notice("cddl", "common development and distribution license", 4),
    Notice("cpl", "common public license", 2),
    Notice("eupl", "european union public licence", 2),
    Notice("ms-pl", "microsoft public license", 2),
    Notice("psf", "python software foundation license", 3),
    Notice("ofl", "sil open font license", 2),
    Notice("odbl", "open database license", 2),
    Notice("lppl", "latex project public license", 2),
    Notice("cecill", "cecill free software license agreement", 3),
    Notice("w3c", "w3c software notice and license", 3),
    Notice("unicode", "unicode license agreement", 2),
    Notice("openssl", "openssl license", 1),
    Notice("postgresql", "postgresql license", 1),
)


def words_joined(text: bytes) -> tuple[bytes, int]:
    """The words of a text joined by one blank, and their number."""
    words = text.translate(_PLAIN).split()
    return b" ".join(words), len(words)


class Finder:
    """Search of one notice."""

    def __init__(self, notice: Notice):
        self.notice = notice
        self.needle = b" " + notice.phrase.encode() + b" "
        loose = notice.phrase.rstrip("0123456789 ") if notice.edits else ""
        fixed = notice.phrase[len(loose) :]
        k = notice.edits
        cuts = [len(loose) * i // (k + 1) for i in range(k + 2)]
        self.seeds = [(a, loose[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if k else []
        self.fuzzy = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(loose, literal_spaces=True)}){{e<={k}}}{regex.escape(fixed, literal_spaces=True)}(?![^ ])") if k else None

    def exact(self, padded: bytes) -> Iterator[int]:
        """Offsets of the blank before each exact place."""
        at = padded.find(self.needle)
        while at >= 0:
            yield at
            at = padded.find(self.needle, at + 1)

    def near(self, padded: bytes, known: set[int]) -> dict[tuple[int, int], int]:
        """(begin, end) byte offsets -> edits of places with 1 to k edits, seeds of exact places left out."""
        found: dict[tuple[int, int], int] = {}
        k, size, done = self.notice.edits, len(self.notice.phrase), set()
        for offset, seed in self.seeds:
            at = padded.find(seed)
            while at >= 0:
                begin = at - offset
                if begin - 1 not in known and begin not in done:
                    done.add(begin)
                    # k characters of margin, of up to four bytes each, cut between characters
                    a, b = max(0, begin - 4 * k - 1), min(len(padded), begin + size + 4 * k + 1)
                    while padded[a] & 0xC0 == 0x80:
                        a -= 1
                    while b < len(padded) and padded[b] & 0xC0 == 0x80:
                        b += 1
                    hit = self.fuzzy.search(padded[a:b].decode("utf-8", "replace"))
                    if hit and sum(hit.fuzzy_counts):
                        x = a + len(hit.string[: hit.start()].encode())
                        y = x + len(hit.group().encode())
                        if x - 1 not in known:
                            found[x, y] = min(found.get((x, y), k), sum(hit.fuzzy_counts))
                at = padded.find(seed, at + 1)
        return found


_FINDERS = [Finder(x) for x in NOTICES]


def scan(text: bytes, finders: list[Finder] = _FINDERS) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text.

    spans: (label, first word, behind the last word, edits) in order. score: 1 for an exact place,
    else the largest share of a phrase's characters left unedited, 0 without a place.
    """
    joined, n_words = words_joined(text)
    padded = b" " + joined + b" "
    starts, spans, base = [], [], set()

    blanks: list[np.ndarray] = []

    def word(at: int) -> int:
        """Blanks before ``at``; their places are found once, for texts with many notices."""
        if not blanks:
            blanks.append(np.flatnonzero(np.frombuffer(padded, np.uint8) == 32))
        return int(np.searchsorted(blanks[0], at))

    for finder in finders:
        notice = finder.notice
        known = set()
        for at in finder.exact(padded):
            known.add(at)
            first = word(at)
            spans.append((notice.label, first, first + notice.phrase.count(" ") + 1, 0, 1.0))
            if notice.base:
                starts.append(first)
                base.add(notice.label)
        if finder.seeds:
            for (x, y), edits in finder.near(padded, known).items():
                first = word(x - 1)
                spans.append((notice.label, first, first + padded.count(b" ", x, y) + 1, edits, 1 - edits / len(notice.phrase)))
    spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))
    labels = sorted({s[0] for s in spans})
    return (
        n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels),
        max((s[4] for s in spans), default=0.0), [{"label": s[0], "first": s[1], "end": s[2], "edits": s[3]} for s in spans],
    )


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
_OUT = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
]
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long, edits: long>>"


@lru_cache(maxsize=8)
def _finders(notices: tuple[Notice, ...]) -> list[Finder]:
    """The searches of a list of notices, built once for each Python worker."""
    for notice in notices:
        if notice.edits < 0 or notice.phrase.encode() != words_joined(notice.phrase.encode())[0] or len(notice.phrase.rstrip("0123456789 ")) <= 2 * notice.edits:
            raise ValueError(f"a phrase is words of small letters and digits, longer than two characters an edit: {notice}")
    return [Finder(x) for x in notices]


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finders = _finders(notices)
            rows = [scan(x or b"", finders) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_OUT))], names=["id", *(n for n, _ in _OUT)])

    return run


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Iterable[Notice] = NOTICES) -> DataFrame:
    """One row a document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    notices: the phrases to look for, in any number; one that no text can match raises ValueError.
    Null texts count as empty: no words, no labels ('' and '[]'), score 0. Null ids and repeated
    rows are each scanned and returned. Other columns are ignored. Rows stay where they are read:
    there is no exchange.
    """
    arrow_batches(docs.sparkSession)
    notices = tuple(notices)
    _finders(notices)  # refused before the job, not in it
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(notices), f"id long, {_DDL}").withColumnRenamed("id", id_col)
