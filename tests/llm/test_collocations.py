"""Phrase mining against brute force; double-array tries against dictionaries."""

import glob
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tarnwell.llm import collocations as mining
from tarnwell.llm.double_array import build, digits_of


def by_hand(rows, how):
    """{(lang, rank): (phrase, a, l, r, n, score)} with dictionaries; rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    often = {k: a for k, a in f.items() if a >= how.least and len(k[1]) > 1}
    covered = {}
    for (lang, ws), a in often.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                covered[lang, ws[i : i + k]] = max(a, covered.get((lang, ws[i : i + k]), 0))
    out = {}
    for lang in {k[0] for k in often}:
        kept = []
        for (y, ws), a in often.items():
            if y == lang and 100 * covered.get((y, ws), 0) < how.within * a:
                score, _, left, right = min((2000000 * a // (f[y, ws[:k]] + f[y, ws[k:]]), k, f[y, ws[:k]], f[y, ws[k:]]) for k in range(1, len(ws)))
                kept.append((-score, -a, " ".join(ws).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[: how.top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def mined(spark, rows, how):
    docs = spark.createDataFrame([(t, y, 0, "x") for t, y in rows], "text string, lang string, n long, word string")
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in mining.collocations(docs, how).collect()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocabulary = ["New", "york", "city", "of", "the", "état", "ünï", "x\x01y", "日本", "a-b", "zz"]
    rows = []
    for i in range(260):
        words = [r.choice(vocabulary[: 5 + i % 7]) for _ in range(r.randrange(40))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", " : "]) for w in words)
        rows.append((text, r.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (" \n.;", None), ("of the of the of the of the", "en")] + [("Same words again and again. same words", "de")] * 40


@pytest.mark.parametrize("block", [500_000, 12])
def test_mining_brute_force(spark, texts, block):
    """In one trie, and in many blocks of few entries each."""
    how = mining.Mining(least=8 if block > 100 else 4, top=60, block=block)
    rows = texts if block > 100 else texts[:50] + texts[-45:]
    got, want = mined(spark, rows, how), by_hand(rows, how)
    assert len(want) > 20 and any(len(v[0].split(" ")) == 4 for v in want.values())
    assert got == want


def test_mining_of_repeated_rows_and_of_one_long_row(spark, texts):
    """Twice the rows and twice the least count give the same phrases; the texts of a language can be one."""
    how = mining.Mining(least=8, top=2000)
    want = by_hand(texts, how)
    assert mined(spark, texts * 2, mining.Mining(least=16, top=2000)).keys() == want.keys()
    assert mined(spark, [(" ".join(t or "" for t, y in texts if y == "en"), "en")], how) == by_hand([(" ".join(t or "" for t, y in texts if y == "en"), "en")], how)


def test_mining_of_a_long_text(spark):
    """A text of megabytes is cut into blocks, within which and across which phrases are counted; a word can be longer than a block."""
    text = ("one two three four. five six " * 60_000) + "x" * 1_200_000 + " one two"
    how = mining.Mining(least=30)
    assert len(text) > 2_500_000
    assert mined(spark, [(text, "en")], how) == by_hand([(text, "en")], how)


def test_mining_odd(spark, odd, none):
    assert mining.collocations(none).count() == 0
    assert mining.collocations(odd).count() == 0  # nothing occurs 30 times with the same neighbour
    rows = [("x" * 3000 + " tail",)] * 31
    got = mining.collocations(spark.createDataFrame(rows, "text string").selectExpr("text", "cast(null as string) as lang")).collect()
    assert [(r.lang, r.a, r.l, r.r, r.n, r.score) for r in got] == [("und", 31, 31, 31, 62, 1000000)]


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([([1], 9_000_000_000_000_000_000), ([2], 9_000_000_000_000_000_001), ([1, 2], 9_000_000_000_000_000_000)], "w array<int>, a long")
    got = mining.scored(rows, 80).collect()
    assert [r.score for r in got] == [2000000 * 9_000_000_000_000_000_000 // 18_000_000_000_000_000_001]


def test_double_array_of_strings():
    r = random.Random(1)
    keys = sorted({"".join(r.choice("abcdefgéüx") for _ in range(r.randrange(1, 9))).encode() for _ in range(5000)} | {b"z" * 700, *(bytes([c]) for c in range(1, 256) if c != 32)})
    trie = build(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64))
    asked = [x for x in keys + [k + b"a" for k in keys] + [k[:-1] for k in keys] if x]
    start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in asked])[:-1]])
    got = trie.strings(np.frombuffer(b" ".join(asked), np.uint8), start, start + [len(x) for x in asked])
    place = {k: i for i, k in enumerate(keys)}
    assert got.tolist() == [place.get(x, -1) for x in asked]
    assert trie.after(b"z" * 3) > 0 and trie.after(b"zy") == -1 and trie.after(b"") == 0


@pytest.mark.parametrize(("highest", "n", "size"), [(5, 40, 2), (3000, 20_000, 2), (100_000, 20_000, 3), (60, 4000, 4)])
def test_double_array_of_numbers(highest, n, size):
    r = np.random.default_rng(highest)
    draw = lambda *shape: (highest * r.random(shape) ** 2).astype(np.int32)
    rows = np.unique(draw(n, size) + 1, axis=0)
    digits = max(1, -(-int(highest).bit_length() // 6))
    ids = np.concatenate([draw(5000), rows[: n // 8].ravel(), [0, 1]]).astype(np.int32)
    hit = build(*digits_of(rows, digits)).windows(ids, size, digits)
    place = {tuple(x): i for i, x in enumerate(rows.tolist())}
    assert hit.tolist() == [place.get(tuple(ids[i : i + size].tolist()), -1) for i in range(len(ids))]
    assert (hit >= 0).sum() >= n // 8 * 0.5


def test_blocks_are_ranges_and_are_walked_from_their_own_words(spark):
    """Full blocks in order, each with the span of its first numbers; all blocks together walk what one trie walks."""
    how = mining.Mining(block=40)
    miner = mining._Miner(spark.createDataFrame([("x", "en")], "text string, lang string"), how, "text", "lang")
    rows = sorted({(a, b) for a in range(1, 21) for b in range(1, 8) if (a * b) % 3})
    table = spark.createDataFrame(rows, "w0 int, w1 int")
    ids = np.random.default_rng(3).integers(0, 23, 4000).astype(np.int32)
    got, sizes, spans, starts = [], [], [], 0
    for trie, span, phrases in miner.tries(table, len(rows), 2, 1):
        at, hit = trie.value.places(ids, 2, 1, span)
        assert np.all((ids[at] >= span[0]) & (ids[at] <= span[1]))
        starts += int(((ids >= span[0]) & (ids <= span[1])).sum())
        got += [(int(i), *phrases.value[h].tolist()) for i, h in zip(at, hit, strict=True) if h >= 0]
        sizes.append(len(phrases.value))
        spans.append(span)
    assert sizes == [40] * (len(rows) // 40) + [len(rows) % 40]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert starts < 2 * len(ids)  # not once for each block
    known = set(rows)
    assert sorted(got) == [(i, *x) for i, x in enumerate(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)) if x in known]


def test_numbers_lie_in_row_groups_of_few_rows(spark):
    """A reader holds up to 4,096 rows of a row group at once, and a row has the texts of a batch."""
    docs = spark.range(40 * 512).selectExpr("'of the ' as text", "'en' as lang").coalesce(1)
    miner = mining._Miner(docs, mining.Mining(), "text", "lang")
    words = miner.words()
    miner.numbers(words, words.count())
    (file,) = glob.glob(f"{miner.scratch.root.removeprefix('file://')}/*-numbers/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 40 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 16


def test_packed_counts():
    places, counts = np.array([0, 3, 70_000, 1 << 20]), np.array([1, 30, 70_000, 2])
    got = mining._unpacked(mining._packed(places, counts))
    assert got[0].tolist() == places.tolist() and got[1].tolist() == counts.tolist()
    assert [x.tolist() for x in mining._unpacked(mining._packed(places[:0], counts[:0]))] == [[], []]
