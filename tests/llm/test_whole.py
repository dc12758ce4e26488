"""Inputs on which an operator once did less than its whole job."""

import random
import re

import numpy as np
import pytest

from tarnwell.llm import decontaminate, kernels, license_scan, line_dedup, minhash_dedup, secret_scan, toxicity


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"word{r.randrange(400)}" for _ in range(n)]


def best_edits(item, text):
    """Fewest edits of an item to a stretch of a text."""
    of = {w: k for k, w in enumerate({*item, *text})}
    text, ramp = np.array([of[w] for w in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for k, w in enumerate(item):
        new = np.concatenate([[k + 1], np.minimum(row[:-1] + (text != of[w]), row[1:] + 1)])
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def edited(words, how, r):
    """A passage with a fifth of its words edited."""
    n, t = len(words), len(words) // 5
    if how == "head dropped":
        return words[t:]
    if how == "block replaced":
        at = r.randrange(n - t)
        return words[:at] + ["zzz"] * t + words[at + t :]
    within = n // 2 if how == "first half" else n
    out = [[w] for w in words]
    for at in r.sample(range(within), t):
        out[at] = r.choice([[], ["zzz"], [words[at], "zzz"]])
    return [w for x in out for w in x]


@pytest.mark.parametrize("how", ["evenly", "first half", "head dropped", "block replaced"])
def test_leaks_of_any_length_and_edits(how):
    r = random.Random(how)
    items = [prose(n, n) for n in (3, 5, 9, 15, 24, 40, 64, 128, 250, 400, 600, 1000)]
    texts = [prose(50, k) + edited(items[k % 12], how, r) + prose(30, k + 99) for k in range(36)]
    block = decontaminate.Items([(i, " ".join(x).encode()) for i, x in enumerate(items)], decontaminate.Decontamination())
    found = {(t, i): cost for t, i, cost, *_ in block.find([" ".join(x).encode() for x in texts])}
    want = {}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            cost = best_edits(item, text)
            if cost <= len(item) // 5:
                want[t, i] = cost
    assert len(want) >= 36 and found == want


def test_leaks_places_held_in_parts(monkeypatch):
    items = [prose(n, n) for n in (15, 30)]
    texts = [prose(20, k) + edited(items[k % 2], "evenly", random.Random(k)) for k in range(30)]
    block = decontaminate.Items([(i, " ".join(x).encode()) for i, x in enumerate(items)], decontaminate.Decontamination())
    whole = list(block.find([" ".join(x).encode() for x in texts]))
    monkeypatch.setattr(decontaminate, "HITS", 7)
    assert list(block.find([" ".join(x).encode() for x in texts])) == whole and len(whole) >= 30


def test_leaks_by_walks_alone():
    """Without the runs the walks find the same; places merge, so an item planted twice is one row of its best place."""
    r = random.Random(8)
    items = [prose(n, n) for n in (1, 4, 7, 15, 40, 100, 300)]
    texts = [prose(30, k) + edited(items[k % 7], "evenly", r) + prose(20, k + 99) + (items[k % 7] if k % 5 == 0 else []) for k in range(21)] + [[], ["word1"]]
    rows, texts = [(i, " ".join(x).encode()) for i, x in enumerate(items)], [" ".join(x).encode() for x in texts]
    alone = list(decontaminate.Items(rows, decontaminate.Decontamination(runs=False)).find(texts))
    assert alone == list(decontaminate.Items(rows, decontaminate.Decontamination()).find(texts)) and len(alone) >= 21
    assert list(decontaminate.Items(rows, decontaminate.Decontamination(runs=False)).find([])) == []


def test_walks_along_a_text_equal_those_of_its_windows():
    walks, value = decontaminate.Walks(12, decontaminate.Decontamination()), np.random.default_rng(1).integers(0, 9, 400).astype(np.uint64)
    starts = np.array([0, 1, 2, 7, 30, 31, 200, 388])
    assert (walks.along(value, starts) == walks.keys(value[starts[:, None] + np.arange(12)])).all()


def test_long_texts(spark):
    """Texts of megabytes, past the block size, hold what short ones hold."""
    filler = "some filler of no note at all, line after line\n" * 40_000
    item = " ".join(prose(30, 4))
    text = filler + item + " under the mit licence " + filler
    rows = spark.createDataFrame([(1, text), (2, "short\nof\nlines")], "doc_id long, text string")
    leak = decontaminate.benchmark_leaks(rows, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.edits, x.first_word) for x in leak] == [(1, 9, 0, 40_000 * 10)]
    notice = license_scan.license_notices(rows).filter("doc_id = 1").first()
    assert notice.labels == "mit" and notice.n_words == 80_000 * 10 + 30 + 4
    kept = {x.doc_id: x for x in line_dedup.remove_repeated_lines(rows).collect()}
    assert kept[1].n_removed == 39_999 + 39_999 and kept[2].text == "short\nof\nlines"


def test_own_columns_stay_without_counts(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc", 7, "x")], "doc_id long, text string, n_lines int, n_removed string")
    out = line_dedup.remove_repeated_lines(rows, counts=False)
    assert out.columns == rows.columns and [tuple(x) for x in out.collect()] == [(1, "a\nb\nc", 7, "x")]
    import corpus_pipeline

    assert [tuple(x) for x in corpus_pipeline.line_dedup_stage(spark, rows, "").collect()] == [(1, "a\nb\nc", 7, "x")]


def test_notices_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "Use of the Acme shared licence is free. Under the MIT license."), (2, None)], "doc_id long, text string")
    own = [license_scan.Notice("acme", "acme shared license", 1, base=True)]
    got = {x.doc_id: x for x in license_scan.license_notices(rows, notices=own).collect()}
    assert (got[1].labels, got[1].n_base, [tuple(s) for s in got[1].spans], got[2].labels) == ("acme", 0, [("acme", 3, 6, 1)], "")
    assert license_scan.license_notices(rows, notices=[]).filter("labels <> '' or score <> 0").isEmpty()
    for wrong in (license_scan.Notice("x", "Acme", 0), license_scan.Notice("x", "cc by", 3), license_scan.Notice("x", "", 0)):
        with pytest.raises(ValueError):
            license_scan.license_notices(rows, notices=[wrong])


@pytest.mark.parametrize("missed", [1.0, toxicity.Learning().missed])
def test_risk_at_the_weight_that_is_trained_with(missed):
    r = np.random.default_rng(6)
    rows = [np.flatnonzero(r.random(5) < 0.5) for _ in range(24)]
    word, owner, sides = np.concatenate(rows), np.repeat(np.arange(24), [len(x) for x in rows]), set()
    for _ in range(40):
        weight, prior = r.normal(0, 2, 6), float(r.uniform(0.05, 0.95))

        def parts(w):
            score = np.array([w[x].sum() + w[-1] for x in rows])
            toxic, clean = np.log(1 + np.exp(-score)), np.log(1 + np.exp(score))
            return missed * prior * toxic[:8].mean(), clean[8:].mean() - prior * clean[:8].mean()

        positive, negative, gradient = toxicity.risk(weight, word, owner, 8, 16, prior, missed=missed)
        assert (positive, negative) == pytest.approx(parts(weight))
        sides.add(negative >= 0)
        target = (lambda w: sum(parts(w))) if negative >= 0 else (lambda w: -parts(w)[1])
        for i in range(6):
            step = np.eye(6)[i] * 1e-6
            assert gradient[i] == pytest.approx((target(weight + step) - target(weight - step)) / 2e-6, abs=1e-6)
    assert sides == {True, False}


def changed(words, k, r):
    out = list(words)
    for at in r.sample(range(len(words)), k):
        out[at] = f"new{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_ids_with_several_texts(spark, seed):
    r = random.Random(seed)
    bases = [prose(60, 1000 * seed + k) for k in range(8)]
    rows = [(1, bases[0]), (1, bases[1]), (1, bases[2]), (1, bases[2]), (2, bases[2]), (9, bases[4]), (9, []), (10, []), (10, None), (3, changed(bases[1], 1, r)), (4, changed(bases[4], 2, r))]
    for k in range(120):  # similarity from 0.5 to 1, ids that repeat
        rows.append((r.randrange(5, 90), changed(r.choice(bases[3:]), r.choice([0, 1, 2, 4, 5, 6, 8]), r)))
    rows.append((-7, changed(bases[2], 2, r)))
    sets = [frozenset(zip(w, w[1:])) if w else frozenset() for _, w in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[high] = low
    texts = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(texts, minhash_dedup.MinHash(shingle=2)).collect())
    assert got == sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def test_secrets_beside_allowed_parts(spark):
    r = random.Random(6)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwyz0123456789+/") for _ in range(n))
    long = key(60) + "A" * 12 + key(60)
    texts = [long, "example/" + key(40), key(40) + "/sample", "x" * 30 + "0", "EXAMPLE" + key(12), key(30) + "dummy" + key(10)]
    k = secret_scan.CLASSES[2]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.secrets(rows).collect():
        text, hits = texts[row.doc_id], set()
        parts = [m.span() for m in re.finditer(secret_scan.ALLOWED, text)]
        for i in range(len(text) - k.window + 1):
            p = np.array([text[i : i + k.window].count(c) for c in set(text[i : i + k.window])]) / k.window
            if -(p * np.log2(p)).sum() >= k.bits and not any(a < i + k.window and b > i for a, b in parts):
                hits |= set(range(i, i + k.window))
        got = {x for s in row.spans.split(",") if s for x in range(*map(int, s.split(":")[1:]))}
        assert parts and got == hits and bool(hits) == (row.doc_id in (0, 1, 2, 5))


def linked_components(rows, least=80):
    """The brute-force answer of near_duplicates for rows (id, words), at two-word shingles."""
    sets = [frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([(x,) for x in w]) for _, w in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[high] = low
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def test_near_duplicates_in_long_lists(spark):
    """Three long lists whose members are mostly not linked, in blocks of four."""
    r = random.Random(8)
    rows = []
    for k in range(3):
        base = prose(60, 500 + k)
        for n in range(40):
            rows.append((len(rows), changed(base, r.choice([1, 3, 6, 8, 9, 10, 12]), r)))
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(texts, minhash_dedup.MinHash(shingle=2, block=4)).collect()))
    want = linked_components(rows)
    assert got == want and 6 < len({x[2] for x in want}) < 100


def test_words_of_periodic_letters():
    """Words that polynomial hashes modulo 2**64 cannot tell apart; words across blocks of eight bytes."""
    word = b"a"
    for _ in range(10):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    value, _ = kernels.word_lists([word + b" " + other + b" " + word])
    assert value[0] != value[1] and value[0] == value[2]
    words = [b"x" * n for n in range(1, 40)] + [b"x" * n + b"y" + b"x" * 8 for n in range(30)] + [b"x\x00", b"\x00x", b"z" * (kernels.LONG_WORD + 9)]
    value, _ = kernels.word_lists([b" ".join(words), b" ".join(words[::-1])])
    assert len(set(value.tolist())) == len(words) and (value[: len(words)] == value[len(words) :][::-1]).all()
    sets = minhash_dedup.shingle_sets([word + b" " + other, other + b" " + word], 1)
    assert len(sets[0]) == 2 and (sets[0] == sets[1]).all()
