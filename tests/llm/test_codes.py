"""Vector codes and quality scores against brute force and direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import quality, vector_codes

VECTORS = "vec_id long, embedding array<float>, label string, code string, error long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], VECTORS)


def by_hand(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with plain loops; rows: (id, vector) that are kept."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    ints = [[int(np.floor(float(np.float32(x)) * scale)) for x in v] for _, v in rows]
    size = len(ints[0]) // parts
    cut = [[x[p * size : (p + 1) * size] for p in range(parts)] for x in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda book, v: min((sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owner = [near(books[p], c[p])[1] for c in cut]
            for k in set(owner):
                mine = [c[p] for c, o in zip(cut, owner, strict=True) if o == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[near(books[p], c[p]) for p in range(parts)] for c in cut]
    return sorted(str((r[0], bytes(k for _, k in f), sum(d for d, _ in f))) for r, f in zip(rows, found, strict=True)), books


def test_codes_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, -0.25, 0.125, 0.3]) for _ in range(8)], r.choice(["a", "b", None])) for i in range(90)]
    rows += [(5, rows[5][1], "a"), (5, rows[6][1], "a"), (None, rows[7][1], "a")] + [(200 + i, rows[9][1], "hot") for i in range(60)]
    bad = [(-1, None, "a"), (-2, [], "a"), (-3, [float("nan")] + [0.1] * 7, "a"), (-4, [float("inf")] + [0.1] * 7, None), (-5, [None] + [0.1] * 7, "a"), (300, [0.1] * 4, "a"), (301, [0.1] * 7, "a"), (302, [1e9] * 8, "a")]
    how = vector_codes.Coding(parts=4, entries=20, fan=3)
    got = vector_codes.vector_codes(table(spark, rows + bad), how)
    want, books = by_hand([x[:2] for x in rows], 4, 20, 4, 1024)
    out = got.rows.collect()
    assert sorted(str((x.id, bytes(x.code), x.error)) for x in out) == want
    assert got.codebooks.tolist() == books
    total = {}
    for x in out:
        total[x.label] = total.get(x.label, 0) + x.error
    for small in (100_000, 0):  # labels broadcast, and dealt by salt
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vector_codes, "SMALL", small)
            rows_ = vector_codes.with_label_error(got.rows).collect()
        assert len(rows_) == len(out) and all(x.label_error == total[x.label] for x in rows_)


def test_codes_of_few_and_no_rows(spark):
    got = vector_codes.vector_codes(table(spark, [(2, [0.5, -0.0001], "a"), (1, [0.25, 0.25], None)]), vector_codes.Coding(parts=2))
    assert got.codebooks.tolist() == [[[256], [512]], [[256], [-1]]]
    assert sorted((x.id, bytes(x.code), x.error) for x in got.rows.collect()) == [(1, b"\0\0", 0), (2, b"\1\1", 0)]
    got = vector_codes.vector_codes(table(spark, []))
    assert got.rows.count() == 0 and got.codebooks.size == 0 and len(got.digest()) == 64
    assert vector_codes.with_label_error(got.rows).count() == 0


@pytest.mark.parametrize("spread", [3, 40, 1 << 24])
def test_tree_against_all_entries(spread):
    """Ties, equal entries, and components whose squares leave the exact range of doubles."""
    r = np.random.default_rng(spread)
    book, q = r.integers(-spread, spread, (256, 5)), r.integers(-spread, spread, (700, 5))
    book[7:40] = book[3]
    for fan in (2, 8, 16):
        entry, far, _ = vector_codes.nearest(book, vector_codes.build(book, fan), q)
        every = ((q[:, None] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (far == every.min(1)).all()


def test_tree_rules_out_subtrees():
    """On entries in tight groups most distances are never computed."""
    r = np.random.default_rng(1)
    book = (r.integers(-9000, 9000, (16, 4))[:, None] + r.integers(-9, 9, (16, 16, 4))).reshape(-1, 4)
    q = book[r.integers(0, 256, 2000)] + r.integers(-3, 3, (2000, 4))
    entry, _, compared = vector_codes.nearest(book, vector_codes.build(book, 16), q)
    assert (entry == ((q[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
    assert compared < 0.25 * 256 * len(q)


# quality


def words(r, vocabulary, n):
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    """Texts over two vocabularies, the labels in the order of ids."""
    r = random.Random(7)
    good, bad = ([f"{a}{r.randrange(9999)}" for _ in range(300)] for a in "gb")
    rows = [(i, words(r, good if i % 3 else bad, 60 + i % 50), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, score string, lang string")
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_quality_of_held_out_rows(judged):
    docs, labels, truth = judged
    model = quality.train(docs, labels)
    out = quality.quality(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert 60 < len(held) < 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    turned = labels.withColumn("quality", F.when(quality.held_out(quality.Learning()), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, turned) == model  # labels of held-out rows are not looked at
    moved = docs.repartition(7, "text").withColumn("lang", F.lit("z"))
    assert quality.train(moved, labels.repartition(3)) == model


def test_quality_odd(spark, judged, odd, none):
    docs, labels, _ = judged
    model = quality.train(docs, labels.union(labels.limit(9)).unionByName(spark.createDataFrame([(None, 1, 0), (7, None, 0), (10**9, 1, 0)], labels.schema)))
    rows = quality.quality(odd, model).collect()
    assert len(rows) == 12
    empty = {r.score for r in rows if r.doc_id in (2, 3)}
    assert len(empty) == 1 and all(r.held_out for r in rows if r.doc_id is None)
    assert [r.score for r in rows if r.doc_id == 6][0] == [r.score for r in rows if r.doc_id == 6][1]
    assert quality.quality(none, model).count() == 0
    share = quality.quality(docs, quality.train(none, labels)).select("score").distinct().collect()
    assert [r.score for r in share] == [0.5]  # no labelled text: no share either
    good = quality.train(docs, labels.filter("quality = 1"))
    assert quality.quality(docs, good).filter("predicted = 0").count() == 0


def test_quality_of_a_long_text(judged):
    """The feature of a text of megabytes is that of its blocks, all of them."""
    docs, labels, _ = judged
    model = quality.train(docs, labels)
    part = docs.filter("doc_id = 1").first().text.encode()
    text = (part + b" ") * 6000
    sizes = [sum(len(c.compress(text[k : k + 4096])) for k in range(0, len(text), 4096)) for c in (quality._compressor(x, model.how) for x in (model.good, model.bad))]
    assert len(text) > 2_000_000 and model.feature(text) == (sizes[1] - sizes[0]) / sum(sizes)


def test_curve_against_gradient():
    r = np.random.default_rng(2)
    x = r.normal(size=500)
    y = r.random(500) < 1 / (1 + np.exp(-(2 * x - 0.5)))
    slope, shift = quality.curve(x, y)
    n1, n0 = y.sum(), (~y).sum()
    gap = 1 / (1 + np.exp(-(slope * x + shift))) - np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    assert abs(gap.sum()) < 1e-2 and abs((gap * x).sum()) < 1e-2
    assert quality.curve(np.zeros(4), np.array([True, True, False, True]))[0] == 0.0
