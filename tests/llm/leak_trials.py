"""Recall and cost of the search for benchmark items, with and without its prefilter: python tests/llm/leak_trials.py [documents.parquet benchmark.parquet].

For each length of an item, passages with exactly 20 % of the words edited (spread evenly or at random;
replaced, dropped and added words in equal parts) are planted in texts of other words. Given two
tables, the steps over their documents are counted too.
"""

import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from tarnwell.llm import decontaminate  # noqa: E402

LENGTHS = (5, 9, 15, 20, 30, 40, 60, 100, 200, 400, 1000)
WITH, WITHOUT = decontaminate.Decontamination(), decontaminate.Decontamination(runs=False)


def edited(words, t, rng, evenly):
    out = list(words)
    at = np.linspace(0, len(out) - 1, t).astype(int) if evenly else np.sort(rng.choice(len(out), t, replace=False))
    for n, k in reversed(list(enumerate(at))):
        new = [] if n % 3 == 1 else [f"new{rng.integers(1 << 40)}"]
        out[k : k + 1] = new + ([out[k]] if n % 3 == 2 else [])
    return out


def trial(n, tries, seed=3):
    """(found with the prefilter, without it, tries) for items of ``n`` words."""
    rng = np.random.default_rng((seed, n))
    items = [[f"w{x}" for x in rng.integers(0, 20_000, n)] for _ in range(tries)]
    texts = []
    for i, item in enumerate(items):
        around = [f"v{x}" for x in rng.integers(0, 20_000, 60)]
        texts.append(" ".join(around[:30] + edited(item, n * WITH.percent // 100, rng, i % 2) + around[30:]).encode())
    rows = [(i, " ".join(x).encode()) for i, x in enumerate(items)]
    return *(len({t for t, i, *_ in decontaminate.Items(rows, how).find(texts) if t == i}) for how in (WITH, WITHOUT)), tries


def tables(documents, benchmark):
    """What each step leaves over the documents, and seconds of one core with and without the prefilter."""
    import pyarrow.parquet as pq

    texts = [x.encode() for x in pq.read_table(documents, columns=["text"])["text"].to_pylist() if x]
    rows = [(r["item_id"], r["text"].encode()) for r in pq.read_table(benchmark, columns=["item_id", "text"]).to_pylist() if r["text"] and r["item_id"] is not None]
    for how in (WITH, WITHOUT):
        items, counts = decontaminate.Items(rows, how), {}
        inner, apart, distance = items._candidates, items._apart, items._distance

        def candidates(value, places):
            out = inner(value, places)
            counts["stretches"] = counts.get("stretches", 0) + len(out)
            return out

        def far(item, text):
            counts["candidates"] = counts.get("candidates", 0) + 1
            return apart(item, text)

        def exact(item, text):
            counts["measured"] = counts.get("measured", 0) + 1
            return distance(item, text)

        items._candidates, items._apart, items._distance = candidates, far, exact
        begin = time.process_time()
        counts["found"] = sum(1 for _ in items.find(texts))
        print("prefilter" if how.runs else "walks alone", counts, f"{time.process_time() - begin:.1f} s for {sum(map(len, texts)) / 1e6:.1f} MB")


if __name__ == "__main__":
    for n in LENGTHS:
        print(n, "words: found %d with the prefilter, %d by walks alone, of %d" % trial(n, 60 if n <= 100 else 20 if n <= 400 else 10), flush=True)
    if len(sys.argv) > 2:
        tables(*sys.argv[1:3])
