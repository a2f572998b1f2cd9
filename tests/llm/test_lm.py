"""The language model against plain Python: counts, weights and scores, at one and at several levels of the exchange."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tesela.llm import lm

SCHEMA = "doc_id long, text string, learn string, block string, part int, words long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, "Same " * 3000), (5, rows[5][1]), (5, rows[5][1]), (None, "w1 W1\tw2")]


def tokens(text):
    return re.findall(r"[^ \t-\r]+", (text or "").lower()) + [None]


def bucket(count):
    return min(math.floor(math.log2(count)) + 1, lm.BUCKETS - 1) if count >= 1 else 0


def brute_scores(rows, learns):
    train = [tokens(t) for i, t in rows if learns(i)]
    word, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    total, distinct = sum(word.values()), len(word)
    held = defaultdict(list)
    for t in train:
        for v, w in zip([None, *t], t):
            rest = word[v] - 1
            f2 = (pair[v, w] - 1) / rest if rest else 0.0
            held[bucket(rest)].append((f2, (word[w] - 1) / max(total - 1, 1), 1 / (distinct + 1)))
    weights = {}
    for b, estimates in held.items():
        a = [1 / 3] * 3
        for _ in range(lm.EM_ROUNDS):
            new = [0.0] * 3
            for f in estimates:
                mixed = sum(x * y for x, y in zip(a, f))
                for k in range(3):
                    new[k] += a[k] * f[k] / mixed / len(estimates)
            a = new
        a[2] = max(a[2], 1e-6)
        weights[b] = [x / sum(a) for x in a]
    nearest = lambda b: weights[min(weights, key=lambda x: (abs(x - b), x))]
    out = []
    for i, t in rows:
        score = 0.0
        for v, w in zip([None, *tokens(t)], tokens(t)):
            a2, a1, a0 = nearest(bucket(word[v]))
            if not word[v]:
                a1, a2 = a1 + a2, 0.0
            f2 = pair[v, w] / word[v] if word[v] else 0.0
            score += math.log10(a2 * f2 + a1 * word[w] / total + a0 / (distinct + 1))
        out.append((str(i), score))
    return sorted(out)


@pytest.mark.parametrize("fan", [2048, 3, 2])
def test_scores_equal_brute_force(spark, fan):
    rows = corpus()
    learns = lambda i: (1 if i is None else i) % 3 != 0
    out = lm.lm_scores(frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0, fan=fan).collect()
    got, want = sorted((str(r.doc_id), r.score) for r in out), brute_scores(rows, learns)
    assert [i for i, _ in got] == [i for i, _ in want]
    # Estimates are rounded to an eighth and a quarter of a power of two while the weights are learned.
    assert all(abs(a - b) < 0.01 * abs(b) + 1e-9 for (_, a), (_, b) in zip(got, want))


def test_levels_and_part_sizes_change_nothing(spark):
    rows = corpus(4)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    results = [
        sorted(map(str, lm.lm_scores(frame(spark, rows), learn, part_bytes=size, fan=fan).collect()))
        for size, fan in ((1 << 30, 2048), (1000, 4), (700, 2048))
    ]
    assert results[0] == results[1] == results[2]


def test_no_training_row_and_no_row(spark):
    out = lm.lm_scores(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in out)
    assert lm.lm_scores(frame(spark, []), F.lit(True)).collect() == []


def test_a_long_text_among_short_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "RUN_TOKENS", 1000)  # of this process; workers keep theirs, so _runs is tried here too
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(1, 50_000)}" for _ in range(700_000))
    rows = [(0, long), *((i, f"w{i} w{i + 1} the end") for i in range(1, 10_000))]
    out = {r.doc_id: r for r in lm.lm_scores(frame(spark, rows), F.col("doc_id") % 2 == 0).collect()}
    assert len(out) == len(rows) and out[0].n_tokens == 700_001 and out[9].n_tokens == 5
    import numpy as np
    import pyarrow as pa

    counts = [np.arange(1, n + 1, dtype=np.uint64) for n in (3, 2500, 1, 997, 4)]
    columns = [[len(c) for c in counts], *([lm.pack_integers(c) for c in counts] for _ in range(2))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n_tokens", "words", "pairs"])
    runs = list(lm._runs(batch))
    assert all(len(word) <= 1000 for _, _, word, *_ in runs)
    assert np.concatenate([pair for *_, pair, _ in runs]).tolist() == np.concatenate(counts).tolist()
    context = np.concatenate([np.concatenate([c[-1:], c[:-1]]) for c in counts])
    assert np.concatenate([r[3] for r in runs]).tolist() == context.tolist()
    assert [sum(int(np.diff(r[5])[k]) for r in runs if r[0] <= i < r[1] for k in [i - r[0]]) for i in range(5)] == columns[0]
