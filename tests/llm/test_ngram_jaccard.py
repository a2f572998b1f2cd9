"""The Jaccard join on hot groups, against brute force."""

import random
import re

import numpy as np
import pytest
from tesela.llm import components as components_module
from tesela.llm import common, ngram_jaccard
from tesela.llm.ngram_jaccard import jaccard_join, keep_one

SCHEMA = "doc_id long, text string, set_id string, rid long, __id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    n = len(rows)
    linked = [[j for j in range(n) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(linked[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((rows[i][0], min(ids) if ids else None, len(linked[i]), sets.count(sets[i])))
    return sorted(want, key=str)


def templates(n=150, seed=2):
    """Texts of one template that differ in a few words, some of them chained far apart, and unlike ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        text = list(words)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    drift = list(words)
    for i in range(40):  # each is like the one before, and little like the first
        drift[i] = "y"
        rows.append((1000 + i, " ".join(drift)))
    rows += [(2000 + i, " ".join(f"v{rng.randrange(900)}" for _ in range(30))) for i in range(60)]
    return rows + [(3000 + k, rows[7][1]) for k in range(50)] + [(None, None), (None, ""), (None, rows[3][1]), (5, rows[5][1])]


@pytest.mark.parametrize("small", [False, True])
def test_hot_groups_equal_brute_force(spark, monkeypatch, small):
    """small: buckets and components are cut into many chunks, and every key of some rows counts as hot."""
    if small:
        monkeypatch.setattr(ngram_jaccard, "CHUNK", 32)
        monkeypatch.setattr(ngram_jaccard, "CHUNK_ROWS", 16)
        monkeypatch.setattr(ngram_jaccard, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = templates()
    assert sorted(map(tuple, jaccard_join(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_keep_one_keeps_a_document_of_each_class(spark):
    rows = templates(30)
    kept = keep_one(frame(spark, rows))
    stay = {c for _, c, _, _ in brute(rows)}
    assert kept.columns == ["doc_id", "text", "set_id", "rid", "__id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i in stay)


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rng = random.Random(1)
    edges = [(500, k) for k in range(100)] + [(600, 600 + k) for k in range(1, 100)] + [(k, k + 1) for k in range(800, 900)]
    edges += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components_module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in found} == {(x, root[x]) for x in linked}


def test_matrices_are_no_larger_than_the_chunks():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(300)]
    got = ngram_jaccard.common_members(sets[:100], sets[100:])
    assert got.shape == (100, 200) and got.itemsize == 4
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[100 + j])) for i in range(0, 100, 7) for j in range(0, 200, 11))


def test_recall_at_the_threshold():
    """Pairs of sets at a similarity of exactly 0.8 share a band and survive pruning (missed: 3 in a million)."""
    rng = np.random.default_rng(6)
    n, common_, own = 1500, 80, 10
    members = rng.integers(0, 1 << 63, (n, common_ + 2 * own), dtype=np.uint64)
    left, right = members[:, : common_ + own], np.concatenate([members[:, :common_], members[:, common_ + own :]], axis=1)
    bounds = np.arange(n + 1) * (common_ + own)
    a, b = (ngram_jaccard.signatures(x.ravel(), bounds) for x in (left, right))
    shared = (ngram_jaccard.band_keys(a) == ngram_jaccard.band_keys(b)).any(axis=1)
    alive = ngram_jaccard.survivors(np.concatenate([a, b]), np.arange(n), n + np.arange(n))
    assert shared.all() and len(alive) == n
