from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tesela.llm.exact_dedup import exact_dedup, keep_one

ROWS = [
    (1, "a b", 9), (2, "a b", 8), (3, "A b", 7), (None, "a b", 6), (5, None, 5), (6, "", 4), (7, "x" * 200_000, 3),
    (8, "x" * 200_000, 2), (9, "only", 1), (9, "only", 1), (10, "x", 0),
]


def expected(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[text or ""].append(i)
    out = []
    for ids in groups.values():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in ids:
            out.append((i, best, len(ids), i == best and not kept))
            kept = kept or i == best
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id long")


@pytest.mark.parametrize("weak", [False, True])
def test_groups_rows_by_whole_text(spark, weak):
    """A digest of one byte makes unlike texts collide; the byte check must part them again."""
    digest = (lambda text: F.length(text).cast("string").substr(1, 1)) if weak else None
    out = exact_dedup(frame(spark, ROWS), **({"digest": digest} if weak else {}))
    got = sorted((tuple(r)[:4] for r in out.collect()), key=str)
    assert got == expected(ROWS)


def test_keep_one_returns_one_whole_row_a_text(spark):
    docs = frame(spark, ROWS)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.keep_id) for r in kept.collect()) == [(2, 8), (3, 7), (6, 4), (8, 2), (9, 1), (10, 0)]


def test_empty_table(spark):
    docs = frame(spark, [])
    assert exact_dedup(docs).collect() == []
    assert keep_one(docs).collect() == []


CLASHING = "doc_id long, text string, keep_id long, digest string, file string, row long, kept string"


@pytest.mark.parametrize("scan", [False, True])
@pytest.mark.parametrize("weak", [False, True])
def test_state_meets_what_earlier_runs_saw(spark, tmp_path, scan, weak):
    """Two calls with one state folder, over files whose names need quoting, or over other tables."""
    digest = {"digest": lambda text: F.length(text).cast("string").substr(1, 1)} if weak else {}
    runs = ([(1, "a"), (2, "b"), (3, "a"), (7, "cc")], [(3, "a"), (0, "b"), (4, "c"), (None, None), (4, "c")], [(9, "a"), (5, "")])
    seen = []
    for k, run in enumerate(runs):
        docs = spark.createDataFrame([(i, t, 1, "d", "f", 2, "k") for i, t in run], CLASHING)
        if scan:
            docs.repartition(2).write.parquet(str(tmp_path / f"run {k}%20"))
            docs = spark.read.parquet(str(tmp_path / f"run {k}%20"))
        seen += [(i, t or "") for i, t in run]
        out = exact_dedup(docs, state_dir=str(tmp_path / "state"), **digest).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in run)
        for i, t in run:
            ids = [j for j, u in seen if u == (t or "")]
            best = max(ids, key=lambda j: (j is not None, j or 0))
            found = [r for r in out if r.doc_id == i and r.group_size == len(ids) and r.keep_id == best]
            assert found, (k, i, t)
        kept = [r.doc_id for r in out if r.kept]
        assert len(kept) == len(set(kept)) and all(r.doc_id == r.keep_id for r in out if r.kept)


def test_hits_are_compared_with_the_text_at_the_locator(spark, tmp_path):
    """A file that changed after its run no longer holds the retained bytes, and the later copy isn't its equal."""
    first, state = str(tmp_path / "first"), str(tmp_path / "state")
    frame(spark, [(9, "same", 0)]).coalesce(1).write.parquet(first)
    assert exact_dedup(spark.read.parquet(first), state_dir=state).first().kept
    frame(spark, [(9, "else", 0)]).coalesce(1).write.mode("overwrite").parquet(first + "2")
    import os
    import shutil

    (old,), (new,) = ([n for n in os.listdir(p) if n.endswith(".parquet")] for p in (first, first + "2"))
    shutil.copy(os.path.join(first + "2", new), os.path.join(first, old))
    for n in os.listdir(first):
        if n.endswith(".crc"):
            os.remove(os.path.join(first, n))
    out = exact_dedup(frame(spark, [(1, "same", 0)]), state_dir=state).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out] == [(1, 1, 1, True)]


def test_a_hot_digest(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", 0) for i in range(3000)]
    assert sorted((tuple(r)[:4] for r in exact_dedup(frame(spark, rows)).collect()), key=str) == expected(rows)


def test_keep_one_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "x", "y")], "doc_id long, text string, __digest string, __id string")
    assert [tuple(r) for r in keep_one(docs).collect()] == [(2, "a", "x", "y")]
