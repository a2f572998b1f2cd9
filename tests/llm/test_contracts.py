"""Queries that SQL can't express: against the tokenizers library, and by accuracy on held-out labels."""

import hashlib
import os

import pytest
from tesela.llm import quality
from tesela.llm.queries import QUERIES, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
SMALL, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no tables here")


def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_tokens_of_whole_tables_equal_the_library(spark):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    docs = texts(spark, SMALL)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    counts = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, SMALL).collect()}
    coded = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, SMALL).collect()}
    assert set(counts) == set(coded) == set(docs)
    for i, text in docs.items():
        assert (counts[i].n_bytes, counts[i].n_tokens) == (len(text.encode()), len(ids[i]))
        assert counts[i].over_limit == (len(ids[i]) > 1024) and coded[i].n_tokens == len(ids[i])
        packed = b"".join(x.to_bytes(4, "little") for x in ids[i])
        assert coded[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        decoded = library.decode(ids[i], skip_special_tokens=False)
        assert coded[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("name, label", [("op3_quality", "quality"), ("op5_toxicity", "toxic")])
def test_scores_part_held_out_labels(spark, name, label):
    """On the table with some 4,000 labels; the 300 of a tenth of it are too few for the factorization machine."""
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, LABELLED).collect() if r.held_out and marks.get(r.doc_id) is not None]
    ones, zeros = ([r.score for r in rows if marks[r.doc_id] == k] for k in (1, 0))
    assert len(rows) > 20 and ones and zeros and all(0 <= r.score <= 1 for r in rows)
    above = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert above > 0.85


def test_sample_of_labels(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text {k} " * k, 1) for k in range(40)] + [(3, "text 3 again", 2)], "doc_id long, text string, id long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(5, None), (6, 1), (None, 1)], "doc_id long, quality int")
    found, marks = quality.sample_labelled(docs, labels, "quality", F.lit(True), 100)
    assert len(found) == len(marks) == 40 and sum(marks) == 21
    assert len(quality.sample_labelled(docs, labels, "quality", F.lit(True), 7)[0]) == 7
    monkeypatch.setattr(quality, "MAX_TRAIN_BYTES", 2000)
    some, _ = quality.sample_labelled(docs, labels, "quality", F.lit(True), 100)
    assert 0 < len(some) < 40 and sum(len(t.as_py()) for t in some) <= 2000
