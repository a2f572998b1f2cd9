"""From raw documents to token ids: quality, exact and near copies, benchmark leaks, then encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever other columns those
have. A null text counts as empty. A null id is an id like any other, smaller than all; repeated rows are copies of each
other, of which exact_dedup leaves one. An empty table stays empty at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesela.llm import bpe, decontamination, exact_dedup, ngram_jaccard, quality
from tesela.llm.common import crc_mod, finished, remove, table
from tesela.llm.queries import tokenizer_path

#: Documents that score less are rejected; clean text scores well above, junk well below.
LEAST_QUALITY = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches LEAST_QUALITY; empty texts get the score of the bias, repeated rows one score."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 4) != 2)
    return quality.keep_good(docs, weights, LEAST_QUALITY)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, of the greatest id; empty texts are one text. Ties are repeated rows, of which any stays."""
    return exact_dedup.keep_one(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the least id; empty texts are one class."""
    return ngram_jaccard.keep_one(docs)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any word of a benchmark window; empty texts have none."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row; empty texts have no ids."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("decontamination", no_benchmark_text),
    ("bpe", token_ids),
]

#: SQL expresses neither the classifier nor the encoding; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written; what came before it is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = finished(spark, lambda f=stage, d=docs: f(spark, d, sf_dir), f"pipeline-{name}")
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
