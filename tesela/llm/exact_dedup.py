"""Exact deduplication as a stateful stream with disk-backed keyed state that never expires.

A key log (digest, stable identifier, content locator; never the text) streams through a keyed aggregate whose
state lives in RocksDB and in the query's checkpoint. For each digest the state retains the row that stays
(largest doc_id, ties by the locator), its locator, and the number of rows seen. A locator is a Parquet file and the
index of a row in it: those of docs itself where docs is a plain scan of Parquet files, else those of a copy of its ids
and texts that is written first. Nothing expires: with a state_dir, every call meets all that earlier calls with the
same folder saw, and fetches their texts by the retained locators, so the files that were deduplicated must stay.

Hits (digests with two rows or more) are then checked on full bytes. The retained row's text is fetched by its locator
and, if earlier calls had retained another, that one's too; they are compared with the texts of all rows of the hit at
once, through their extremes: all are the same exactly if the least and the greatest are, so a large group of copies
sends one row from each task. Rows whose bytes differ under one digest are grouped anew by their whole text, those of
earlier calls included, and so are its rows in all later calls; a digest collision costs time, not correctness.

Defined results: a null text counts as empty; empty texts are equal to each other. A null doc_id is smaller than
any other. Of repeated rows (same doc_id and text) exactly one stays. An empty table gives no rows. Columns of the
input besides the id and the text are not looked at, so their names can't clash.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.llm.common import exists, join_counted, materialize, remove, text_of, trim_driver, work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State stores are many and small next to RocksDB's preallocated files.
PREALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
#: Digests of 32 bytes, with or without a locator, that are broadcast at most (about 40 MB); else they meet by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Key-log bytes that one micro-batch takes; bounds its memory, not the number of rows.
BYTES_PER_TRIGGER = 1 << 36

LOCATOR = ("file", "row")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _is_parquet_scan(docs: DataFrame) -> bool:
    """Whether docs is nothing but the rows of Parquet files, so that their places are places of its rows."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in relation.fileFormat().toString()


def located(docs: DataFrame, id_column: str, text_column: str, copy_path: str) -> DataFrame:
    """(doc_id, text, file, row), with the text's place; copy_path takes a copy of what has none."""
    if not _is_parquet_scan(docs):
        rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        docs, id_column, text_column = materialize(rows, copy_path), "doc_id", "text"
    return docs.select(
        F.col(id_column).alias("doc_id"),
        text_of(text_column).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.lit(text_column).alias("text_column"),
    )


def fetch(places: DataFrame) -> DataFrame:
    """places (file, row, text_column and more) with the texts that lie there, in the column text.

    Only the files that places name are read; their names come to the driver, as in any scan of them.
    """
    spark = places.sparkSession
    named = places.select("file", "text_column").distinct().collect()
    frames = []
    for column in sorted({r.text_column for r in named}):
        files = [unquote(r.file) for r in named if r.text_column == column]
        kind = spark.read.parquet(files[0]).schema[column]
        texts = spark.read.schema(T.StructType([kind])).parquet(*files)
        texts = texts.select(
            text_of(column).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
        mine = places.where(F.col("text_column") == column)
        frames.append(texts.join(_small(mine), [*LOCATOR]))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _small(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast if their counted number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_DIGESTS else rows


def run_state(spark: SparkSession, log_path: str, schema, state_path: str, out_path: str) -> None:
    """Stream the key log through the keyed state; each micro-batch writes the digests that it changed.

    state_path keeps the RocksDB snapshots and the offsets: call again with a grown log to deduplicate only what
    is new against all that was seen.
    """
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, PREALLOCATE)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PREALLOCATE, "false")
    try:
        log = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(log_path)
        best = F.max(F.struct("doc_id", *LOCATOR, "text_column"))
        state = log.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))

        def keep_changes(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep_changes)
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_changes(spark: SparkSession, out_path: str, log_schema: T.StructType) -> DataFrame:
    """What the micro-batches wrote: (digest, best, group_size, batch)."""
    kinds = {f.name: f.dataType.simpleString() for f in log_schema.fields}
    best = ",".join(f"{n}:{kinds[n]}" for n in ("doc_id", *LOCATOR, "text_column"))
    return spark.read.schema(f"digest {kinds['digest']}, best struct<{best}>, group_size bigint, batch int").parquet(out_path)


def latest_state(changes: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, text_column, group_size) after the micro-batches of changes."""
    last = changes.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
    return last.select(
        "digest",
        F.col("s.best.doc_id").alias("keep_id"),
        F.col("s.best.file").alias("keep_file"),
        F.col("s.best.row").alias("keep_row"),
        F.col("s.best.text_column").alias("text_column"),
        F.col("s.group_size").alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest=sha256,
    verify: bool = True,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    digest maps a text column to a binary or string column; verify compares full bytes on every hit. state_dir: a shared
    folder that keeps the state for later calls; the results tell what stays of this call's rows after all that was
    seen, and rows that an earlier call kept may have gone since. Without it the state is removed.
    """
    spark = docs.sparkSession
    base = (state_dir or work_path(spark, "dedup")).rstrip("/")
    run = uuid.uuid4().hex
    rows = located(docs, id_column, text_column, f"{base}/contents/{run}")
    columns = ("digest", "doc_id", *LOCATOR, "text_column")
    log = materialize(rows.withColumn("digest", digest(F.col("text"))).select(*columns), f"{base}/log/{run}")
    if log.isEmpty():
        empty = log.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
        return empty.withColumn("kept", F.lit(True)).select("doc_id", "keep_id", "group_size", "kept", "digest")
    first_batch = 0
    if exists(spark, f"{base}/changes"):
        first_batch = 1 + (read_changes(spark, f"{base}/changes", log.schema).agg(F.max("batch")).first()[0] or 0)
    run_state(spark, f"{base}/log/*", log.schema, f"{base}/state", f"{base}/changes")
    trim_driver(spark)
    changes = read_changes(spark, f"{base}/changes", log.schema)
    state = latest_state(changes.where(F.col("batch") >= first_batch))  # of this call's digests
    if not state_dir:
        remove(spark, f"{base}/state")
    seen = state.agg(F.sum("group_size")).first()[0]
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    out = join_counted(log.drop("text_column"), state.drop("text_column"), "digest", "group_size", seen)
    out = out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", *LOCATOR)
    if verify:
        earlier = latest_state(changes.where(F.col("batch") < first_batch)) if first_batch else None
        mixed = _digests_with_mixed_bytes(rows, state, earlier, digest)
        if exists(spark, f"{base}/mixed"):
            known = spark.read.schema(mixed.schema).parquet(f"{base}/mixed/*")
            mixed = mixed.unionByName(log.join(_small(known), "digest", "left_semi").select("digest")).distinct()
        mixed = materialize(mixed, f"{base}/mixed/{run}")
        if not mixed.isEmpty():
            every = spark.read.schema(log.schema).parquet(f"{base}/log/*")
            out = _split_collisions(out, every.join(_small(mixed), "digest", "left_semi"), mixed)
    return out.drop(*LOCATOR)


def _digests_with_mixed_bytes(rows: DataFrame, state: DataFrame, earlier: DataFrame | None, digest) -> DataFrame:
    """Hit digests of the rows for which some row's bytes aren't those that the retained locators lead to.

    Rows without a hit are left out before the shuffle, as long as the hit digests are few enough to broadcast.
    """
    hits = state.where("group_size > 1")
    if hits.isEmpty():
        return hits.select("digest")
    mine = rows.select(digest(F.col("text")).alias("digest"), "text")
    mine = mine.join(_small(hits.select("digest")), "digest", "left_semi")
    place = ("digest", F.col("keep_file").alias("file"), F.col("keep_row").alias("row"), "text_column")
    places = hits.select(*place)
    if earlier is not None:
        new = hits.select("digest", F.col("keep_file").alias("new_file"), F.col("keep_row").alias("new_row"))
        other = (F.col("keep_file") != F.col("new_file")) | (F.col("keep_row") != F.col("new_row"))
        places = places.unionByName(earlier.join(new, "digest").where(other).select(*place))
    both = mine.unionByName(fetch(places).select("digest", "text"))
    spread = both.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    return spread.where("least != greatest").select("digest")


def _split_collisions(out: DataFrame, log: DataFrame, mixed: DataFrame) -> DataFrame:
    """out with the rows of mixed digests grouped by whole text; log has all rows of those, of earlier calls too."""
    rows = fetch(log).withColumn("place", F.struct("doc_id", *LOCATOR))
    groups = rows.groupBy("digest", "text").agg(F.max("place").alias("best"), F.count(F.lit(1)).alias("size"))
    split = rows.join(groups, ["digest", "text"]).select(*LOCATOR, "best", "size")
    plain = out.join(mixed, "digest", "left_anti")
    again = out.join(mixed, "digest", "left_semi").join(split, [*LOCATOR])
    kept = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    again = again.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "digest", *LOCATOR
    )
    return plain.select(again.columns).unionByName(again)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text.

    A kept row is found again by digest and id; only repeated rows (same id and text) need another step, which
    keeps one of them. Columns of any name come back as they were.
    """
    mark, id_mark = f"__{uuid.uuid4().hex}", f"__{uuid.uuid4().hex}"
    decided = exact_dedup(docs, id_column, text_column).where("kept")
    kept = decided.select(F.col("digest").alias(mark), F.col("doc_id").alias(id_mark)).distinct()
    rows = docs.withColumn(mark, sha256(text_of(text_column)))
    mine = (rows[mark] == kept[mark]) & rows[id_column].eqNullSafe(kept[id_mark])
    stay = rows.join(kept, mine, "left_semi")
    return stay.dropDuplicates([mark, id_column]).drop(mark)
