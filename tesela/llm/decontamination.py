"""Benchmark decontamination by Wu-Manber search for word windows.

Test strings are the windows of WINDOW consecutive words of each benchmark item (an item of fewer words is one
window). Symbols of the search are words, as 64-bit hashes. For each length of test strings there are two tables
over blocks of two words: how far a window's end may move on when a block stands there (its block shift), and, for
blocks that end a test string, the bucket of test strings with that suffix. A position whose shift is not 0 is
skipped with all between; one whose shift is 0 has its bucket's strings compared directly, first all word hashes,
then the bytes. Many windows move in step, one in each lane of the words of a batch, so that a step of the search is
a few array operations.

The tables hold the benchmark, not the documents. Their size is checked: a benchmark over BLOCK_BYTES is split into
blocks of that size, each with its own tables and its own pass over the rows. The first pass writes the rows, later ones
only what they found, and each pass gives its tables back, so one block's tables are in memory at a time.

Defined results: null and empty texts have no words and no hits; an item without words is never found; items are
told apart by item_id, so repeated item rows count once. Rows of docs are independent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import map_arrow, materialize, text_of, text_slices, utf8, work_path
from tesela.llm.wordhash import LOWER, NOT_ALNUM, kinds_of, mix, words

WINDOW = 13
#: Benchmark bytes whose tables are broadcast at a time; the tables take some 40 times that.
BLOCK_BYTES = 4 << 20
#: Window ends that a lane of the search goes through.
LANE = 256

_KINDS = kinds_of(NOT_ALNUM)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def text_words(texts: pa.Array):
    """For each slice of a text array: its rows, folded bytes, and its words with their bounds by text."""
    for a, b, data, offsets in text_slices(texts):
        yield a, b, LOWER[data], *words(data, offsets, _KINDS)


class Patterns:
    """Test strings of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, strings: dict[bytes, tuple[np.ndarray, set[str]]]):
        self.length, self.block = length, min(2, length)
        self.strings = list(strings)
        self.items = [strings[s][1] for s in self.strings]
        self.hashes = np.stack([strings[s][0] for s in self.strings])
        blocks = self._blocks(self.hashes)
        self.bits = np.uint64(64 - max(12, int(blocks.size * 8).bit_length()))
        self.shift = np.full(1 << int(64 - self.bits), length - self.block + 1, np.int32)
        places = np.broadcast_to(np.arange(blocks.shape[1])[::-1], blocks.shape)
        np.minimum.at(self.shift, (blocks >> self.bits).ravel(), places.ravel().astype(np.int32))
        suffix = blocks[:, -1]
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.order]

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that end at each word from the block length on, along the last axis."""
        return mix(h[..., :-1] * _STEP + h[..., 1:]) if self.block == 2 else mix(h)

    def search(self, h: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and string numbers of occurrences. h: word hashes; firsts: for each word the index of its text's first."""
        n, m = len(h), self.length
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        blocks = self._blocks(h)
        back = self.block - 1
        slots = self.shift[blocks >> self.bits]
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        ends, found = [], []
        while len(at):
            step = slots[at - back]
            hit = np.flatnonzero((step == 0) & (at - m + 1 >= firsts[at]))
            if len(hit):
                e, k = self._compare(h, blocks, at[hit])
                ends.append(e)
                found.append(k)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (none, none)

    def _compare(self, h: np.ndarray, blocks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        suffix = blocks[ends - self.block + 1]
        low = np.searchsorted(self.suffixes, suffix, side="left")
        high = np.searchsorted(self.suffixes, suffix, side="right")
        count = high - low
        where = np.repeat(np.arange(len(ends)), count)
        k = self.order[np.arange(len(where)) + np.repeat(low - (np.cumsum(count) - count), count)]
        e = ends[where]
        for back in range(self.length):
            same = h[e - back] == self.hashes[k, self.length - 1 - back]
            e, k = e[same], k[same]
        return e, k


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Tables for (item_id, text) rows, one for each length of test strings."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = defaultdict(dict)
    texts = utf8(pa.array([t for _, t in items], pa.string()))
    for a, _, data, starts, ends, hashes, bounds in text_words(texts):
        for i in range(len(bounds) - 1):
            first, last = bounds[i], bounds[i + 1]
            m = min(window, last - first)
            for w in range(first, last - m + 1) if m else ():
                key = b" ".join(data[s:e].tobytes() for s, e in zip(starts[w : w + m], ends[w : w + m]))
                by_length[int(m)].setdefault(key, (hashes[w : w + m], set()))[1].add(items[a + i][0])
    return [Patterns(m, strings) for m, strings in sorted(by_length.items())]


def search_texts(texts: pa.Array, tables: list[Patterns]):
    """Yields (number of words, sorted hit word numbers, items) for each text, in order."""
    for _, _, data, starts, ends, hashes, bounds in text_words(texts):
        firsts = np.repeat(bounds[:-1], np.diff(bounds))
        cover = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for table in tables:
            confirmed: dict[tuple[int, int], bool] = {}
            last, which = table.search(hashes, firsts)
            for e, k in zip(last.tolist(), which.tolist()):
                begin = e - table.length + 1
                if (e, k) not in confirmed:
                    string = b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(begin, e + 1))
                    confirmed[e, k] = string == table.strings[k]
                if confirmed[e, k]:
                    cover[begin] += 1
                    cover[e + 1] -= 1
                    items[int(np.searchsorted(bounds, e, side="right")) - 1] |= table.items[k]
        hit = np.cumsum(cover[:-1]) > 0
        for i in range(len(bounds) - 1):
            own = hit[bounds[i] : bounds[i + 1]]
            yield len(own), np.flatnonzero(own), items.get(i, ())


def _item_blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[DataFrame]:
    """The items (item, text) in blocks of about block_bytes."""
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), text_of(text_column).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        yield items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)


def find_occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    benchmark_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_words, hit_words, items[, the columns in keep]) of each row of docs.

    hit_words: numbers of the words inside any occurrence, from 0 on; items: the item_ids, as sorted strings.
    The columns in keep are renamed to keep_0, keep_1, ... so that no name can clash.
    """
    spark = docs.sparkSession
    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        text_of(text_column).alias("text"),
        *kept,
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("hit_words"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = list(_item_blocks(benchmark, item_column, benchmark_text, block_bytes))
    tables = spark.sparkContext.broadcast(build([(r.item, r.text) for r in blocks[0].collect()], window))
    rows = map_arrow(rows, _search_with(tables), rows.schema)
    if len(blocks) == 1:
        return rows.drop("text")
    path = work_path(spark, "decontamination")
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), f"{path}/rows")
    for k, block in enumerate(blocks[1:], 1):
        tables.destroy()
        tables = spark.sparkContext.broadcast(build([(r.item, r.text) for r in block.collect()], window))
        none = (F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("hit_words"))
        texts = rows.select("__row", "text", *none, F.array().cast("array<string>").alias("items"))
        found = map_arrow(texts, _search_with(tables), texts.schema).where(F.size("hit_words") > 0)
        found.select("__row", F.col("hit_words").alias("more"), F.col("items").alias("others")).write.parquet(f"{path}/found/{k}")
    tables.destroy()
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = spark.read.parquet(f"{path}/found/*").groupBy("__row").agg(merged("more"), merged("others"))
    return rows.join(found, "__row", "left").select(
        *(c for c in rows.columns if c not in ("text", "__row", "hit_words", "items")),
        F.when(F.col("more").isNull(), F.col("hit_words")).otherwise(F.array_sort(F.array_union("hit_words", "more"))).alias("hit_words"),
        F.when(F.col("others").isNull(), F.col("items")).otherwise(F.array_sort(F.array_union("items", "others"))).alias("items"),
    ).select(*(c for c in rows.columns if c not in ("text", "__row")))


def _search_with(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_words, hits, items = [], [], []
            before = batch.column(names.index("hit_words")).to_pylist()
            known = batch.column(names.index("items")).to_pylist()
            for i, (n, own, found) in enumerate(search_texts(utf8(batch.column(1)), tables.value)):
                n_words.append(n)
                hits.append(np.union1d(before[i], own).astype(np.int32) if before[i] else own.astype(np.int32))
                items.append(sorted({*known[i], *found}))
            new = {
                "n_words": pa.array(n_words, pa.int64()),
                "hit_words": pa.array(hits, pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def is_contaminated():
    """At least a twentieth of the words hit, and one at least."""
    hit = F.size("hit_words").cast("bigint")
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", any_hit: bool = True
) -> DataFrame:
    """The rows of docs without benchmark text, with all their columns.

    any_hit: a row goes if one of its words is hit, so that a passage inside a long text is found; else only if it is
    contaminated, which the length of the text decides too. Null and empty texts stay, and so do all rows if no item
    has words; repeated rows stay or go together; columns of any name come back as they were.
    """
    found = find_occurrences(docs, benchmark, id_column, text_column, keep=tuple(docs.columns))
    clean = found.where(F.size("hit_words") == 0 if any_hit else ~is_contaminated())
    return clean.select(*(F.col(f"keep_{k}").alias(c) for k, c in enumerate(docs.columns)))
