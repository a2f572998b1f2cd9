"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of three orders, with weights by the frequency of the context:

    p(w | v) = a2[b] c(v w) / c(v) + a1[b] c(w) / N + a0[b] / (V + 1),    b = bucket of c(v)

The weights of each bucket come from expectation-maximisation on deleted counts: each training token is held out in
turn, so its estimates are (c(v w) - 1) / (c(v) - 1) and (c(w) - 1) / (N - 1). A text's first context is the end token.

All counts cover the whole training part and are never held in one place:

1. Tasks cut their rows into blocks of about BLOCK_TOKENS tokens. A block is written once packed (its rows,
   compressed), and once as its distinct words and pairs (64-bit hashes) with their training counts, in at most FAN
   ranges of the hash.
2. Where FAN ranges aren't enough for parts of about PART_BYTES of text, the pieces of one range are merged in groups
   and cut into FAN finer ranges, again and again. So each level has a fixed number of rows for each block or group,
   and all tables grow in proportion to the text: 50 GB take one level, 100 TB two.
3. Each part of the last level sums the counts of its keys, and answers each of its pieces with the sums alone, in the
   order of the piece's keys; the groups above hand the answers on to theirs. Frequent words are counted inside their
   block first, so none makes a part large.
4. Each block meets the answers of its ranges and writes, for each row, the counts of its tokens.
5. The weights are learned from a histogram of all training tokens over bucket and rounded log estimates (its size is
   fixed), and each row is scored. Both go through RUN_TOKENS tokens at a time, however long texts are.

Intermediate tables lie in the shared folder; losing an executor repeats tasks only.

Defined results: null and empty texts consist of the end token. With no training row N and V are 0, every count is 0
and the weights fall to a0. A null id counts as an empty string where rows are assigned to the training part by the
caller. Repeated rows count repeatedly. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import map_arrow, materialize, release_shuffles, remove, ship_package, text_of, text_slices, utf8, work_path
from tesela.llm.wordhash import LOWER, SPACE, kinds_of, mix, segments, words

BLOCK_TOKENS = 1 << 20
#: Text bytes for each part.
PART_BYTES = 24 << 20
#: Ranges of the hash that a block, or a group of pieces, is cut into at most.
FAN = 2048
#: Tokens whose estimates a worker holds at a time.
RUN_TOKENS = 1 << 18
BUCKETS = 24
END = np.uint64(0x7C15B1E5ED0FACE1)
EM_ROUNDS = 60

_KINDS = kinds_of(SPACE)
#: Rounded log estimates: steps for each power of two, and the number of steps.
_FINE, _COARSE, _STEPS = 8, 4, 256


def pack_integers(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_integers(packed: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as packed differences."""
    return pack_integers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_integers(packed, np.uint64))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each text with its end token, and bounds by text."""
    parts, sizes = [], []
    for _, _, data, offsets in text_slices(texts):
        _, _, h, bounds = words(data, offsets, _KINDS, LOWER)
        n = np.diff(bounds)
        out = np.full(len(h) + len(n), END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        parts.append(out)
        sizes.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def pairs(t: np.ndarray) -> np.ndarray:
    """Hashes of (context, token), of 56 bits; what stands before a text is an end token."""
    before = np.empty_like(t)
    before[:1] = END
    before[1:] = t[:-1]
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + t) & ~np.uint64(0xFF)


def part_bounds(keys: np.ndarray, n_parts: int, parts: range) -> np.ndarray:
    """Where each of the parts begins among ascending keys, and where the last ends; n_parts cut all hashes evenly."""
    part = (keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts.start, parts.stop + 1))


def cut_rows(found: list[tuple[np.ndarray, np.ndarray]], n_parts: int, parts: range) -> Iterator[tuple[int, list[bytes]]]:
    """(part, packed keys and counts of words, of pairs) for each of the parts; found: ascending keys with counts."""
    cuts = [part_bounds(keys, n_parts, parts) for keys, _ in found]
    for k, part in enumerate(parts):
        row = []
        for (keys, counts), cut in zip(found, cuts):
            row += [pack_keys(keys[cut[k] : cut[k + 1]]), pack_integers(counts[cut[k] : cut[k + 1]])]
        yield part, row


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (doc_id, learn, text) in blocks of about BLOCK_TOKENS tokens, estimated from their bytes."""
    held, size = [], 0
    for batch in batches:
        texts = utf8(batch.column(2))
        at = 0
        for _, b, data, _ in text_slices(texts):
            size += len(data)
            if size >= 6 * BLOCK_TOKENS:
                yield pa.Table.from_batches([*held, batch.slice(at, b - at)])
                held, size, at = [], 0, b
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _counted(table: pa.Table):
    """Tokens of a block with bounds, and (distinct keys, each token's key, training counts) of words and pairs."""
    t, bounds = tokens(utf8(table.column(2)))
    learn = np.repeat(table.column(1).to_numpy().astype(np.int64), np.diff(bounds))
    found = []
    for h in (t, pairs(t)):
        keys, where = np.unique(h, return_inverse=True)
        found.append((keys, where, np.bincount(where, weights=learn, minlength=len(keys)).astype(np.uint64)))
    return bounds, found


def _write_blocks(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for table in _blocks(batches):
            block = uuid.uuid4().hex
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(table.combine_chunks())
            rows = [(-1, [sink.getvalue(), None, None, None])]
            _, found = _counted(table)
            rows += cut_rows([(keys, counts) for keys, _, counts in found], n_parts, range(n_parts))
            for k in range(0, len(rows), 64):
                some = rows[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(some)),
                        pa.array([p for p, _ in some], pa.int32()),
                        *(pa.array([r[c] for _, r in some], pa.binary()) for c in range(4)),
                    ],
                    names=["block", "part", "a", "b", "c", "d"],
                )

    return run


_PIECES = "block string, part int, a binary, b binary, c binary, d binary"
_SUMS = "block string, part int, words binary, pairs binary, n bigint, v bigint"


def _merged(table: pa.Table):
    """Of the pieces of one range, for words and for pairs: distinct keys, sums, and each piece's places among them."""
    for key_column, count_column in (("a", "b"), ("c", "d")):
        keys = [unpack_keys(k.as_py()) for k in table.column(key_column)]
        ends = np.cumsum([0, *map(len, keys)])
        known, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = np.zeros(len(known), np.uint64)
        for a, b, packed in zip(ends[:-1], ends[1:], table.column(count_column)):
            sums[where[a:b]] += unpack_integers(packed.as_py(), np.uint64)  # keys of one piece are distinct
        yield known, sums, [where[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _answers(table: pa.Table, sums: list, places: list, totals: tuple[int, int] = (0, 0)) -> pa.Table:
    n = table.num_rows
    packed = [pa.array([pack_integers(s[w]) for w in where], pa.binary()) for s, where in zip(sums, places)]
    own = [pa.array([t] + [0] * (n - 1), pa.int64()) for t in totals]
    return pa.table(
        [table.column("block"), table.column("part"), *packed, *own], names=["block", "part", "words", "pairs", "n", "v"]
    )


def _sum_part(table: pa.Table) -> pa.Table:
    """For one part: the sums of its keys, for each piece; and the part's tokens and distinct words, once."""
    (_, words_, at), (_, pairs_, at_pairs) = _merged(table)
    totals = int(words_.sum()), int(np.count_nonzero(words_))
    return _answers(table, [words_, pairs_], [at, at_pairs], totals)


def _merge_pieces(n_parts: int, split: int):
    """The pieces of a group as one, cut into split finer ranges of n_parts in all."""

    def run(table: pa.Table) -> pa.Table:
        first = table.column("part")[0].as_py() * split
        group = table.column("group")[0].as_py()
        found = [(known, sums) for known, sums, _ in _merged(table)]
        rows = list(cut_rows(found, n_parts, range(first, first + split)))
        columns = [pa.array([r[c] for _, r in rows], pa.binary()) for c in range(4)]
        return pa.table(
            [pa.array([group] * len(rows)), pa.array([p for p, _ in rows], pa.int32()), *columns],
            names=["block", "part", "a", "b", "c", "d"],
        )

    return run


def _in_order(answers: pa.Table, name: str) -> np.ndarray:
    """The sums of all parts of one block or group, in the order of its keys."""
    order = np.argsort(answers.column("part").to_numpy())
    column = answers.column(name)
    return np.concatenate([unpack_integers(column[int(i)].as_py(), np.uint64) for i in order])


def _hand_on(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a group, for each piece in it; the part's totals come along once."""
    places = [where for _, _, where in _merged(table)]
    totals = tuple(sum(answers.column(c).to_pylist()) for c in ("n", "v"))
    return _answers(table, [_in_order(answers, "words"), _in_order(answers, "pairs")], places, totals)


def sum_pieces(pieces: DataFrame, ranges: int, n_parts: int, fan: int) -> DataFrame:
    """(block, part, words, pairs, n, v): the answers to pieces that are cut into so many ranges of the hash.

    Pieces of a range are summed at once if there are n_parts ranges or more, else by groups and finer ranges.
    """
    if ranges >= n_parts:
        return pieces.repartitionById(ranges, "part").groupBy("part").applyInArrow(_sum_part, _SUMS)
    spark = pieces.sparkSession
    groups = -(-n_parts // ranges)
    split = min(fan, groups)
    group = F.concat_ws("-", "part", F.pmod(F.xxhash64("block"), F.lit(groups))).alias("group")
    grouped = pieces.select("*", group).repartition(n_parts, "group")
    merged = grouped.groupBy("group").applyInArrow(_merge_pieces(ranges * split, split), _PIECES)
    merged = materialize(merged, work_path(spark, "lm-merged"))
    answers = sum_pieces(merged, ranges * split, n_parts, fan).withColumnRenamed("block", "group")
    answers = answers.repartition(n_parts, "group")
    return grouped.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_hand_on, _SUMS)


def _count_tokens(n_train: int, v_train: int):
    """A block's rows with the counts of their tokens."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(packed.column("a")[0].as_py()).read_all()
        bounds, found = _counted(table)
        word, pair = (_in_order(answers, name)[where] for (_, where, _), name in zip(found, ("words", "pairs")))
        base = segments(np.log10((word + 1.0) / (n_train + v_train + 1.0)), bounds, np.add, 0.0)
        known = segments((word > 0).astype(np.int64), bounds, np.add, 0)
        cut = list(zip(bounds[:-1], bounds[1:]))
        return pa.table(
            {
                "doc_id": table.column(0),
                "learn": table.column(1),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base),
                "words": pa.array([pack_integers(word[a:b]) for a, b in cut], pa.binary()),
                "pairs": pa.array([pack_integers(pair[a:b]) for a, b in cut], pa.binary()),
            }
        )

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Counts of tokens, of their contexts and of the pairs, for RUN_TOKENS tokens at most at a time.

    Yields (first row, row after the last, tokens, contexts, pairs, bounds by row); a row of more tokens than that
    comes alone, in several runs of its own.
    """
    names = batch.schema.names
    word_column, pair_column = batch.column(names.index("words")), batch.column(names.index("pairs"))
    ends = np.cumsum(batch.column(names.index("n_tokens")).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + RUN_TOKENS, side="right")))
        word = [unpack_integers(word_column[i].as_py(), np.uint64) for i in range(at, to)]
        pair = np.concatenate([unpack_integers(pair_column[i].as_py(), np.uint64) for i in range(at, to)])
        bounds = np.cumsum([0, *map(len, word)])
        word = np.concatenate(word)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[bounds[:-1]] = word[bounds[1:] - 1]  # the end token stands before a text, and its count is at its end
        for a in range(0, len(word), RUN_TOKENS):
            b = min(len(word), a + RUN_TOKENS)
            yield at, to, *(x[a:b].astype(float) for x in (word, context, pair)), np.clip(bounds, a, b) - a
        at = to


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the count's power of two."""
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1, BUCKETS - 1)


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def _histogram(n_train: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, word, context, pair, _ in _runs(batch):
                # One occurrence is held out. Contexts at the start of a text share its end token's count.
                f2 = _ratio(np.maximum(pair - 1, 0), context - 1)
                f1 = np.maximum(word - 1, 0) / max(n_train - 1, 1)
                code = bucket(context - 1)
                for f, steps in ((f2, _FINE), (f1, _COARSE)):
                    fall = 1 + np.floor(-steps * np.log2(np.maximum(f, 1e-300)) + 0.5)
                    code = code * _STEPS + np.where(f > 0, np.minimum(fall, _STEPS - 1), 0).astype(np.int64)
                codes, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    return run


def learn_weights(codes: np.ndarray, n: np.ndarray, v_train: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (a2, a1, a0) of each bucket, by EM over the histogram."""
    f1, f2 = codes % _STEPS, codes // _STEPS % _STEPS
    own = codes // (_STEPS * _STEPS)
    estimates = np.stack(
        [
            np.where(f2 > 0, 2.0 ** (-(f2 - 1) / _FINE), 0.0),
            np.where(f1 > 0, 2.0 ** (-(f1 - 1) / _COARSE), 0.0),
            np.full(len(codes), 1.0 / (v_train + 1)),
        ]
    )
    weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    for b in range(BUCKETS):
        mine = own == b
        if not mine.any():
            continue
        f, count = estimates[:, mine], n[mine]
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w[:, None] * f
            w = (share / share.sum(axis=0) * count).sum(axis=1) / count.sum()
        # The uniform part never falls to 0, so that no text has probability 0.
        w = np.maximum(w, [0, 0, 1e-6])
        weights[b] = w / w.sum()
    seen = np.flatnonzero(np.isin(np.arange(BUCKETS), own))
    for b in range(BUCKETS):  # buckets without a training token take the nearest one's weights
        if len(seen) and b not in seen:
            weights[b] = weights[seen[np.argmin(np.abs(seen - b))]]
    weights[0] = [0.0, weights[0, 1] + weights[0, 0], weights[0, 2]]
    return weights


def _score(n_train: int, v_train: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, word, context, pair, bounds in _runs(batch):
                w = weights[bucket(context)]
                p = w[:, 0] * _ratio(pair, context) + w[:, 1] * word / max(n_train, 1) + w[:, 2] / (v_train + 1)
                score[a:b] += segments(np.log10(p), bounds, np.add, 0.0)
            keep = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score)], names=[*batch.schema.names[:5], "score"])

    return run


def lm_scores(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_bytes: int = PART_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, base_score, score, train_tokens) of each row; learn marks training rows."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_of(text_column).alias("text")
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    size = source.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        new = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
        empty = source.select("doc_id", "learn", *(F.lit(None).cast(t).alias(n) for n, t in new.items()))
        return empty.withColumn("train_tokens", F.lit(0).cast("bigint"))
    n_parts = max(8, -(-size // part_bytes))
    ranges = min(fan, n_parts)
    path, sums_path, counts_path = (work_path(spark, f"lm-{n}") for n in ("blocks", "sums", "counts"))
    map_arrow(source, _write_blocks(ranges), _PIECES).withColumn("packed", F.col("part") < 0).write.partitionBy(
        "packed"
    ).option("compression", "uncompressed").parquet(path)
    packs = spark.read.schema(_PIECES).parquet(f"{path}/packed=true")
    keys = spark.read.schema(_PIECES).parquet(f"{path}/packed=false")
    sums = sum_pieces(keys, ranges, n_parts, fan)
    sums = materialize(sums, sums_path)
    remove(spark, f"{path}/packed=false")
    release_shuffles(spark)
    n_train, v_train = sums.agg(F.sum("n"), F.sum("v")).first()
    counts = packs.select("block", "a").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        _count_tokens(n_train, v_train),
        f"doc_id {id_type}, learn boolean, n_tokens bigint, n_known bigint, base_score double, words binary, pairs binary",
    )
    counts = materialize(counts, counts_path)
    remove(spark, path, sums_path)
    rows = map_arrow(counts.where("learn"), _histogram(n_train), "code bigint, n bigint")
    histogram = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    weights = learn_weights(histogram.column("code").to_numpy(), histogram.column("n").to_numpy(), v_train)
    scored = "learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return map_arrow(counts, _score(n_train, v_train, weights), f"doc_id {id_type}, {scored}").withColumn(
        "train_tokens", F.lit(n_train).cast("bigint")
    )
