"""N-gram Jaccard self-join with Bayesian candidate pruning.

A text is the set of its runs of SHINGLE words (white space parts words, A to Z are lower-cased; a text of fewer words
is one run of all). Two texts are linked if the Jaccard similarity of their sets is THRESHOLD or more.

1. Texts with one set are one representative, found by a 128-bit digest with a partial aggregate, so copies are
   never paired. A representative has HASHES MinHash values of 16 bits.
2. Representatives that agree in all ROWS values of one of BANDS bands are candidates (a pair at the threshold is
   missed with a probability of 3 in a million, a pair at 0.85 of 2 in a billion).
3. Candidates are compared value by value, STEP at a time; a pair is dropped as soon as the posterior probability
   (uniform prior) that it reaches the threshold is under TOLERANCE. Inside a band's bucket, a representative that
   has been reached isn't compared again, so a bucket of near copies costs comparisons in proportion to its size;
   only a forest of the surviving pairs leaves it. Buckets over CHUNK rows are compared in pairs of chunks.
4. The forest's components are verified exactly, each pair inside one: whole sets are intersected, in pairs of
   chunks of about CHUNK_ROWS rows and CHUNK_SHINGLES shingles at most. Counts of links and a forest of links leave a
   task, never the pairs.

The result has one row for each row of the input: doc_id, class_id (the least doc_id among all that a chain of
links reaches), n_links (rows linked to it: those with the same set, and those of linked sets) and n_same (rows with
the same set, itself included).

Defined results: null and empty texts have the same, empty set, and are linked to each other only. Null ids are
carried along; a class of null ids only has a null class_id. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import join_counted, map_arrow, materialize, remove, text_of, text_slices, trim_driver, utf8, work_path
from tesela.llm.components import components
from tesela.llm.wordhash import LOWER, SPACE, kinds_of, mix, words

SHINGLE = 5
THRESHOLD = (4, 5)
ROWS, BANDS = 6, 42
HASHES = ROWS * BANDS
STEP = 28
TOLERANCE = 1e-9
#: Rows of a bucket that one task compares at most; larger buckets go by pairs of chunks.
CHUNK = 4096
#: Rows and shingles of a chunk in verification, about; a task holds a matrix of CHUNK_ROWS by CHUNK_ROWS.
CHUNK_ROWS = 2048
CHUNK_SHINGLES = 1 << 20
#: Representatives whose keys are broadcast at most (about 40 MB); beyond it the join is by shuffle.
BROADCAST_ROWS = 400_000
#: Buckets of at most so many rows have their pairs laid out side by side with those of other buckets.
SMALL = 24

_KINDS = kinds_of(SPACE)
_STEP64 = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0x5CA1AB1E0DDBA11)
_rng = np.random.default_rng(1205)
_MULT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds by text."""
    _, _, h, bounds = words(data, offsets, _KINDS, LOWER)
    n = np.diff(bounds)
    count = np.maximum(n - SHINGLE + 1, 1)
    cuts = np.concatenate([[0], np.cumsum(count)])
    out = np.full(cuts[-1], _EMPTY, np.uint64)
    full = n >= SHINGLE
    if full.any():
        rolled = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            rolled = rolled * _STEP64 + h[k : len(h) - SHINGLE + 1 + k]
        rolled = mix(rolled)
        inside = np.repeat(full, count)
        take = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - bounds[:-1], count)
        out[inside] = rolled[take[inside]]
    for i in np.flatnonzero((n > 0) & ~full):
        one = np.array([n[i]], np.uint64)
        for x in h[bounds[i] : bounds[i + 1]]:
            one = one * _STEP64 + x
        out[cuts[i]] = mix(one)[0]
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def set_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digests of whole sets, as two columns of 64 bits; sets have at least one member."""
    with_size = np.diff(bounds).astype(np.uint64)
    first = mix(np.add.reduceat(mix(sets ^ _EMPTY), bounds[:-1]) + with_size)
    second = mix(np.add.reduceat(mix(sets + _STEP64), bounds[:-1]) ^ (with_size << np.uint64(32)))
    return np.stack([first, second], axis=1)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES MinHash values, by text."""
    low = (sets >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(low * _MULT[k] + _ADD[k], bounds[:-1]).astype(np.uint16)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band, from the values that signatures hold."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _STEP64 + values[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> np.ndarray:
    """After n compared values, the least number of matches with which a pair goes on.

    With a uniform prior and m matches of n, the similarity's posterior is Beta(m + 1, n - m + 1), and the probability
    that it reaches t is that of at most m successes in n + 1 draws of chance t.
    """
    least = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m > n:
                break
            m += 1
        least[n] = m
    return least


_LEAST = least_matches()


def survivors(signature: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) of rows of signature are still possible after incremental comparison."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        end = min(at + STEP, HASHES)
        same = signature[a[alive], at:end] == signature[b[alive], at:end]
        matches = matches + same.sum(axis=1)
        keep = matches >= _LEAST[end]
        alive, matches = alive[keep], matches[keep]
    return alive


def _forest(signature: np.ndarray) -> tuple[list[int], list[int]]:
    """A forest over the pairs of a bucket that survive: rows not yet reached are compared with each reached row."""
    left, right = [], []
    rest = np.arange(len(signature))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = survivors(signature, np.full(len(rest), p), rest)
            if len(hit):
                found = rest[hit]
                left += [p] * len(found)
                right += found.tolist()
                queue += found.tolist()
                rest = np.delete(rest, hit)
    return left, right


def grouped(run: Callable, n_keys: int) -> Callable:
    """A mapInArrow function that calls run with the batches of rows as whole groups.

    Rows come sorted by their first n_keys columns; run gets a table of one or more whole groups and their bounds.
    Only the last group of a batch waits for the next one.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                table = pa.Table.from_batches(held).combine_chunks()
            elif batch is None and held:
                table = pa.Table.from_batches(held).combine_chunks()
            else:
                continue
            keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)], axis=1)
            bounds = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            last = table.num_rows if batch is None else (int(bounds[-1]) if len(bounds) else 0)
            held = table.slice(last).to_batches() if last < table.num_rows else []
            if last:
                bounds = np.unique(np.concatenate([[0], bounds[bounds <= last], [last]]))
                yield from run(table.slice(0, last), bounds)

    return whole


def _matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _candidate_edges(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns band, chunk pair, rid, signature -> edges (a, b)."""
    rid, signature = table.column("rid").to_numpy(), _matrix(table.column("sig"), np.uint16, HASHES)
    sizes = np.diff(bounds)
    edges = []
    for size in range(2, SMALL + 1):
        starts = bounds[:-1][sizes == size]
        if not len(starts):
            continue
        for x, y in itertools.combinations(range(size), 2):
            for k in range(0, len(starts), 1 << 15):
                a, b = starts[k : k + (1 << 15)] + x, starts[k : k + (1 << 15)] + y
                alive = survivors(signature, a, b)
                edges.append((rid[a[alive]], rid[b[alive]]))
    for i in np.flatnonzero(sizes > SMALL):
        left, right = _forest(signature[bounds[i] : bounds[i + 1]])
        edges.append((rid[bounds[i] + np.array(left, np.int64)], rid[bounds[i] + np.array(right, np.int64)]))
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges))
        low, high = np.minimum(a, b), np.maximum(a, b)
        pair = np.unique(np.stack([low, high], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def common_members(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right, as a matrix."""
    n, sets = len(left), [*left, *right]
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.full((n, len(right)), np.count_nonzero(count == len(sets)), np.float32)  # exact up to 2**24
    some = (count > 1) & (count < len(sets))
    number = np.cumsum(some) - 1
    inside = some[where]
    row, column = member[inside], number[where[inside]]
    del where, member
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, (1 << 21) // len(sets))
    for at in range(0, int(some.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[row[low:high], column[low:high] - at] = 1
        both += block[:n] @ block[n:].T
    return both


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets on the left are as similar to which on the right as THRESHOLD asks."""
    both = common_members(left, right)
    sizes = np.array([len(s) for s in left], np.float32)[:, None], np.array([len(s) for s in right], np.float32)[None, :]
    over, under = THRESHOLD
    return (over + under) * both >= over * (sizes[0] + sizes[1])


def _verify(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns comp, i, j, chunk, whole, rid, n_docs, members -> (a, null, links) for rows, (a, b, null) for a forest.

    whole is passed on: whether the row's component has one chunk, so that its forest has one star for each class.
    """
    rids, docs, chunks, wholes = (table.column(n).to_numpy() for n in ("rid", "n_docs", "chunk", "whole"))
    members = table.column("members")
    firsts, seconds = table.column("i").to_numpy(), table.column("j").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for first, last in zip(bounds[:-1], bounds[1:]):
        rid, at = np.unique(rids[first:last], return_index=True)
        at = at + first
        if len(rid) < 2:
            continue
        sets = [np.frombuffer(members[int(k)].as_py(), np.uint64) for k in at]
        if firsts[first] != seconds[first]:
            left, right = (np.flatnonzero(chunks[at] == c) for c in (firsts[first], seconds[first]))
            if not len(left) or not len(right):
                continue
        else:
            left = right = np.arange(len(rid))
        linked = _linked([sets[k] for k in left], [sets[k] for k in right])
        weight = docs[at].astype(np.float64)
        links = np.zeros(len(rid), np.int64)
        if left is right:
            np.fill_diagonal(linked, False)
            links[left] = linked @ weight[right]
        else:
            links[left] = linked @ weight[right]
            links[right] = weight[left] @ linked
        some = np.flatnonzero(links)
        roots, others = _stars(linked, left, right, some)
        a = np.concatenate([rid[some], rid[roots]])
        b = np.concatenate([np.full(len(some), -1), rid[others]])
        counted = np.concatenate([links[some], np.full(len(roots), -1)])
        out.append((a, b, counted, np.full(len(a), wholes[first])))
    if out:
        a, b, counted, whole = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b, mask=b < 0), pa.array(counted, mask=counted < 0), pa.array(whole)],
            names=["a", "b", "links", "whole"],
        )


def _stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots and the rows that chains of links join them to; a class's root is its least row."""
    at_left, at_right = (np.full(max(left.max(), right.max()) + 1, -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    free = np.zeros(len(at_left), bool)
    free[some] = True
    roots, others = [], []
    for root in some:
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            p = queue.pop()
            new = []
            if at_left[p] >= 0:
                new.append(right[linked[at_left[p]] & free[right]])
            if at_right[p] >= 0 and left is not right:
                new.append(left[linked[:, at_right[p]] & free[left]])
            for found in new:
                free[found] = False
                others.append(found)
                roots.append(np.full(len(found), root))
                queue += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(roots), np.concatenate(others)) if roots else (none, none)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) -> (doc_id, text_hash, set_id, n, sig)."""
    for batch in batches:
        texts = utf8(batch.column(2))
        for a, b, data, offsets in text_slices(texts):
            sets, bounds = shingles(data, offsets)
            ids, values = set_ids(sets, bounds), signatures(sets, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([x.tobytes() for x in values], pa.binary()),
                ],
                names=["doc_id", "text_hash", "set_id", "n", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, sig) -> a row (band, rid) for each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = band_keys(_matrix(pa.chunked_array([batch.column(1)]), np.uint16, HASHES))
        rid = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rid)], names=["band", "rid"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, comp, n_docs, text) -> (rid, comp, n_docs, members)."""
    for batch in batches:
        texts = utf8(batch.column(3))
        for a, b, data, offsets in text_slices(texts):
            sets, bounds = shingles(data, offsets)
            rows = [sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(rows, pa.binary())],
                names=["rid", "comp", "n_docs", "members"],
            )


def _by_chunk_pairs(rows: DataFrame, chunks: str) -> DataFrame:
    """rows once for each pair of chunks (i <= j) of its key that its own chunk belongs to."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col(chunks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)).alias("other")
    return rows.select("*", other).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))


def describe(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_of(text_column)
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, _describe, f"doc_id {id_type}, text_hash bigint, set_id binary, n bigint, sig binary")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives (rid, sig), a forest of those that pruning leaves in each bucket."""
    bands = map_arrow(reps.select("rid", "sig"), _bands, "band bigint, rid bigint")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = bands.join(shared, "band").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    met = _by_chunk_pairs(met, "chunks").select("band", "i", "j", "rid")
    met = met.join(reps.select("rid", "sig"), "rid").select("band", "i", "j", "rid", "sig")
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return map_arrow(met, grouped(_candidate_edges, 3), "a bigint, b bigint")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_same) of each row of docs."""
    spark = docs.sparkSession
    paths = {n: work_path(spark, f"jaccard-{n}") for n in ("rows", "reps", "edges", "members", "links", "classes")}
    rows = materialize(describe(docs, id_column, text_column), paths["rows"])
    reps = rows.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.min("doc_id").alias("least_id"),
        F.count(F.lit(1)).alias("n_docs"),
        F.first("n").alias("n"),
        F.first("sig").alias("sig"),
    )
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), paths["reps"])
    edges = materialize(candidate_edges(reps), paths["edges"])
    comps = components(edges)
    trim_driver(spark)
    found = materialize(_verified(docs, reps, comps, id_column, text_column, paths["members"]), paths["links"])
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    # The forest of a whole component consists of stars around the least row; those of chunks need joining.
    tree = found.where("b is not null").select("a", "b", "whole")
    roots = tree.where("whole").select(F.col("b").alias("node"), F.col("a").alias("root"))
    parts = tree.where("not whole").select("a", "b")
    if not parts.isEmpty():
        roots = roots.unionByName(components(parts))
    trim_driver(spark)
    slim = reps.select("set_id", "rid", "least_id", "n_docs")
    slim = slim.join(links, slim.rid == links.a, "left").join(roots, slim.rid == roots.node, "left")
    slim = slim.withColumn("root", F.coalesce("root", "rid"))
    class_ids = slim.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("n_reps"))
    joined = join_counted(slim.drop("a", "node"), class_ids, "root", "n_reps", reps.count())
    classes = joined.select(
        "set_id",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        F.col("n_docs").alias("n_same"),
    )
    classes = materialize(classes, paths["classes"])
    remove(spark, *(paths[n] for n in ("edges", "links", "reps", "members")))
    return join_counted(rows.select("doc_id", "set_id"), classes, "set_id", "n_same", rows.count()).drop("set_id")


def _verified(
    docs: DataFrame, reps: DataFrame, comps: DataFrame, id_column: str, text_column: str, path: str
) -> DataFrame:
    """Counts of links and forests of links of the components, see _verify; path: for the components' members."""
    members = reps.join(comps, reps.rid == comps.node).select("rid", F.col("root").alias("comp"), "n_docs", "n", "rep")
    chunks = F.ceil(F.greatest(F.sum("n") / CHUNK_SHINGLES, F.count(F.lit(1)) / CHUNK_ROWS)).cast("int")
    sizes = members.groupBy("comp").agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("n_members"))
    members = join_counted(members, sizes, "comp", "n_members", reps.count())
    members = materialize(members, path)
    text = text_of(text_column)
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keys = members.select(
        "rid", "comp", "n_docs", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")
    )
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    mine = (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    texts = source.join(keys, mine).select("rid", "comp", "n_docs", "text")
    sets = map_arrow(texts, _members, "rid bigint, comp bigint, n_docs bigint, members binary")
    sets = sets.join(members.select("rid", "chunks"), "rid")
    whole = (F.col("chunks") == 1).alias("whole")
    sets = _by_chunk_pairs(sets, "chunks").select("comp", "i", "j", "chunk", whole, "rid", "n_docs", "members")
    sets = sets.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return map_arrow(sets, grouped(_verify, 3), "a bigint, b bigint, links bigint, whole boolean")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with all their columns, one document for each class: the one whose id is the class's.

    Ids tell documents apart here; rows that repeat one id stay or go together. A null id stays only in a class of
    null ids. Columns of any name come back as they were.
    """
    classes = jaccard_join(docs, id_column, text_column)
    mark = f"__{uuid.uuid4().hex}"
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(stay, docs[id_column].eqNullSafe(stay[mark]), "left_semi")
