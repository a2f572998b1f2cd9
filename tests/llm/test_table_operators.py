"""Operators on whole tables, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tesela.llm import bpe, decontamination, lm, quality, token_counts, toxicity, warc
from tesela.llm.components import components
from tesela.llm.line_dedup import line_dedup
from tesela.llm.ngram_jaccard import jaccard_join
from tesela.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, class_id long, n_tokens long, band long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    docs = [rng.choices(words, k=rng.randint(1, 60)) for _ in range(n)]
    for k in range(n):
        copy = list(docs[rng.randrange(n)])
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = "zz"
        docs.append(copy)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    return rows + [(900, None), (901, ""), (902, "x " * 30_000), (3, rows[3][1]), (None, rows[5][1])]


def test_jaccard_join_equals_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, jaccard_join(frame(spark, rows)).collect()), key=str)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", t or "")
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
        want.append((rows[i][0], min(rows[j][0] for j in seen if rows[j][0] is not None), len(linked[i]), sets.count(sets[i])))
    assert got == sorted(want, key=str)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (1, 1)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (7, 7), (8, 7), (9, 7)}


def test_lm_counts_equal_brute_force(spark):
    rows = corpus(2)
    out = lm.lm_scores(frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0).collect()
    tokens = lambda t: re.findall(r"[^ \t-\r]+", t or "") + [None]
    train = [t for i, t in rows if (1 if i is None else i) % 3 != 0]
    count = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in out) == want
    base = {i: sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens(t)) for i, t in rows}
    assert all(r.train_tokens == total and abs(r.base_score - base[r.doc_id]) < 1e-6 * abs(base[r.doc_id]) for r in out)
    held = [r for r in out if not r.learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_line_dedup(spark):
    long = "w " * 60
    rows = [
        (1, "a b\nc d\ne f\ng h\ni j"), (2, "x\nc d\ne f\ng h\nq"), (3, "c d\ne f\nzzz"), (4, long), (5, f"hello\n{long}\nbye"),
        (6, None), (7, ""), (8, "\n\n"), (9, "l1\nl2\nl3\nl4\nl1\nl2\nl3"), (10, "a b\nc d\n\ne f\ng h"), (10, "a b\nc d\n\ne f\ng h"),
    ]
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == [
        (1, 5, 0, rows[0][1]), (2, 5, 3, "x\nq"), (3, 3, 0, rows[2][1]), (4, 1, 0, long), (5, 3, 1, "hello\nbye"), (6, 0, 0, ""),
        (7, 0, 0, ""), (8, 0, 0, "\n\n"), (9, 7, 3, "l1\nl2\nl3\nl4"), (10, 4, 4, ""), (10, 4, 4, ""),
    ]


def without_repeats(rows):
    """The rows' texts without lines that lie in a run of 3 lines or 50 words of an earlier place, by brute force."""
    trimmed = [[(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((t or "").split("\n"))] for _, t in rows]
    docs = [[(k, x) for k, x in lines if x] for lines in trimmed]
    out = []
    for d, mine in enumerate(docs):
        gone = set()
        for e in range(d + 1):
            theirs = docs[e]
            for i, j in ((i, j) for i in range(len(mine)) for j in range(i if e == d else len(theirs))):
                size = 0
                while i + size < len(mine) and j + size < len(theirs) and mine[i + size][1] == theirs[j + size][1]:
                    size += 1
                if size >= 3 or sum(len(mine[i + k][1].split()) for k in range(size)) >= 50:
                    gone.update(mine[i + k][0] for k in range(size))
        lines = (rows[d][1] or "").split("\n")
        out.append((rows[d][0], len(mine), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_of_frequent_lines(spark):
    """Each unit of doc 4 leads first to another document, which shares only a part of what doc 3 shares."""
    rows = [(1, "a\nb\nq"), (2, "b\nc\nr"), (3, "a\nb\nc"), (4, "a\nb\nc")]
    rng = random.Random(7)
    lines = [f"line {k}" + " w" * rng.choice([0, 0, 5, 18, 28, 46, 60]) for k in range(25)]
    rows += [(k, "\n".join(rng.choices(lines + [""], k=rng.randint(1, 9)))) for k in range(10, 150)]
    rows += [(k, rows[rng.randrange(100)][1]) for k in range(200, 230)] + [(300, "\n".join(lines[:2] * 9))]
    got = [tuple(r) for r in line_dedup(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got[3] == (4, 3, 3, "") and got == without_repeats(rows)


def test_line_dedup_of_two_line_passages(spark):
    """Passages of two lines that have 50 words only together, between lines of their own; 49 words stay."""
    rows = []
    for k in range(24):
        short = 1 + k if k % 2 else 4
        passage = [f"s{k}" + " w" * (short - 1), f"t{k}" + " w" * (49 - short - (k == 23))]
        for i in (k, 100 + k):
            rows.append((i, "\n".join([f"{i} before", f"{i} b", *passage, f"{i} after", f"{i} a"])))
    rows.sort()
    got = [tuple(r) for r in line_dedup(frame(spark, rows)).orderBy("doc_id").collect()]
    assert [r[2] for r in got] == [0] * 24 + [2] * 23 + [0] and got == without_repeats(rows)


def test_line_dedup_of_other_white_space(spark):
    tabs = "\t".join(["w"] * 50)
    rows = [
        (1, "a b\nc d\ne f"), (2, "a b\r\nc d\t\r\n\r\n\t\r\n\ve f\f\r\nown\r\n"), (3, f"x\n{tabs}"), (4, f"{tabs}\r\ny"),
        (5, "\t\n\r\n \v"),
    ]
    got = [tuple(r) for r in line_dedup(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == without_repeats(rows)
    assert got[1:] == [(2, 4, 3, "\r\n\t\r\nown\r\n"), (3, 2, 0, rows[2][1]), (4, 2, 1, "y"), (5, 0, 0, rows[4][1])]


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    train = F.lit(True)
    for out in (
        jaccard_join(docs), lm.lm_scores(docs, train), line_dedup(docs), bpe.encode(docs, tokenizer_path()),
        token_counts.token_counts(docs, tokenizer_path()), decontamination.find_occurrences(docs, items),
        quality.score(docs, quality.fit(docs, labels, "quality", train)),
        toxicity.score(docs, toxicity.fit(docs, labels, "toxic", train)),
    ):
        assert out.collect() == []


def test_benchmark_in_blocks(spark):
    items = spark.createDataFrame([(k, f"one{k} two three") for k in range(9)], "item_id long, text string")
    docs = frame(spark, [(1, "x one3 two three y one7 two three"), (2, None), (3, "one9")])
    whole, blocks = (
        sorted(map(tuple, decontamination.find_occurrences(docs, items, block_bytes=b).collect())) for b in (1 << 20, 40)
    )
    assert whole == blocks and whole[0] == (1, 8, [1, 2, 3, 5, 6, 7], ["3", "7"])


def test_bpe_frame(spark):
    row = bpe.encode(frame(spark, [(1, "hello  world")]), tokenizer_path()).first()
    assert row.decoded == "hello  world" and len(row.ids) == 4 * row.n_tokens
    assert hashlib.sha256(bytes(row.ids)).hexdigest()
    pytest.importorskip("public_tokenizers")


def test_a_text_of_one_line_repeated(spark):
    """Cost grows with the lines, not with their square. Lines 1 to 3 equal lines 0 to 2, so all but line 0 go."""
    rows = [(1, "the same line\n" * 200_000), (2, "a\nb\nc\nd"), (3, "z\nb\nc\nd\ny"), (2, "a\nb\nc\nd")]
    out = sorted((r.doc_id, r.n_lines, r.n_removed, len(r.text)) for r in line_dedup(frame(spark, rows)).collect())
    assert out == [(1, 200_000, 199_999, 14), (2, 4, 0, 7), (2, 4, 0, 7), (3, 5, 3, 3)]
