"""Each stage of the pipeline, and all of them, against plain Python."""

import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from tesela.llm import quality, wordhash
from tesela.llm.common import utf8
from tesela.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BITS64 = (1 << 64) - 1


def tables():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    items = [" ".join(rng.choices(words, k=15)) for _ in range(4)] + ["tiny item", None, ""]
    junk = [" | ".join(rng.choices(words, k=40)) for _ in range(40)]
    near = [" ".join(["other", *t.split()[1:]]) for t in texts[:12]]
    leaks = [f"{t} {rng.choice(items[:4])}." for t in texts[20:26]] + [texts[30] + " Tiny, Item " + texts[31], "so tiny item"]
    rows = list(enumerate(texts + junk + near + leaks))
    rows += [(200 + k, texts[k]) for k in range(8, 16)] + [rows[40], rows[40], rows[60]]
    rows += [(None, texts[50]), (None, "alone " + texts[51][::-1]), (300, None), (301, ""), (302, None), (-1, texts[52])]
    labels = [(k, 1, None) for k in range(0, 60, 2)] + [(60 + k, 0, 1) for k in range(0, 40, 2)]
    labels += [(0, 0, 0), (4, None, 1), (None, 0, 0), (900, 0, 0)]
    docs = [(i, t, "en", f"source {k}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return docs, labels, list(enumerate(items)) + [(0, items[0])]


def word_hash(word):
    b = word.lower().encode()
    total = sum(int(wordhash._CODES[c]) * pow(int(wordhash._MULT), k, 1 << 64) for k, c in enumerate(b))
    return mix(total + len(b) * int(wordhash._LENGTH))


def mix(x):
    x &= BITS64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & BITS64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & BITS64
    return x ^ x >> 31


def good(docs, labels):
    marks = {}
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            marks[i] = max(q, marks.get(i, 0))
    sample = sorted(((d[0], d[1] or "") for d in docs if d[0] in marks))
    weights = quality.train(utf8(pa.array([t for _, t in sample], pa.string())), np.array([marks[i] for i, _ in sample], int))

    def score(text):
        h = [word_hash(w) for w in re.findall(r"[A-Za-z0-9]+|\|+|\.+|,+", text or "")]
        pairs = [int(quality.REPEAT) if a == b else mix(a * int(wordhash._MULT) + b) for a, b in zip(h, h[1:])]
        total = sum(float(weights[x >> (64 - quality.BITS)]) for x in h + pairs)
        return 1 / (1 + math.exp(-(total * quality.SCALE / max(1, len(h + pairs)) + float(weights[-1]))))

    return [d for d in docs if score(d[1]) >= corpus_pipeline.LEAST_QUALITY]


def no_copies(docs):
    """Of each text a row of the greatest id; if that id has several rows, any of them may stay."""
    best = {}
    for d in docs:
        other = best.get(d[1] or "")
        if other is None or (d[0] is not None and (other[0] is None or d[0] > other[0])):
            best[d[1] or ""] = d
    return list(best.values())


def no_near(docs):
    words = [re.findall(r"[^ \t-\r]+", d[1] or "") for d in docs]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, d in zip(group, docs):
        if d[0] is not None:
            least[g] = min(d[0], least.get(g, d[0]))
    stay = {d[0] for g, d in zip(group, docs) if d[0] == least.get(g)}
    return [d for d in docs if d[0] in stay]


def no_leaks(docs, items):
    tokens = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    windows = set()
    for _, t in items:
        w = tokens(t)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = []
    for d in docs:
        w = tokens(d[1])
        found = [range(k, k + len(x)) for x in windows for k in range(len(w)) if tuple(w[k : k + len(x)]) == x]
        hit = {k for r in found for k in r}
        if not hit:
            out.append(d)
    return out


def ids(docs):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    coded = [(d, library.encode(d[1] or "", add_special_tokens=False).ids) for d in docs]
    return [(d[0], len(x), np.array(x, "<u4").tobytes(), d[1] or "") for d, x in coded]


def write(spark, folder, docs, labels, items):
    for name, rows, schema in (
        ("documents", docs, SCHEMA),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def told(rows, columns=None):
    """Rows in one order, by their first columns."""
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)[:columns] for r in rows), key=str)


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    docs, labels, items = tables()
    write(spark, tmp_path, docs, labels, items)
    want = {
        "quality": lambda d: good(d, labels),
        "exact_dedup": no_copies,
        "near_dedup": no_near,
        "decontamination": lambda d: no_leaks(d, items),
        "bpe": ids,
    }
    assert list(want) == [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
        columns = 3 if name == "exact_dedup" else None
        expected = want[name](docs)
        assert told(got.collect(), columns) == told(expected, columns), name
        assert name == "bpe" or (0 < len(expected) < len(docs) and got.columns == ["doc_id", "text", "lang", "source", "n_chars"])
    rest = docs
    for name in want:
        rest = want[name](rest)
    assert len(rest) > 20
    assert told(corpus_pipeline.run(spark, str(tmp_path)).collect()) == told(rest)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
