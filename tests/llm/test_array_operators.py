"""Operators that work on arrays of a text column, against plain Python."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tesela.llm import decontamination, ngram_jaccard, quality, toxicity
from tesela.llm.bpe import Encoder, Vocabulary
from tesela.llm.common import utf8
from tesela.llm.token_counts import Counter
from tesela.llm.wordhash import LOWER

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
PIECES = [
    "ab", "é", "1", " ", "  ", "\n", "\t", "'s", "don't", "$$", "<|endoftext|>", "<|endof", "text|>", "日本", "😀", " the",
    "a" * 60, "\x1c", "\x85", "½", "", "\0 ",
]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["", " ", "a" * 3000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_bpe_equals_the_library():
    library, own = tokenizers.Tokenizer.from_file(PATH), Encoder(Vocabulary(PATH), remembered=500)
    some = texts(1, 1500, 40)
    for k in range(0, len(some), 100):
        for text, packed in zip(some[k : k + 100], own.encode(some[k : k + 100])):
            ids = np.frombuffer(packed, "<u4")
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert own.vocab.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 20), (200, 16)])
def test_token_counts_equal_the_library(chunk, overlap):
    counter = Counter(PATH, chunk, overlap, remembered=300)
    for text in texts(2, 200, 250):
        assert counter.count([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False))]
    assert counter.widened


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(LOWER)))


def test_decontamination_equals_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        vocabulary = ["a", "bb", "C", "dé", "e1", "the"][: rng.randint(1, 6)]
        some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
        items = [(str(i), some(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(8)]
        docs = [some(rng.randint(0, 80)) for _ in range(8)] + [items[3][1] + " zz " + items[5][1], "", None]
        found = decontamination.search_texts(utf8(pa.array(docs)), decontamination.build(items))
        windows = []
        for i, text in items:
            w = plain_words(text)
            m = min(13, len(w))
            windows += [(i, w[k : k + m]) for k in range(len(w) - m + 1) if m]
        for doc, (n, hit, names) in zip(docs, found):
            w, covered, own = plain_words(doc), set(), set()
            for i, p in windows:
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        covered |= {*range(k, k + len(p))}
                        own.add(i)
            assert (n, hit.tolist(), set(names)) == (len(w), sorted(covered), own)


def test_pruning_keeps_what_reaches_the_threshold():
    least = ngram_jaccard.least_matches()
    assert 0 < least[252] < 0.8 * 252 and (np.diff(least) >= 0).all()
    sets = [np.unique(np.random.default_rng(k).integers(0, 60, 40)).astype(np.uint64) for k in range(6)]
    both = ngram_jaccard.common_members(sets, sets)
    pairs = [(i, j) for i in range(6) for j in range(6) if i != j]
    assert all(both[i, j] == len({*sets[i].tolist()} & {*sets[j].tolist()}) for i, j in pairs)


def labelled(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(n)]
    return clean, rng, words


def test_quality_learns_junk():
    clean, rng, words = labelled(5, 120)
    junk = [" | ".join(rng.choices(words, k=60)) for _ in range(60)] + [f"{rng.choice(words)} " * 50 for _ in range(60)]
    train, test = utf8(pa.array(clean[:80] + junk[::2])), utf8(pa.array(clean[80:] + junk[1::2]))
    weights = quality.train(train, np.array([1] * 80 + [0] * 60))
    scores = quality.score_texts(test, weights)
    assert (scores[:40] > 0.7).all() and (scores[40:] < 0.7).mean() > 0.95
    assert np.isfinite(quality.score_texts(utf8(pa.array(["", None, "x" * 100_000])), weights)).all()


def test_factorization_machine_learns_a_pair():
    clean, rng, words = labelled(6, 400)
    marked = [t.split()[:6] + rng.choice([["insult"], ["group"], ["insult", "group"], []]) for t in clean]
    labels = np.array([int("insult" in t and "group" in t) for t in marked])
    column = utf8(pa.array([" ".join(t) for t in marked]))
    machine = toxicity.train(column.slice(0, 300), labels[:300], epochs=30)
    right = (toxicity.score_texts(column.slice(300), machine) >= 0.5) == labels[300:]
    assert right.mean() > 0.9
    empty = toxicity.train(utf8(pa.array([], pa.string())), np.zeros(0, int))
    assert toxicity.score_texts(utf8(pa.array(["", "a"])), empty).tolist() == [0.5, 0.5]


def test_factorization_machine_learns_a_pair_with_a_term_that_shows_nothing_alone():
    """The group is in half of the toxic and half of the clean texts; without it 7 of 8 texts can be told at best."""
    clean, _, _ = labelled(8, 800)
    marks = ["mild group", "insult", "mild", "group", "", "group", "group", "mild"]
    texts = [" ".join([*t.split()[:6], marks[k % 8]]) for k, t in enumerate(clean)]
    labels = np.array([int(k % 8 < 2) for k in range(800)])
    column = utf8(pa.array(texts))
    group = toxicity.terms(np.frombuffer(b"group", np.uint8), np.array([0, 5]))[0]
    assert np.isin(group, toxicity.choose_terms(column.slice(0, 600), labels[:600])).all()
    machine = toxicity.train(column.slice(0, 600), labels[:600], epochs=30)
    right = (toxicity.score_texts(column.slice(600), machine) >= 0.5) == labels[600:]
    assert right.mean() > 7 / 8
