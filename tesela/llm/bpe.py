"""Byte-level BPE encoding and decoding.

A word is encoded on a contiguous rank array: its parts and the ranks of adjacent pairs lie side by side; the least
rank is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank.
Here the arrays of many short words form the rows of a matrix, so that one scan serves all of them. Longer words
(over SHORT bytes) keep their pairs in a heap instead, so a word of a million bytes costs n log n.

Texts are cut into units at spaces between two other characters; no pretoken spans such a cut, so a unit's ids
don't depend on its neighbours and are remembered (a bounded memory of each task).

Defined results: null and empty texts have no ids and decode to the empty text. The special strings of the
vocabulary become their ids. Rows are independent; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import map_arrow, text_of, text_slices, utf8

#: Bytes of the longest word that the rank matrix takes.
SHORT = 48
#: Units that a task remembers at most; beyond it, it starts anew.
REMEMBERED = 400_000
#: Marks a unit at the beginning of a text; no UTF-8 text holds a lone surrogate.
FIRST = "\ud800"
#: Rows of a rank matrix.
ROWS = 1 << 14
NONE = np.iinfo(np.int32).max

#: The byte-level pattern of the public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PRETOKEN = regex.compile(PATTERN)
_EDGE = re.compile(r"^\s|\s$|\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        raw = {i: bytes(map(alphabet.__getitem__, token)) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw |= {i: content.encode() for content, i in self.special.items()}
        self.split_special = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.byte_ids = np.zeros(256, np.int32)
        for char, b in alphabet.items():
            self.byte_ids[b] = ids[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        joined = np.array([ids[a + b] for a, b in merges], np.int32)
        keys, first = np.unique(keys, return_index=True)
        self.pairs, self.rank_of, self.joined_of = keys, first.astype(np.int32), joined[first]
        self.pair_index = dict(zip(keys.tolist(), zip(self.rank_of.tolist(), self.joined_of.tolist())))
        top = max(raw) + 1
        self.lengths = np.array([len(raw.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(top)), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of adjacent parts and the parts they would make; NONE where they don't merge."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank_of[at], NONE), np.where(known, self.joined_of[at], -1)

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of 1 to SHORT bytes: rows of one matrix, -1 past the end of a word."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        width = int(lengths.max())
        parts = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        parts[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks, joined = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        column = np.arange(width + 1)
        done = parts.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            more = ranks[row, at] != NONE
            if not more.all():
                done[live[~more], : parts.shape[1]] = parts[~more]
                live, parts, ranks, joined, at = live[more], parts[more], ranks[more], joined[more], at[more]
                if not len(live):
                    break
                row = np.arange(len(live))
            parts[row, at] = joined[row, at]
            # Delete the boundary: all that stands after it moves one place to the left.
            later = column[: parts.shape[1] - 1] > at[:, None]
            parts[:, :-1] = np.where(later, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            gone = later[:, :-1]
            ranks[:, :-1] = np.where(gone, ranks[:, 1:], ranks[:, :-1])
            joined[:, :-1] = np.where(gone, joined[:, 1:], joined[:, :-1])
            ranks[:, -1], joined[:, -1] = NONE, -1
            ranks[row, at], joined[row, at] = self.pair_ranks(parts[row, at], parts[row, at + 1])
            left = np.flatnonzero(at > 0)
            before = at[left] - 1
            ranks[left, before], joined[left, before] = self.pair_ranks(parts[left, before], parts[left, before + 1])
        kept = done >= 0
        packed = done[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of a word of any length: linked parts, and a heap of (rank, place) with stale entries skipped."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.pair_index.get
        heap = [(hit[0], i) for i in range(n - 1) if (hit := find(parts[i] << 20 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n:
                continue
            hit = find(parts[i] << 20 | parts[j])
            if not hit or hit[0] != rank:
                continue
            parts[i], parts[j] = hit[1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (hit := find(parts[a] << 20 | parts[after[a]])):
                    heapq.heappush(heap, (hit[0], a))
        return np.array([p for p in parts if p >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each word."""
        out: list[bytes] = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if 0 < len(w) <= SHORT), key=lambda i: len(words[i]))
        for k in range(0, len(short), ROWS):
            chosen = short[k : k + ROWS]
            for i, ids in zip(chosen, self.encode_short([words[i] for i in chosen])):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.encode_long(w).astype("<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; malformed UTF-8 becomes U+FFFD. Ids that the vocabulary lacks are left out."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.bytes[source].tobytes().decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with one vocabulary and remembers units."""

    def __init__(self, vocab: Vocabulary, remembered: int = REMEMBERED):
        self.vocab, self.remembered = vocab, remembered
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """text cut at single spaces between other characters; a cut's space is left out."""
        return _CUT.split(text) if _EDGE.search(text) else text.split(" ")

    def _learn(self, units: Iterable[str]) -> None:
        """Unit keys: the unit without its leading space; those that have none begin with FIRST."""
        # Flat lists: a list for each unit would keep the garbage collector busy.
        order, found, ends = list(units), [], []
        for unit in order:
            found += _PRETOKEN.findall(unit[1:] if unit.startswith(FIRST) else " " + unit)
            ends.append(len(found))
        distinct = list(set(found))
        packed = dict(zip(distinct, self.vocab.encode_words([p.encode() for p in distinct])))
        parts = [packed[p] for p in found]
        at = 0
        for unit, end in zip(order, ends):
            self.known[unit] = parts[at] if end == at + 1 else b"".join(parts[at:end])
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        jobs: list[list[str] | bytes] = []
        spans = []
        for text in texts:
            begin = len(jobs)
            pieces = self.vocab.split_special.split(text) if self.vocab.split_special else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    jobs.append(self.vocab.special[piece].to_bytes(4, "little"))
                elif piece:
                    units = self.units(piece)
                    units[0] = FIRST + units[0]
                    jobs.append(units)
            spans.append((begin, len(jobs)))
        new = set().union(*(j for j in jobs if isinstance(j, list))).difference(self.known)
        if len(self.known) + len(new) > self.remembered and self.known:
            self.known.clear()
            new = set().union(*(j for j in jobs if isinstance(j, list)))
        if new:
            self._learn(new)
        find = self.known.__getitem__
        done = [j if isinstance(j, bytes) else b"".join(map(find, j)) for j in jobs]
        return [b"".join(done[a:b]) for a, b in spans]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", decode=True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids packed as little-endian 32-bit integers, decoded from those ids.

    path: a byte-level BPE file that every executor has. decoded is null where decode is false.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for a, b, _, _ in text_slices(texts, 4 << 20):
                packed = worker.encode(texts.slice(a, b - a).to_pylist())
                decoded = [worker.vocab.decode(np.frombuffer(p, "<u4")) for p in packed] if decode else [None] * (b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(decoded, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        worker.known.clear()  # what is remembered doesn't outlive a task, since idle workers stay

    return map_arrow(source, run, f"doc_id {id_type}, n_tokens bigint, ids binary, decoded string")
