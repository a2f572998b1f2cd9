"""Token counts of whole texts, as a tokenizers library file gives them.

Huge texts are encoded as overlapping chunks with offsets. Two neighbours are spliced where both begin a pretoken at
the same character: from there on both see the same text, and pretokens don't look back, so what follows is the
same in both. In the left chunk only pretokens that began well before its end count as proven, since its cut can
change the last ones. Where no such boundary lies in the overlap, the overlap is widened, until it covers the
whole left chunk.

Other texts are cut into units at single spaces between two other characters. No pretoken spans such a cut, so
these boundaries are proven as well; a unit's count is remembered (a bounded memory of each worker).

Defined results: null and empty texts have no bytes and no tokens. Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesela.llm.bpe import _CUT, _EDGE, FIRST
from tesela.llm.common import map_arrow, text_of, text_slices, utf8

#: Characters of a chunk; longer texts are chunked.
CHUNK = 16_384
#: Characters that neighbours share at first.
OVERLAP = 256
#: Units that a worker remembers at most.
REMEMBERED = 400_000


class Counter:
    """Counts the tokens of texts with one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.remembered = chunk, overlap, remembered
        #: A cut inside a special string can change pretokens this far back.
        self.margin = max([len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()], default=0) + 2
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.widened = 0

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    @staticmethod
    def _begins(encoding, first: int, last: int) -> dict[int, int]:
        """Characters in [first, last) at which a pretoken begins, with the index of its first token."""
        at = None
        for c in range(first, last):  # a character may belong to no token of its own
            if (at := encoding.char_to_token(c)) is not None:
                break
        found: dict[int, int] = {}
        if at is None:
            return found
        for i in range(at, len(encoding)):
            begin = encoding.token_to_chars(i)[0]
            if begin >= last:
                break
            if begin >= first and (i == 0 or encoding.token_to_word(i) != encoding.token_to_word(i - 1)):
                found.setdefault(begin, i)
        return found

    def count_huge(self, text: str) -> int:
        """Tokens of a text by overlapping chunks."""
        n, total = len(text), 0
        base, end = 0, min(n, self.chunk)  # what the left chunk covers
        left, used = self._encode(text[base:end]), 0  # its tokens before used are counted
        spliced = 0  # the character at which token used begins: a proven boundary
        while end < n:
            shared = self.overlap
            while True:
                begin = end - shared
                if begin <= spliced:
                    # The overlap covers all that isn't counted yet; start over at the proven boundary, twice as far.
                    base, used, end = spliced, 0, min(n, end + max(self.chunk, end - spliced))
                    left = self._encode(text[base:end])
                    break
                stop = min(n, begin + max(self.chunk, 2 * shared))
                right = self._encode(text[begin:stop])
                proven = self._begins(left, begin - base, end - base - self.margin)
                theirs = self._begins(right, 0, end - begin)
                common = next((c for c in proven if c + base - begin in theirs and c + base > spliced), None)
                if common is not None:
                    total += proven[common] - used
                    spliced = common + base
                    used, base, end, left = theirs[spliced - begin], begin, stop, right
                    break
                self.widened += 1
                shared *= 2
        return total + len(left) - used

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        jobs: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.count_huge(text)
            elif any(s in text for s in self.specials):
                out[i] = len(self._encode(text))
            elif text:
                units = _CUT.split(text) if _EDGE.search(text) else text.split(" ")
                units[0] = FIRST + units[0]
                jobs.append((i, units))
        new = set().union(*(u for _, u in jobs)).difference(self.known)
        if len(self.known) + len(new) > self.remembered and self.known:
            self.known.clear()
            new = set().union(*(u for _, u in jobs))
        if new:
            order = list(new)
            found = self.tokenizer.encode_batch_fast(
                [u[1:] if u.startswith(FIRST) else " " + u for u in order], add_special_tokens=False
            )
            self.known.update(zip(order, map(len, found)))
        find = self.known.__getitem__
        for i, units in jobs:
            out[i] = sum(map(find, units))
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, with the tokenizers file at path, which every executor has."""
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _counters:
            _counters[path] = Counter(path)
        worker = _counters[path]
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for a, b, _, offsets in text_slices(texts, 4 << 20):
                counts = worker.count(texts.slice(a, b - a).to_pylist())
                sizes = pa.array(offsets[1:] - offsets[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return map_arrow(source, run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
