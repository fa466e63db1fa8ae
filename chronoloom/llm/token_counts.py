"""Token counts by heap-and-linked-list byte-pair merging.

A piece's symbols form a doubly linked list; a heap holds the adjacent pairs by
(rank, place). The lowest-rank pair is popped and merged until none is left, and
the count is the initial symbols less the merges: no identifier is looked up or
emitted. A piece's count depends on nothing else, so a bounded cache keeps it.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
are counted each; very long texts and pieces take n log n steps; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import vocabulary
from .common import bounded_batches

#: Pieces of which a worker remembers the count; the table is emptied when full.
CACHE = 400_000


class Counter:
    def __init__(self, path: str):
        model = vocabulary.load(path)["model"]
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = vocabulary.byte_letters()
        self.path = path
        self.strings = vocabulary.specials(path)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.strings, key=len, reverse=True)))
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> tuple[list[str | None], int]:
        """The symbol list of one pre-token after all merges (None where merged away), and their number."""
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # a neighbour has merged meanwhile
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return symbols, merges

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token: symbols less merges."""
        symbols, merges = self.merged(piece)
        return len(symbols) - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in vocabulary.pre_tokens(text, self.path):
            n = known.get(piece)
            if n is None:
                n = self.piece(piece)
                if len(piece) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one."""
        if not any(x in text for x in self.strings):
            return self.plain(text)
        found = self.special.findall(text)
        return len(found) + sum(self.plain(x) for x in self.special.split(text))


_counters: dict[str, Counter] = {}


def _count(path: str, limit: int):
    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            tokens = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return source.mapInArrow(_count(path or vocabulary.default_path(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
