"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it wherever the hash of the last
`SIGHT` bytes ends in zeros, so equal passages give equal chunks whatever stands
before them. A chunk's core (from its first to its last white space) is encoded
once by a worker and kept in a bounded table; a task encodes a chunk at most once
for each fill of the table, and the table goes when the task ends. What lies between two cores is
the join. It is re-encoded together with whole words from both sides, one more
word at a time, until the tokens of those words agree exactly with their own
encoding; then join and cores put together are the tokens of the whole text.
Where no agreement comes before the text's ends, the text is encoded as a whole.

Decoding turns each core and join back and puts them together in the same way
(this vocabulary has no decoder of its own: tokens are joined by a space).

Defined results: null and empty texts give no tokens and an empty decoded text;
repeated rows are encoded each; further columns are ignored by `encode` and
`digests`; an empty table gives an empty result. Special strings inside a text
become their token, as the library does it.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vocabulary
from .common import bounded_batches, lean, mix, powers, steps

_U = np.uint64
SIGHT = 16
#: A cut about every so many bytes, a power of two.
CHUNK = 1024
#: Bytes of encoded pieces that a worker remembers; the older half goes when the newer is full.
CACHE_BYTES = 16 << 20
#: Pre-tokens that a worker remembers, likewise.
CACHE_WORDS = 200_000
_BASE = 0xD6E8FEB86659FD93
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)


def cuts(data: np.ndarray) -> np.ndarray:
    """Content-defined places, each before the first byte of a character."""
    n = len(data)
    if n <= SIGHT:
        return np.zeros(0, dtype=np.int64)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_VALUE[data] * powers(_U(_BASE), n), out=sums[1:])
    back = powers(_U(pow(_BASE, -1, 1 << 64)), n)
    h = mix((sums[SIGHT:] - sums[:-SIGHT]) * back[: n - SIGHT + 1])
    at = np.flatnonzero(h[:-1] & _U(CHUNK - 1) == 0) + SIGHT
    return at[(data[at] & 0xC0) != 0x80]


class Piece:
    """ids as little-endian 32-bit integers, and the decoded bytes."""

    __slots__ = ("ids", "text")

    def __init__(self, ids: bytes, text: bytes):
        self.ids, self.text = ids, text


class Encoder:
    def __init__(self, path: str):
        self.library = vocabulary.library(path)
        if vocabulary.stated(path).get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder can be decoded piece by piece")
        self.special = vocabulary.specials(path)
        if any(any(c.isspace() for c in x) for x in self.special):
            raise ValueError("special strings with white space could lie across two chunks")
        self.names = [(self.library.id_to_token(i) or "").encode() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.path = path
        self.letters = vocabulary.byte_letters()
        # ids of each pre-token; the older half is dropped when the newer is full
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, Piece] = {}
        self.older: dict[str, Piece] = {}
        self.held = 0
        gc.set_threshold(200_000, 50, 100)  # lists of pre-tokens come and go; none is part of a cycle

    def _learn(self, words: set[str]) -> None:
        """Ids of pre-tokens that are not in the newer half of the table."""
        if len(self.words) + len(words) > CACHE_WORDS // 2:
            self.old, self.words = self.words, {}
        own, old, tokenize, letters = self.words, self.old, self.library.model.tokenize, self.letters
        for w in words:
            if (ids := old.get(w)) is None:
                ids = b"".join([x.id.to_bytes(4, "little") for x in tokenize("".join([letters[b] for b in w.encode()]))])
            own[w] = ids

    def _fresh(self, texts: list[str]) -> list[bytes]:
        """Ids of chunk texts: the stated split, then the merges of each distinct pre-token;
        texts with special strings go to the library."""
        special = [any(x in text for x in self.special) for text in texts]
        some = [x for x, odd in zip(texts, special, strict=True) if odd]
        whole = iter(self.library.encode_batch_fast(some, add_special_tokens=False) if some else ())
        split = [None if odd else vocabulary.pre_tokens(x, self.path) for x, odd in zip(texts, special, strict=True)]
        every = set().union(*(x for x in split if x))
        if new := every - self.words.keys():
            self._learn(new)
            if missing := every - self.words.keys():  # the table has turned over
                self._learn(missing)
        ids = self.words.__getitem__
        return [np.asarray(next(whole).ids, dtype="<u4").tobytes() if x is None else b"".join(map(ids, x)) for x in split]

    def piece(self, ids: bytes) -> Piece:
        return Piece(ids, b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())))

    def pieces(self, texts: list[str]) -> dict[str, Piece]:
        """Each distinct text encoded once, from the table where it is there."""
        out = {x: self.known.get(x) or self.older.get(x) for x in texts}
        new = [x for x, p in out.items() if p is None]
        out |= zip(new, map(self.piece, self._fresh(new)), strict=True)
        for x, p in out.items():
            if x not in self.known:
                size = len(x) + len(p.ids) + len(p.text) + 300
                if self.held + size > CACHE_BYTES // 2:
                    self.older, self.known, self.held = self.known, {}, 0
                self.known[x] = p
                self.held += size
        return out

    def _join_agrees(self, left: str, join: str, right: str) -> bool:
        """Tokens of the join with both edges are those of the three put together."""
        whole, *apart = self._fresh([left + join + right, left, join, right])
        return whole == b"".join(apart)

    @staticmethod
    def plan(raw: bytes, places: list[int]) -> list[bytes]:
        """Cores at even places, joins at odd ones (the text's ends make joins too)."""
        parts: list[bytes] = [b""]
        at = 0  # the start of the join under way
        for a, b in zip([0, *places], [*places, len(raw)], strict=True):
            first = min((k for k in (raw.find(c, a, b) for c in (b" ", b"\n", b"\t", b"\r")) if k >= 0), default=-1)
            last = max(raw.rfind(c, a, b) for c in (b" ", b"\n", b"\t", b"\r"))
            if first < 0 or last <= first:
                continue  # no core: this chunk belongs to the join
            parts += [raw[at:first], raw[first : last + 1]]
            at = last + 1
        return [*parts, raw[at:]]

    def encode(self, raws: list[bytes], places: list[list[int]]) -> list[list[Piece]]:
        """For each text the pieces that make up its tokens."""
        texts = [[x.decode() for x in self.plan(raw, p)] for raw, p in zip(raws, places, strict=True)]
        wanted: dict[str, None] = {}
        for parts in texts:
            wanted.update(dict.fromkeys(x for x in parts if x))
        done = self.pieces(list(wanted))
        joins = []
        for k, parts in enumerate(texts):
            for j in range(1, len(parts), 2):
                # with one whole word of each side, unless blank edges already part the join from both
                left, right = self._edge(parts[j - 1], 1, True), self._edge(parts[j + 1], 1, False) if j + 1 < len(parts) else ""
                if parts[j]:
                    joins.append((k, j, left, parts[j], right))
        fresh = iter(self._fresh([x for _, _, left, join, right in joins for x in (left + join + right, left, right)]))
        whole: set[int] = set()
        for k, j, left, join, right in joins:
            both, one, two = next(fresh), next(fresh), next(fresh)
            if k not in whole and both != one + done[join].ids + two and not self._widened(texts[k], j):
                whole.add(k)
        return [[self.piece(*self._fresh(["".join(parts)]))] if k in whole else [done[x] for x in parts if x] for k, parts in enumerate(texts)]

    @staticmethod
    def _edge(core: str, words: int, tail: bool) -> str:
        """The last (or first) whole words of a core, with the blanks up to its edge."""
        found = core.split()
        if not found:
            return core
        if tail:
            at = len(core)
            for w in reversed(found[-words:]):
                at = core.rindex(w, 0, at)
            return core[at:]
        at = 0
        for w in found[:words]:
            at = core.index(w, at) + len(w)
        return core[:at]

    def _widened(self, parts: list[str], j: int) -> bool:
        """Takes in one more word of each side until the join's tokens agree, or the cores end."""
        core_l, join, core_r = parts[j - 1], parts[j], parts[j + 1] if j + 1 < len(parts) else ""
        words, before = 2, None
        while (edges := (self._edge(core_l, words, True), self._edge(core_r, words, False))) != before:
            if self._join_agrees(edges[0], join, edges[1]):
                return True
            words, before = words + 1, edges
        return False


_encoders: dict[str, Encoder] = {}


def forget(path: str) -> None:
    """Empty the tables: a worker lives on after its task, and what other tasks do needs the memory."""
    if encoder := _encoders.get(path):
        encoder.words, encoder.old, encoder.known, encoder.older, encoder.held = {}, {}, {}, {}, 0


def _forgetful(run, path: str):
    """run, after which its worker keeps nothing but the vocabulary."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            forget(path)

    return lean(inner)


def encoded(path: str, texts: pa.Array):
    """For each text of a column its list of pieces, in steps of bounded bytes."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    for at, to in steps(texts):
        raws = [(x or "").encode() for x in texts.slice(at, to - at).to_pylist()]
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        places, base = [], 0
        for raw in raws:
            places.append(cuts(data[base : base + len(raw)]).tolist())
            base += len(raw)
        yield from encoder.encode(raws, places)


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, ids (array of int), decoded (string)."""
    path = path or vocabulary.default_path()

    def run(batches):
        for batch in batches:
            start, ids, texts = 0, [], []
            size = 0

            def flush():
                values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

            for pieces in encoded(path, batch.column(1)):
                ids.append(b"".join(p.ids for p in pieces))
                texts.append(b" ".join(p.text for p in pieces if p.ids).decode())
                size += len(ids[-1])
                if size > 8 << 20:
                    yield flush()
                    start, ids, texts, size = start + len(ids), [], [], 0
            if ids:
                yield flush()

    return _source(docs).mapInArrow(_forgetful(run, path), "doc_id long, ids array<int>, decoded string")


def decode(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, decoded), by the library; null ids give an empty text."""
    path = path or vocabulary.default_path()

    def run(batches):
        library = vocabulary.library(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([library.decode(x or [], skip_special_tokens=False) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded_docs.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of what `encode` returns."""
    path = path or vocabulary.default_path()

    def run(batches):
        for batch in batches:
            n, one, two = [], [], []
            for pieces in encoded(path, batch.column(1)):
                ids, text = hashlib.sha256(), hashlib.sha256()
                count = 0
                for p in pieces:
                    if p.ids:
                        if count:
                            text.update(b" ")
                        ids.update(p.ids)
                        text.update(p.text)
                        count += len(p.ids) // 4
                n.append(count)
                one.append(ids.hexdigest())
                two.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(_forgetful(run, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
