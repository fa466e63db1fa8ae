"""Language-model scoring by context-tree weighting, and a unigram base score.

Every byte is eight binary decisions, each in a node of its own; a node's contexts
are the `DEPTH` bytes before it, and a text ends with a byte that UTF-8 never holds.
Counts come from the training documents. In each node of a tree the Krichevsky-
Trofimov estimate is mixed with what the deeper contexts say, by the weights that
their code lengths over the training counts earn (Willems, Shtarkov and Tjalkens,
1995), so a score is a proper log-probability of the whole text under one model.

No table of the model is ever in one place. Each task sends the distinct (context, byte)
grams and words of its texts with their training counts to buckets, which add them up;
grams that share the two latest context bytes (three, where two have a thousandth of all
grams) are brought together, where the tree is weighted bottom-up. What is left to do at
the shallow depths has at most 256 * 255 + 255 nodes, and 255 for each of at most 1,000
contexts of two bytes, and is finished at the driver. Documents are then dealt to blocks,
and each block gets a value for every gram of its own. Keys travel sorted, as packed
differences; buckets are read as streams, so that none is held but for its distinct keys.

The tree reads the text's bytes as they are, base_score its lower-cased words, and
bits_per_byte is the tree's code length over the bytes of the text and its end.

Defined results: null and empty texts consist of the end alone; repeated rows are
scored and learned from each; rows of null doc_id are scored and count as training;
a very long text makes its block as much larger; further columns are ignored; an empty table
gives an empty result, and without training rows every decision has probability 1/2.
Words are told apart by a 64-bit hash and the bucket of a second one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, Words, blob, bounded_batches, materialize, mix, parts, spread, steps, text_bytes

#: Bytes of text in a block: the longer, the fewer grams occur in several.
BLOCK_BYTES = 16 << 20
#: With more buckets than this, a block would send more messages than it has keys for.
MOST_BUCKETS = 1 << 14
DEPTH = 5
FOLDS = 10
END = 0xFF
_U = np.uint64
_WORD = 1  # kinds of keys: 0 grams, 1 words


def held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


# ---------------------------------------------------------------- keys of a block


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte and of the end (latest context byte first, the byte itself last), and bounds by text."""
    raws = [(x or "").encode() for x in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
    # before each text stand as many ends as a context holds
    padded = np.frombuffer(b"".join(bytes([END]) * DEPTH + r + bytes([END]) for r in raws), dtype=np.uint8)
    take = np.arange(bounds[-1]) + DEPTH * (np.repeat(np.arange(len(raws)), np.diff(bounds)) + 1)
    key = np.zeros(len(take), dtype=_U)
    for d in range(1, DEPTH + 1):
        key = (key << _U(8)) | padded[take - d].astype(_U)
    return (key << _U(8)) | padded[take].astype(_U), bounds


def _unique(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    return k[new], np.add.reduceat(counts[order], np.flatnonzero(new))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    k = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[at], np.diff(np.append(at, len(k)))


def _step_keys(part: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some texts in their order, and the text of each."""
    if kind == _WORD:
        words = Words(part, "space", lower=True)
        return words.hash, words.doc
    keys, bounds = _grams(part)
    return keys, np.repeat(np.arange(len(part)), np.diff(bounds))


class Tally:
    """Distinct keys of texts with their training counts."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, texts: pa.Array, train: np.ndarray, kind: int) -> None:
        for at, to in steps(texts, STEP_BYTES):
            keys, doc = _step_keys(texts.slice(at, to - at), kind)
            learn = train[at:to][doc]
            for some, weight in ((learn, 1), (~learn, 0)):
                k, n = _distinct(keys[some])
                self.put(k, n * weight)

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 4_000_000:
            k, n = self.take()
            self.keys, self.counts, self.size = [k], [n], len(k) // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All, ascending; nothing is left."""
        found = _unique(np.concatenate([np.zeros(0, dtype=_U), *self.keys]), np.concatenate([np.zeros(0, dtype=np.int64), *self.counts]))
        self.keys, self.counts, self.size = [], [], 0
        return found


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(raw, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(raw) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=_U)


def _by_bucket(keys: np.ndarray, buckets: int, kind: int):
    """An order by bucket that keeps the keys' own, and the bounds of each. Grams that share
    three context bytes share a bucket, so that differences of keys are small."""
    part = keys if kind == _WORD else keys >> _U(8 * (DEPTH - 2))
    bucket = (mix(part ^ _U(0xA0761D6478BD642F)) % _U(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _messages(keys: np.ndarray, buckets: int, kind: int):
    """(bucket, places of its keys) of each bucket that has any."""
    order, cut = _by_bucket(keys, buckets, kind)
    return [(kind * buckets + k, order[cut[k] : cut[k + 1]]) for k in range(buckets) if cut[k + 1] > cut[k]]


def _learn(buckets: int):
    """(text, held_out) to (bucket, keys, counts), a message for each bucket and BLOCK_BYTES of texts."""

    def flush(tallies):
        bucket, packed, counts = [], [], []
        for kind, tally in enumerate(tallies):
            keys, n = tally.take()
            for k, at in _messages(keys, buckets, kind):
                bucket.append(k)
                packed.append(pack_sorted(keys[at]))
                counts.append(pack(n[at].astype("<u4")))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "keys", "counts"])

    def run(batches):
        tallies, size = (Tally(), Tally()), 0
        for batch in batches:
            train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for kind, tally in enumerate(tallies):
                tally.add(batch.column(0), train, kind)
            size += batch.column(0).nbytes
            if size >= BLOCK_BYTES:
                yield flush(tallies)
                size = 0
        if size:
            yield flush(tallies)

    return run


def _totals(batches):
    """Messages in order of their bucket to (bucket, key, n) over all of them."""

    def flush(bucket, tally):
        keys, counts = tally.take()
        for at in range(0, len(keys), 100_000):
            k, n = keys[at : at + 100_000], counts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), bucket, dtype=np.int32)), pa.array(k.view(np.int64)), pa.array(n)], names=["bucket", "key", "n"])

    now, tally = None, Tally()
    for batch in batches:
        for bucket, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if bucket != now and now is not None:
                yield from flush(now, tally)
            now = bucket
            tally.put(unpack_sorted(keys.as_buffer()), unpack(counts.as_buffer(), "<u4").astype(np.int64))
    if now is not None:
        yield from flush(now, tally)


def _ask(buckets: int):
    """A block's distinct keys, for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        bucket, packed = [], []
        for kind in (0, _WORD):
            tally = Tally()
            tally.add(texts, np.zeros(len(texts), dtype=bool), kind)
            keys, _ = tally.take()
            for k, at in _messages(keys, buckets, kind):
                bucket.append(k)
                packed.append(pack_sorted(keys[at]))
        block = pa.array([table.column("_block")[0].as_py()] * len(bucket), pa.int32())
        return pa.table({"_block": block, "bucket": pa.array(bucket, pa.int32()), "keys": pa.array(packed, pa.binary()), "values": pa.nulls(len(bucket), pa.binary())})

    return run


# ---------------------------------------------------------------- the tree

_HALF = np.array([math.lgamma(k + 0.5) for k in range(256)])
_WHOLE = np.array([math.lgamma(k + 1.0) for k in range(256)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for arguments of 256 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    def half(n):
        return np.where(n < 256, _HALF[np.minimum(n, 255)], _log_gamma(np.maximum(n, 255) + 0.5))

    def whole(n):
        return np.where(n < 256, _WHOLE[np.minimum(n, 255)], _log_gamma(np.maximum(n, 255) + 1.0))

    return half(a) + half(b) - whole(a + b) - math.log(math.pi)


class Level:
    """Nodes of one context depth and one bit place, from (context, byte) numbers with counts."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, place: int):
        node = numbers >> _U(8 - place)
        bit = ((numbers >> _U(7 - place)) & _U(1)).astype(bool)
        new = np.ones(len(node), dtype=bool)
        new[1:] = node[1:] != node[:-1]
        start = np.flatnonzero(new)
        self.node = node[new]
        self.n0 = np.add.reduceat(np.where(bit, 0, counts), start)
        self.n1 = np.add.reduceat(np.where(bit, counts, 0), start)
        self.kt = log_kt(self.n0, self.n1)

    def parents(self, place: int) -> np.ndarray:
        """Number of each node in the tree one context byte shallower: the oldest byte, which
        stands just above the node's bits, falls out."""
        low = _U((1 << place) - 1)
        return ((self.node >> _U(place + 8)) << _U(place)) | (self.node & low)

    def weigh(self, below: np.ndarray | None) -> None:
        """log Pw and the log odds of stopping here; below: sums of the children's log Pw."""
        if below is None:
            self.odds, self.weighted = None, self.kt
        else:
            self.odds = self.kt - below
            self.weighted = np.logaddexp(self.kt, below) - math.log(2)

    def mixed(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of each bit at the nodes `at`, given what the deeper contexts say."""
        own = (np.where(bit, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1.0)
        if deeper is None:
            return own
        stop = 1 / (1 + np.exp(-np.clip(self.odds[at], -700, 700)))
        return stop * own + (1 - stop) * deeper


def shorten(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of full context to (context of `depth` bytes, byte) numbers."""
    return ((keys >> _U(8 * (DEPTH + 1 - depth))) << _U(8)) | (keys & _U(0xFF))


class Tree:
    """The part of the trees below depth `top` for keys that share their `top` latest bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int = 2):
        self.keys, self.top = keys, top
        self.counted = {depth: _unique(shorten(keys, depth), counts) for depth in range(DEPTH, top - 1, -1)}

    def at(self, place: int) -> dict[int, Level]:
        """The weighted levels of one bit place, by depth; only one place is held at a time."""
        levels: dict[int, Level] = {}
        for depth in range(DEPTH, self.top - 1, -1):
            level = levels[depth] = Level(*self.counted[depth], place)
            level.weigh(None if depth == DEPTH else self.sums(levels[depth + 1], level, place))
        return levels

    @staticmethod
    def sums(child: Level, level: Level, place: int) -> np.ndarray:
        return np.bincount(np.searchsorted(level.node, child.parents(place)), weights=child.weighted, minlength=len(level.node))

    def mixed(self, place: int) -> np.ndarray:
        """Probability of each key's bit at `place` by the depths DEPTH .. top."""
        bit = ((self.keys >> _U(7 - place)) & _U(1)).astype(bool)
        p = None
        for depth, level in self.at(place).items():
            p = level.mixed(np.searchsorted(level.node, shorten(self.keys, depth) >> _U(8 - place)), bit, p)
        return p


def _group(key, hot: list[int]):
    """What keeps the grams of one subtree together: two context bytes, or three of a hot two."""
    two, shift = F.shiftright(key, 8 * (DEPTH - 1)), 8 * (DEPTH - 2)
    return F.when(two.isin(hot), F.shiftright(key, shift)).otherwise(F.shiftleft(two, 8)) if hot else F.shiftleft(two, 8)


def _contexts(batches, hot: np.ndarray, least: int = 50_000):
    """Runs of sorted keys that hold whole subtrees, with the number of bytes that each of them
    shares: three below hot contexts of two. A run has `least` keys or one subtree at least."""
    held_k, held_n, size = [], [], 0

    def split(k, n):
        is_hot = np.isin(k >> _U(8 * (DEPTH - 1)), hot)
        for top, at in ((2, ~is_hot), (3, is_hot)):
            if at.any():
                yield k[at], n[at], top

    for batch in batches:
        held_k.append(np.asarray(batch.column(0)).view(_U))
        held_n.append(np.asarray(batch.column(1)))
        size += len(held_k[-1])
        if size >= least:
            k, n = np.concatenate(held_k), np.concatenate(held_n)
            two, three = k[-1] >> _U(8 * (DEPTH - 1)), k[-1] >> _U(8 * (DEPTH - 2))
            first = (three if np.isin(two, hot) else two << _U(8)) << _U(8 * (DEPTH - 2))
            cut = int(np.searchsorted(k, first))
            if cut:
                yield from split(k[:cut], n[:cut])
            held_k, held_n, size = [k[cut:]], [n[cut:]], len(k) - cut
    if size:
        yield from split(np.concatenate(held_k), np.concatenate(held_n))


def _roots(hot: np.ndarray):
    """From sorted keys of whole subtrees: sums for the nodes just above them."""

    def run(batches):
        for keys, counts, top in _contexts(batches, hot):
            tree = Tree(keys, counts, top)
            for place in range(8):
                level = tree.at(place)[top]
                node, at = np.unique(level.parents(place), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), x, dtype=np.int32)) for x in (top - 1, place)] + [pa.array(node.view(np.int64)), *(pa.array(np.bincount(at, weights=w, minlength=len(node))) for w in (level.n0, level.n1, level.weighted))],
                    names=["depth", "place", "node", "n0", "n1", "below"],
                )

    return run


class Crown:
    """The depths above the subtrees: 0 and 1, and 2 for hot contexts."""

    def __init__(self, rows, hot: np.ndarray):
        self.hot, self.levels = hot, {}
        for place in range(8):
            sums = {d: [(r["node"], r["n0"], r["n1"], r["below"]) for r in rows if r["place"] == place and r["depth"] == d] for d in (1, 2)}
            if sums[2]:
                two = self.levels[2, place] = self._level(sums[2])
                sums[1] += zip(two.parents(place).tolist(), two.n0.tolist(), two.n1.tolist(), two.weighted.tolist(), strict=True)
            one = self.levels[1, place] = self._level(sums[1])
            self.levels[0, place] = self._level(list(zip(one.parents(place).tolist(), one.n0.tolist(), one.n1.tolist(), one.weighted.tolist(), strict=True)))

    @staticmethod
    def _level(sums) -> Level:
        level = Level.__new__(Level)
        level.node, at = np.unique(np.array([x[0] for x in sums], dtype=_U), return_inverse=True)
        n0, n1, below = (np.bincount(at, weights=np.array([x[k] for x in sums]), minlength=len(level.node)) for k in (1, 2, 3))
        level.n0, level.n1 = np.rint(n0).astype(np.int64), np.rint(n1).astype(np.int64)
        level.kt = log_kt(level.n0, level.n1)
        level.weigh(below)
        return level

    def finish(self, keys: np.ndarray, place: int, p: np.ndarray, top: int) -> np.ndarray:
        bit = ((keys >> _U(7 - place)) & _U(1)).astype(bool)
        for depth in range(top - 1, -1, -1):
            level = self.levels[depth, place]
            p = level.mixed(np.searchsorted(level.node, shorten(keys, depth) >> _U(8 - place)), bit, p)
        return p


def _values(crown, buckets: int):
    """Sorted keys of whole subtrees to (bucket, keys, log10 probabilities)."""

    def run(batches):
        for keys, counts, top in _contexts(batches, crown.value.hot):
            tree = Tree(keys, counts, top)
            value = np.zeros(len(keys))
            for place in range(8):
                value += np.log10(crown.value.finish(keys, place, tree.mixed(place), top))
            found = _messages(keys, buckets, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int32()), pa.array([pack_sorted(keys[at]) for _, at in found], pa.binary()), pa.array([blob(value[at]) for _, at in found], pa.binary())], names=["bucket", "keys", "values"]
            )

    return run


# ---------------------------------------------------------------- answers and scores


def _word_values(batches):
    """(bucket, key, n) to (bucket, keys, counts as values)."""
    for batch in batches:
        bucket, keys, n = (np.asarray(batch.column(k)) for k in range(3))
        order = np.lexsort((keys.view(_U), bucket))
        bucket, keys, n = bucket[order], keys[order].view(_U), n[order].astype(np.float64)
        some, first = np.unique(bucket, return_index=True)
        ends = [*first[1:], len(bucket)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([pack_sorted(keys[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([blob(n[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())], names=["bucket", "keys", "values"]
        )


def _answers(batches):
    """Of each bucket first what is known, then what blocks ask: values for the keys of each block, in its order."""
    now, held, known = None, [], None
    for batch in batches:
        out: dict[str, list] = {"_block": [], "bucket": [], "values": []}
        for bucket, block, keys, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if bucket != now:
                now, held, known = bucket, [], None
            if block is None:
                held.append((unpack_sorted(keys.as_buffer()), np.frombuffer(values.as_buffer(), dtype=np.float64)))
                continue
            if known is None:
                k, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                order = np.argsort(k)
                known, held = (k[order], v[order]), []
            out["_block"].append(block)
            out["bucket"].append(bucket)
            out["values"].append(blob(known[1][np.searchsorted(known[0], unpack_sorted(keys.as_buffer()))]))
        yield pa.RecordBatch.from_arrays([pa.array(out["_block"], pa.int32()), pa.array(out["bucket"], pa.int32()), pa.array(out["values"], pa.binary())], names=["_block", "bucket", "values"])


def _finish(buckets: int, total: int, distinct: int, ends: int):
    floor = total + 0.1 * (distinct + 1)

    def log_unigram(c):
        return np.log10((c + 0.1) / floor)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        known = {b: np.frombuffer(v.as_buffer(), dtype=np.float64) for b, v in zip(answers.column("bucket").to_pylist(), answers.column("values"), strict=True)}
        texts = table.column("text").combine_chunks()
        rows = len(texts)
        score, base = np.zeros(rows), np.zeros(rows)
        tokens, seen = np.ones(rows, dtype=np.int64), np.full(rows, int(ends > 0), dtype=np.int64)
        for kind in (0, _WORD):
            held, every = [], []
            for at, to in steps(texts, STEP_BYTES):
                keys, doc = _step_keys(texts.slice(at, to - at), kind)
                own, use = np.unique(keys, return_inverse=True)
                every.append(own)
                held.append((at, to, use.astype(np.int32), doc.astype(np.int32)))
            keys = np.unique(np.concatenate(every)) if every else np.zeros(0, dtype=_U)
            value = np.zeros(len(keys))
            for k, at in _messages(keys, buckets, kind):
                value[at] = known[k]
            for own, (at, to, use, doc) in zip(every, held, strict=True):
                found = value[np.searchsorted(keys, own)]
                if kind == _WORD:
                    base[at:to] = np.bincount(doc, weights=log_unigram(found)[use], minlength=to - at) + log_unigram(float(ends))
                    tokens[at:to] += np.bincount(doc, minlength=to - at)
                    seen[at:to] += np.bincount(doc[(found > 0)[use]], minlength=to - at)
                else:
                    score[at:to] = np.bincount(doc, weights=found[use], minlength=to - at)
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64) + 1
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": pa.array(tokens),
            "n_known": pa.array(seen),
            "train_tokens": pa.array(np.full(rows, total, dtype=np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(score),
            "bits_per_byte": pa.array(score / -math.log10(2) / size),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    size = text_bytes(docs)
    blocks, buckets = parts(size, BLOCK_BYTES), min(parts(size, BLOCK_BYTES // 2), MOST_BUCKETS)
    learned = source.select("text", "held_out").mapInArrow(_learn(buckets), "bucket int, keys binary, counts binary").repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")
    counts = materialize(learned.mapInArrow(_totals, "bucket int, key long, n long"))
    words, grams = counts.where(F.col("bucket") >= buckets), counts.where(F.col("bucket") < buckets).select("key", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = source.where(~F.col("held_out")).count()
    # at most 1,000 contexts hold a thousandth of all grams each
    two = grams.groupBy(F.shiftright("key", 8 * (DEPTH - 1)).alias("two")).agg(F.count("*").alias("n"))
    n_grams = grams.count()
    hot = sorted(r["two"] for r in two.where(F.col("n") * 1000 >= max(n_grams, 50_000)).collect())
    # grams of one subtree come together, sorted; an unsigned order for signed keys is not needed: all are positive
    together = grams.repartition(max(1, buckets), _group(F.col("key"), hot)).sortWithinPartitions("key")
    hot = np.array(hot, dtype=_U)
    sums = together.mapInArrow(_roots(hot), "depth int, place int, node long, n0 double, n1 double, below double").groupBy("depth", "place", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    crown = docs.sparkSession.sparkContext.broadcast(Crown(sums.collect(), hot))
    known = together.mapInArrow(_values(crown, buckets), "bucket int, keys binary, values binary").unionAll(words.mapInArrow(_word_values, "bucket int, keys binary, values binary"))
    # both readings of the blocks are in one job, so the texts are dealt once
    dealt = spread(source, blocks, "doc_id", "text")
    asked = dealt.groupBy("_block").applyInArrow(_ask(buckets), "_block int, bucket int, keys binary, values binary")
    columns = ["bucket", "_block", "keys", "values"]
    met = known.withColumn("_block", F.lit(None).cast("int")).select(*columns).unionAll(asked.select(*columns)).repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", F.col("_block").asc_nulls_first())
    answers = met.mapInArrow(_answers, "_block int, bucket int, values binary")
    total, distinct = facts["n"] + ends, facts["v"] + int(ends > 0)
    return dealt.groupBy("_block").cogroup(answers.repartition(blocks, "_block").groupBy("_block")).applyInArrow(
        _finish(buckets, total, distinct, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )
