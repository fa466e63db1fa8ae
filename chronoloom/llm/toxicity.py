"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by the subsequences of `LENGTH` letters that they
share, each weighted by `DECAY` to the power of the span it takes in either word
(Lodhi et al., 2002), and is normalised. A gap or an inserted character only adds
to the span, so "idxiot" stays near "idiot". Signs are left out before, and a word with
digits is also read without them.

Training uses a bounded sample of the labelled rows (`SAMPLE` rows, by a hash of
doc_id), of which those with equal label and equal set of words count once. They give each word's document counts by class; words that toxic documents hold far more often than chance are
the positive examples, common and randomly drawn words of clean documents the
negative ones; positive ones also stand with a letter put in (`VARIANTS` copies), because that is what the
machine has to tolerate. Landmarks are picked from the positives by pivoted Cholesky steps
and, for contrast, from the negatives. A linear SVM (squared hinge) on the Nyström features is fit
by Newton steps. Because a linear function of Nyström features is a
weighted sum of kernels to the landmarks, it is a weight for each subsequence:
scoring a word looks its subsequences up in one table.

A document's score comes from its three highest words, through a logistic curve fit on
the same rows. Runs of single
letters ("i d i o t") are read as one more word.

Defined results: null and empty texts and texts without letters have the score of
a text without any word, below 0.5; without labelled training rows of both classes
every score is 0; rows that repeat count each; further columns of either table are
ignored by `score`, labels' rows without a document too; null labels are no labels; a row of
null doc_id is scored and not held out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, ascii_lower, bounded_batches, give_back, lean, materialize, steps

LENGTH = 3
DECAY = 0.7
#: Letters that a word is read in at a time, and how far the next piece starts.
PIECE, STRIDE = 12, 4
#: Bounds of the training sample: words of each class, landmarks, and documents for the curve.
WORDS, LANDMARKS, SAMPLE = 4000, 400, 24_000
#: Negative examples, evenly drawn, from which landmarks are picked.
CONTRAST = 800
FOLDS = 5
#: Copies of each positive example with a letter put in, so that the machine learns what the kernel leaves of it.
VARIANTS = 8
#: Cost of a row inside the margin.
COST = 3.0
#: Words of one length that are read at a time.
ROWS = 512
#: Words that a document is judged by, and the least value that one counts with.
TOP, FLOOR = 3, -3.0
_ALPHABET = 64


def _classes() -> np.ndarray:
    """Letters a-z to 1-26, digits and bytes outside ASCII to the rest; other signs to 0 (left out)."""
    table = np.zeros(256, dtype=np.int64)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[48:58] = 27 + np.arange(10) % 4
    table[128:192] = 31 + np.arange(64) % 32
    table[192:256] = 0  # lead bytes: the byte after them says enough
    return table


_CLASS = _classes()
_LOWER = ascii_lower()


#: Stands before a word's first letter.
_START = _ALPHABET - 1


def letters(word: bytes) -> list[int]:
    """A word's letters after the sign for its start."""
    found = [int(c) for c in _CLASS[np.frombuffer(word, dtype=np.uint8)] if c]
    return [_START, *found] if found else []


def pieces(code: list[int]) -> list[list[int]]:
    if len(code) <= PIECE:
        return [code]
    return [code[k : k + PIECE] for k in range(0, len(code) - PIECE + STRIDE, STRIDE)]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.array(list(combinations(range(n), LENGTH)), dtype=np.int64).reshape(-1, LENGTH)
    return t, DECAY ** (t[:, -1] - t[:, 0] + 1.0)


def _codes(rows: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(words, triples) numbers of the subsequences of equally long words."""
    return (rows[:, t[:, 0]] * _ALPHABET + rows[:, t[:, 1]]) * _ALPHABET + rows[:, t[:, 2]]


def _self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), weights[order]
    last = np.ones(c.shape, dtype=bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    sums = np.cumsum(w, axis=1)
    ends = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(c), 1)), ends[:, :-1]], axis=1), axis=1)
    return np.where(last, (sums - before) ** 2, 0.0).sum(axis=1)


def features(words: list[list[int]]) -> list[dict[int, float]]:
    """Normalised subsequence weights of words."""
    return list(_features(words))


def _features(words: Iterable[list[int]]) -> Iterator[dict[int, float]]:
    for w in words:
        t, weight = _triples(len(w))
        row: dict[int, float] = {}
        if len(t):
            for c, x in zip(_codes(np.array([w]), t)[0].tolist(), weight.tolist(), strict=True):
                row[c] = row.get(c, 0.0) + x
        norm = sum(x * x for x in row.values()) ** 0.5
        yield {c: x / norm for c, x in row.items()} if norm else row


class Rows:
    """Words' features one after the other, in flat arrays: subsequences, weights, and where each word's begin."""

    def __init__(self, rows: Iterable[dict[int, float]]):
        size, codes, values = array("q"), array("q"), array("d")
        for r in rows:
            size.append(len(r))
            codes.extend(r)
            values.extend(r.values())
        self.size, self.codes, self.values = np.array(size, dtype=np.int64), np.array(codes, dtype=np.int64), np.array(values, dtype=np.float64)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), self.size)
        self._table = np.zeros(_ALPHABET**LENGTH)

    def row(self, k: int) -> dict[int, float]:
        own = slice(self.first[k], self.first[k + 1])
        return dict(zip(self.codes[own].tolist(), self.values[own].tolist(), strict=True))

    def against(self, row: dict[int, float]) -> np.ndarray:
        """Every word's kernel to one word."""
        codes = np.fromiter(row, dtype=np.int64, count=len(row))
        self._table[codes] = np.fromiter(row.values(), dtype=np.float64, count=len(row))
        out = np.bincount(self.owner, weights=self._table[self.codes] * self.values, minlength=len(self.size))
        self._table[codes] = 0.0
        return out


def kernel(a: Iterable[dict[int, float]] | Rows, b: list[dict[int, float]]) -> np.ndarray:
    rows = a if isinstance(a, Rows) else Rows(a)
    out = np.zeros((len(rows.size), len(b)))
    for k, row in enumerate(b):
        out[:, k] = rows.against(row)
    return out


class Model:
    """weights: of each subsequence; bias; curve: coefficients of the highest words' values, and intercept."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights, bias, curve

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Values of words given as byte ranges of data; those with digits are read without
        them too, and the higher value counts."""
        code = _CLASS[data]
        out = self._read(code, starts, ends)
        digit = (data >= 48) & (data <= 57)
        digits, letter = (np.concatenate([[0], np.cumsum(x)]) for x in (digit, (code > 0) & ~digit))
        # with the sign of its start such a word has a subsequence
        mixed = np.flatnonzero((digits[ends] > digits[starts]) & (letter[ends] - letter[starts] >= LENGTH - 1))
        if len(mixed):
            out[mixed] = np.maximum(out[mixed], self._read(np.where(digit, 0, code), starts[mixed], ends[mixed]))
        return out

    def _read(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.bias)
        some = np.concatenate([[0], np.cumsum(code > 0)])
        size = some[ends] - some[starts]
        used = size > 0
        # every word's letters, one place apart for the sign of its start
        a = np.cumsum(size + 1) - size - 1
        kept = np.full(int((size + 1).sum()), _START, dtype=np.int64)
        inside = np.repeat(some[starts], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        kept[np.repeat(a + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = code[code > 0][inside]
        b = a + np.where(used, size + 1, 0)
        size = b - a
        word, at, length = [np.arange(len(a))], [a], [np.minimum(size, PIECE)]
        for k in np.flatnonzero(size > PIECE):
            more = np.arange(STRIDE, size[k] - PIECE + STRIDE, STRIDE)
            word.append(np.full(len(more), k))
            at.append(a[k] + more)
            length.append(np.minimum(PIECE, size[k] - more))
        word, at, length = np.concatenate(word), np.concatenate(at), np.concatenate(length)
        for n in range(LENGTH, PIECE + 1):
            t, weight = _triples(n)
            own = np.flatnonzero(length == n)
            for k in range(0, len(own), ROWS):
                part = own[k : k + ROWS]
                codes = _codes(kept[at[part, None] + np.arange(n)], t)
                value = self.bias + (self.weights[codes] @ weight) / np.sqrt(np.maximum(_self_kernel(codes, weight), 1e-12))
                np.maximum.at(out, word[part], value)
        return out

    def probability(self, values: np.ndarray) -> np.ndarray:
        """Of documents by their `TOP` highest words."""
        return 1.0 / (1.0 + np.exp(-np.clip(values @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _spelled(raw: bytes) -> list[bytes]:
    """Runs of three or more single letters, joined."""
    out, run = [], []
    for w in raw.split():
        if len(w) == 1 and w.isalpha():
            run.append(w)
        else:
            if len(run) >= 3:
                out.append(b"".join(run))
            run = []
    return [*out, b"".join(run)] if len(run) >= 3 else out


class Seen:
    """Values of words that a task has met, by hash; the older half goes when the newer is full."""

    def __init__(self, most: int = 1 << 19):
        self.half = most // 2
        self.new = self.old = (np.zeros(0, dtype=np.uint64), np.zeros(0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """NaN for words not met."""
        out = np.full(len(hashes), np.nan)
        for known, values in (self.old, self.new):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = values[at[hit]]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        known, first = np.unique(np.concatenate([self.new[0], hashes]), return_index=True)
        self.new = known, np.concatenate([self.new[1], values])[first]
        if len(known) > self.half:
            self.old, self.new = self.new, (np.zeros(0, dtype=np.uint64), np.zeros(0))


def highest(model: Model, texts: pa.Array, seen: Seen | None = None):
    """For each text the values of its TOP highest distinct words, in steps; a word that `seen`
    holds isn't computed again. Values lie between FLOOR and -FLOOR."""
    seen = seen or Seen()
    for at, to in steps(texts):
        words = Words(texts.slice(at, to - at), "space", lower=True)
        best = np.full((to - at, TOP), FLOOR)
        if len(words.hash):
            hashes, first, use = np.unique(words.hash, return_index=True, return_inverse=True)
            values = seen.find(hashes)
            new = np.isnan(values)
            values[new] = np.clip(model.words(words.data, words.starts[first[new]], words.ends[first[new]]), FLOOR, -FLOOR)
            seen.add(hashes, values)
            high = np.flatnonzero(values[use] > FLOOR)
            doc, word = np.unique(np.stack([words.doc[high], use[high]]), axis=1) if len(high) else (np.zeros(0, dtype=np.int64),) * 2
            found = [(doc, values[word])]
            single = (words.ends - words.starts == 1) & (_CLASS[words.data[words.starts]] > 0)
            trio = single[:-2] & single[1:-1] & single[2:] & (words.doc[:-2] == words.doc[2:]) if len(single) > 2 else np.zeros(0, dtype=bool)
            for k in np.unique(words.doc[:-2][trio]) if len(trio) else []:
                joined = _spelled(words.data[words.offsets[k] : words.offsets[k + 1]].tobytes())
                ends = np.cumsum([len(w) for w in joined])
                more = model.words(np.frombuffer(b"".join(joined), dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends)
                found.append((np.full(len(more), k), np.clip(more, FLOOR, -FLOOR)))
            doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-value, doc))
            doc, value = doc[order], value[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            top = place < TOP
            best[doc[top], place[top]] = value[top]
        yield best


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear SVM (squared hinge loss) by Newton steps over the rows inside the margin; the last feature, 1, is for the bias."""
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(1.0 - y * (x @ w), 0.0) ** 2).sum()

    now = loss(w)
    for _ in range(rounds):
        short = 1.0 - y * (x @ w)
        part = np.flatnonzero(short > 0)
        inside = x[part]
        side = inside * cost[part, None]
        step = np.linalg.solve(eye + 2.0 * side.T @ inside, w - 2.0 * side.T @ (y[part] * short[part]))
        del inside, side
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w, before, now = w - size * step, now, after
        if before - now <= 1e-9 * before:
            break
    return w


def landmarks(every: Rows, most: int) -> list[int]:
    """Pivots of an incomplete Cholesky factorisation of the rows' kernel."""
    n = len(every.size)
    left, steps_, picked = np.ones(n), [], []
    for _ in range(min(most, n)):
        i = int(np.argmax(left))
        if left[i] < 0.05:
            break
        col = every.against(every.row(i))
        for s in steps_:
            col -= s * s[i]
        col /= np.sqrt(left[i])
        steps_.append(col)
        left -= col * col
        left[i] = 0.0
        picked.append(i)
    return picked


def inserted(words: list[bytes], copies: int = VARIANTS) -> list[bytes]:
    """Each word with one letter put in behind another, `copies` times at places and with letters of a fixed draw."""
    rng = np.random.default_rng(9)
    out = []
    for w in words:
        inside = [k for k in range(1, len(w)) if _CLASS[w[k]] and _CLASS[w[k - 1]]]
        for k in rng.choice(inside, copies).tolist() if inside else []:
            out.append(w[:k] + bytes([97 + int(rng.integers(26))]) + w[k:])
    return out


def fit_words(positive: list[bytes], negative: list[bytes]) -> tuple[np.ndarray, float]:
    """Weights of subsequences and bias from example words."""
    def read(words):
        return (f for f in _features(p for w in words for p in pieces(letters(w))) if f)

    # flat from the start: as dictionaries the features of all words would be most of the driver's memory
    pos, neg = Rows(read([*positive, *inserted(positive)])), Rows(read(negative))
    contrast = Rows(neg.row(i) for i in sorted(np.random.default_rng(5).permutation(len(neg.size))[:CONTRAST].tolist()))
    marks = [pos.row(i) for i in landmarks(pos, LANDMARKS * 3 // 4)] + [contrast.row(i) for i in landmarks(contrast, LANDMARKS // 4)]
    k = kernel(marks, marks)
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    n_pos, n_neg = len(pos.size), len(neg.size)
    every = np.zeros((n_pos + n_neg, len(marks)))
    every[:n_pos], every[n_pos:] = kernel(pos, marks), kernel(neg, marks)
    del pos, neg
    x = np.ones((len(every), root.shape[1] + 1))
    x[:, :-1] = every @ root
    del every
    y = np.concatenate([np.ones(n_pos), -np.ones(n_neg)])
    w = fit_svm(x, y, np.where(y > 0, COST * max(1.0, n_neg / max(1, n_pos)) ** 0.5, COST))
    del x
    give_back()
    weights = np.zeros(_ALPHABET**LENGTH)
    for m, a in zip(marks, root @ w[:-1], strict=True):
        for c, v in m.items():
            weights[c] += a * v
    return weights, float(w[-1])


def held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _word_rows(batches):
    """(text, toxic) to each document's distinct lower-case words."""
    for batch in batches:
        texts, label = batch.column(0), batch.column(1)
        for at, to in steps(texts):
            w = Words(texts.slice(at, to - at), "space", lower=True)
            if not len(w.hash):
                continue
            order = np.lexsort((w.hash, w.doc))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
            y = np.asarray(label.slice(at, to - at), dtype=np.int64)
            pick = order[new]
            # counted here first, so that a common word leaves once for each step
            h, first, use = np.unique(w.hash[pick], return_index=True, return_inverse=True)
            toxic = np.bincount(use, weights=y[w.doc[pick]]).astype(np.int64)
            every = np.bincount(use)
            data = _LOWER[w.data].tobytes()
            words = [data[w.starts[k] : w.ends[k]] for k in pick[first]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic), pa.array(every - toxic)], names=["word", "toxic", "clean"])


def _sketches(batches):
    for batch in batches:
        for at, to in steps(batch.column(2)):
            w = Words(batch.column(2).slice(at, to - at), "space", lower=True)
            low, high = np.zeros(to - at, dtype=np.int64), np.zeros(to - at, dtype=np.int64)
            for k in range(to - at):
                own = np.unique(w.hash[w.first[k] : w.first[k + 1]]).view(np.uint64)
                # two sums over the set, the second of hashes mixed anew
                low[k], high[k] = np.array([own.sum(), ((own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).sum()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(low), pa.array(high)], names=["doc_id", "toxic", "low", "high"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model | None:
    """Fit on at most `rows` of the labelled rows whose crc32(doc_id as text) mod FOLDS is not 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    # a bounded sample by a hash of doc_id: its ids fit a broadcast, so no text is shuffled to meet its label
    marks = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(marks), "doc_id").where("text is not null")
    sample = materialize(source)
    # copies speak once: of equal label and equal set of words, one document counts
    sketch = sample.select("doc_id", "toxic", "text").mapInArrow(lean(_sketches), "doc_id long, toxic int, low long, high long")
    once = sketch.groupBy("toxic", "low", "high").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    single = materialize(sample.join(once, "doc_id", "left_semi"))
    n = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    rate = n[1] / (n[0] + n[1])
    counts = materialize(single.select("text", "toxic").mapInArrow(lean(_word_rows), "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # far more often toxic than chance allows for so many words: the log-likelihood gain over the base rate
    gain = F.col("toxic") * F.log((F.col("toxic") + 0.01) / (F.col("toxic") + F.col("clean") + 0.02) / rate) + F.col("clean") * F.log((F.col("clean") + 0.01) / (F.col("toxic") + F.col("clean") + 0.02) / (1 - rate))
    scored = counts.withColumn("gain", gain)
    some = scored.where(f"toxic > (toxic + clean) * {max(0.8, min(0.95, 2 * rate))!r} and gain >= ln({max(1, counts.count())}) + 3")
    positive = [bytes(r["word"]) for r in some.orderBy(F.desc("gain"), "word").limit(WORDS).collect()]
    clean = scored.where("toxic = 0 or clean > toxic")
    common = clean.orderBy(F.desc("clean"), "word").limit(WORDS // 4)
    drawn = clean.orderBy(F.xxhash64("word"), "word").limit(WORDS)
    negative = [bytes(r["word"]) for r in common.unionAll(drawn).dropDuplicates(["word"]).collect()]
    positive = [w for w in positive if len(letters(w)) >= LENGTH]
    negative = [w for w in negative if len(letters(w)) >= LENGTH]
    if not positive or not negative:
        return Model(np.zeros(_ALPHABET**LENGTH), 0.0, np.array([0.0] * TOP + [-30.0]))
    model = Model(*fit_words(positive, negative), np.zeros(TOP + 1))
    for _ in range(2):  # once more with the clean words that come nearest to the positive ones
        negative = [*dict.fromkeys(negative + _nearest(model, clean))]
        model = Model(*fit_words(positive, negative), np.zeros(TOP + 1))
    return Model(model.weights, model.bias, _curve(model, sample))


def _nearest(model: Model, words: DataFrame) -> list[bytes]:
    """The words of the highest value, WORDS / 4 of them."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.words(data, bounds[:-1], bounds[1:]))], names=["word", "value"])

    valued = words.select("word").mapInArrow(lean(run), "word binary, value double")
    rows = valued.orderBy(F.desc("value"), "word").limit(WORDS // 4).collect()
    return [w for w in (bytes(r["word"]) for r in rows) if len(letters(w)) >= LENGTH]


def _curve(model: Model, sample: DataFrame) -> np.ndarray:
    """Coefficients and intercept of the logistic curve over the highest words' values, by Newton steps."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        seen = Seen()
        for batch in batches:
            best = np.concatenate([np.zeros((0, TOP)), *highest(shared.value, batch.column(0), seen)])
            yield pa.RecordBatch.from_arrays([pa.array(best.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["best", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(lean(run), "best array<double>, toxic int").collect()
    x = np.array([[*r["best"], 1.0] for r in rows])
    y = np.array([r["toxic"] for r in rows], dtype=float)
    w = np.zeros(TOP + 1)
    for _ in range(40):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (z * (1 - z))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (z - y) + 0.1 * w)
    return w


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    row = [docs["doc_id"].cast("long").alias("doc_id")]
    out = _scored(docs, row, train(docs, labels, rows))
    return out.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _scored(docs: DataFrame, row: list, model: Model | None) -> DataFrame:
    bounded_batches(docs.sparkSession)
    frame = docs.select(F.struct(*row).alias("_row"), docs["text"].alias("_text"))
    if model is None:
        return frame.select("_row", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        seen = Seen()
        for batch in batches:
            best = np.concatenate([np.zeros((0, TOP)), *highest(shared.value, batch.column(1), seen)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(best))], names=["_row", "score"])

    return frame.mapInArrow(lean(run), StructType([frame.schema["_row"], StructField("score", DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """docs without the documents whose score is `limit` or more."""
    out = _scored(docs, [docs[f"`{c}`"] for c in docs.columns], train(docs, labels, rows))
    return out.where(F.col("score") < limit).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
