"""Near-duplicate detection by MinHash with tensored banding.

Each document draws two small collections of `half` keys; a key joins `depth`
minimum hashes. A table's key is a pair of keys, one from each collection, so
2 * half keys serve half * half tables and 2 * half * depth minimum hashes do the
work of 2 * half * half * depth. Two documents of similarity s miss every common
table with a probability of at most 2 * (1 - s ** depth) ** half.

Candidates are verified on full shingle sets, and links make components:

1. Documents of equal sets (by a 128-bit cryptographic digest of the whole sorted set)
   collapse into their smallest doc_id.
2. In each table's bucket everyone is a candidate of the bucket's smallest member,
   first within a map task and then across tasks, so a bucket that holds a third
   of all rows reaches a reducer as one entry for each task.
3. One candidate for each document, its smallest, is verified.
4. Families (documents that candidate pairs hold together) whose members still lie in
   several components are gone through again. First some members of each, drawn by
   hash, are compared with all: most of a family of near copies is one component then.
   Of what is left, every member outside the family's largest component is compared with
   all others. Both go by blocks, and a block returns a spanning forest of the components
   that it links, so what leaves grows with the members and not with their pairs.

Defined results: documents without words (null or empty text included) have no
shingles, link with nothing and stand alone; a document of fewer words than the
shingle has one shingle, its whole sequence; of rows that repeat a doc_id, each has
the result of its own text, and a link of one row is a link of the doc_id; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Words, blob, bounded_batches, discard, give_back, join_by_weight, lean, materialize, mix, parts, steps
from .components import components

_U = np.uint64
_ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8")])


class Shape:
    """Parameters: words to a shingle, similarity in percent, keys to a collection, hashes to a key."""

    def __init__(self, words: int = 5, percent: int = 80, half: int = 8, depth: int = 2):
        self.words, self.percent, self.half, self.depth = words, percent, half, depth
        rng = np.random.default_rng(7)
        n = 2 * half * depth
        self.mult = rng.integers(1, 1 << 63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.add = rng.integers(1, 1 << 63, n, dtype=np.int64).astype(_U)


def shingle_sets(texts: pa.Array, words: int):
    """For each step of rows: (from, to, sorted distinct shingle hashes, bounds of each row's)."""
    for at, to in steps(texts):
        w = Words(texts.slice(at, to - at), "space", lower=True)
        m = len(w.hash)
        h = np.zeros(max(0, m - words + 1), dtype=_U)
        for k in range(words):
            h = h * _U(0x9E3779B97F4A7C15) + w.hash[k : k + len(h)] if len(h) else h
        h = mix(h)
        sets = []
        for k in range(to - at):
            a, b = w.first[k], w.first[k + 1]
            if b - a >= words:
                sets.append(np.unique(h[a : b - words + 1]))
            elif b > a:  # the whole sequence; its length keeps it apart from longer ones
                x = np.full(1, b - a, dtype=_U)
                for v in w.hash[a:b]:
                    x = x * _U(0xC2B2AE3D27D4EB4F) + v
                sets.append(mix(x))
            else:
                sets.append(np.zeros(0, dtype=_U))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        yield at, to, np.concatenate(sets) if sets else np.zeros(0, dtype=_U), bounds


def _signatures(shape: Shape):
    """(doc_id, text) to (doc_id, n, digest, keys): the whole set's digest, 2 * half 64-bit words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, to, values, bounds in shingle_sets(batch.column(1), shape.words):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                keys = np.zeros((to - at, 2 * shape.half), dtype=_U)
                digests = [hashlib.blake2b(values[bounds[k] : bounds[k + 1]], digest_size=16).digest() for k in range(to - at)]
                if len(full):
                    start = bounds[:-1][full]
                    for j in range(2 * shape.half):
                        key = np.full(len(full), j, dtype=_U)
                        for k in range(shape.depth):
                            c = j * shape.depth + k
                            x = values * shape.mult[c] + shape.add[c]
                            low = np.minimum.reduceat(x ^ (x >> _U(32)), start)
                            key = mix(key * _U(0x9E3779B97F4A7C15) + low)
                        keys[full, j] = key
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(n), pa.array(digests, pa.binary()), pa.array([blob(k) for k in keys], pa.binary())], names=["doc", "n", "digest", "keys"]
                )

    return run


def _table_keys(keys: np.ndarray, half: int) -> np.ndarray:
    """(rows, 2 * half) collection keys to (half * half, rows) table keys."""
    return np.stack([mix(keys[:, i] * _U(0xC2B2AE3D27D4EB4F) + keys[:, half + j]) for i in range(half) for j in range(half)])


def _stars(entries: np.ndarray):
    """Sorted by (key, doc): the first entry of each key, and (doc, first doc) of the others."""
    entries = entries[np.lexsort((entries["doc"], entries["key"]))]
    new = np.ones(len(entries), dtype=bool)
    new[1:] = entries["key"][1:] != entries["key"][:-1]
    heads = entries[new]
    hub = heads["doc"][np.cumsum(new) - 1]
    return heads, np.unique(np.stack([entries["doc"], hub], axis=1)[~new], axis=0) if len(entries) else np.zeros((0, 2), dtype=np.int64)


def _deal(half: int, buckets: int, rows: int = 8192):
    """Map side: (doc, keys) to entries by bucket, or candidate pairs (bucket -1)."""

    def emit(ids, keys):
        table = _table_keys(keys, half)
        entries = np.empty(table.size, dtype=_ENTRY)
        entries["key"] = table.ravel()
        entries["doc"] = np.tile(ids, len(table))
        heads, pairs = _stars(entries)
        bucket = heads["key"] % _U(buckets)
        heads = heads[np.argsort(bucket, kind="stable")]
        cut = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
        some = [k for k in range(buckets) if cut[k + 1] > cut[k]]
        return pa.RecordBatch.from_arrays(
            [pa.array([*some, *[-1] * bool(len(pairs))], pa.int32()), pa.array([*(blob(heads[cut[k] : cut[k + 1]]) for k in some), *[blob(pairs)] * bool(len(pairs))], pa.binary())], names=["bucket", "entries"]
        )

    def run(batches):
        held, count = [], 0
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=_U).reshape(-1, 2 * half)
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for at in range(0, len(ids), rows):
                held.append((ids[at : at + rows], keys[at : at + rows]))
                count += len(held[-1][0])
                if count >= rows:
                    yield emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, count = [], 0
        if count:
            yield emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return run


def _unpack(batches):
    for batch in batches:
        for x in batch.column(0):
            p = np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _meet(table: pa.Table) -> pa.Table:
    entries = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_ENTRY) for x in table.column("entries")])
    _, pairs = _stars(entries)
    give_back()
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _star_pairs(signatures: DataFrame, half: int, rows: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a > b, by the smallest member of each bucket."""
    buckets = parts(rows * half * half * _ENTRY.itemsize, 8 << 20)
    dealt = materialize(signatures.select("doc", "keys").mapInArrow(lean(_deal(half, buckets)), "bucket int, entries binary"))
    within = dealt.where("bucket < 0").select("entries").mapInArrow(lean(_unpack), "a long, b long")
    across = dealt.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    out = materialize(within.unionAll(across).distinct())
    discard(dealt)
    return out


def _set_rows(shape: Shape):
    """(doc_id, text) to (doc_id, shingles): the sorted set as bytes."""

    def run(batches):
        for batch in batches:
            for at, to, values, bounds in shingle_sets(batch.column(1), shape.words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([blob(values[bounds[k] : bounds[k + 1]]) for k in range(to - at)], pa.binary())], names=["doc", "shingles"])

    return run


def _confirm(percent: int):
    """(a, b, sa, sb) to the pairs with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if len(p) and len(q) and 100 * common >= percent * (len(p) + len(q) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(_confirm(percent)), "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Intersection sizes of all sets of two lists, as a matrix product over the values in both."""
    x, y = np.concatenate(left), np.concatenate(right)
    values = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets, flat):
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        good = values[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[good], at[good]

    if len(values):
        (rx, cx), (ry, cy) = places(left, x), places(right, y)
        ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
        rx, cx, ry, cy = rx[ox], cx[ox], ry[oy], cy[oy]
        for at in range(0, len(values), chunk):
            i, j = np.searchsorted(cx, (at, at + chunk)), np.searchsorted(cy, (at, at + chunk))
            a, b = np.zeros((len(left), chunk), dtype=np.float32), np.zeros((len(right), chunk), dtype=np.float32)
            a[rx[i[0] : i[1]], cx[i[0] : i[1]] - at] = 1
            b[ry[j[0] : j[1]], cy[j[0] : j[1]] - at] = 1
            out += a @ b.T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the pairs of labels that, in this order, join what was apart."""
    above: dict[int, int] = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _cell(percent: int):
    """One cell's drawn or odd members (left) against members of the same families (right):
    links that make a spanning forest of the components that links join here."""

    def read(table: pa.Table):
        sets = [np.frombuffer(x.as_buffer(), dtype=_U) for x in table.column("shingles")]
        return [np.asarray(table.column(c).combine_chunks(), dtype=np.int64) for c in ("family", "doc", "component")], sets

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 2), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            (fa, da, ca), sa = read(left)
            (fb, db, cb), sb = read(right)
            oa, ob = np.argsort(fa, kind="stable"), np.argsort(fb, kind="stable")
            for family in np.unique(fa):
                i = oa[np.searchsorted(fa[oa], family) : np.searchsorted(fa[oa], family, side="right")]
                j = ob[np.searchsorted(fb[ob], family) : np.searchsorted(fb[ob], family, side="right")]
                if not len(j):
                    continue
                na, nb = np.array([len(sa[k]) for k in i]), np.array([len(sb[k]) for k in j])
                common = _common([sa[k] for k in i], [sb[k] for k in j]).astype(np.int64)
                ok = (ca[i][:, None] != cb[j][None, :]) & (100 * common >= percent * (na[:, None] + nb[None, :] - common))
                x, y = np.nonzero(ok)
                if len(x):
                    x, y = i[x], j[y]
                    _, first = np.unique(np.stack([ca[x], cb[y]]), axis=1, return_index=True)
                    good = first[_forest(ca[x[first]], cb[y[first]])]
                    out.append(np.stack([da[x[good]], db[y[good]]], axis=1))
        p = np.concatenate(out)
        give_back()
        return pa.table({"a": pa.array(p[:, 0]), "b": pa.array(p[:, 1])})

    return run


#: Members of each family that are compared with all others first.
DRAWN = 8


def _meet_families(families: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, rows: int, drawn: bool, odd_block: int = 256, block: int = 1024) -> DataFrame:
    """Links between different components of one family, found by comparing its drawn members, or
    else all outside its largest component (the odd ones), with all. Blocks of these meet blocks
    of members in cells; small families share a cell."""
    label = materialize(families.join(comp, "doc", "left").select("doc", "family", F.coalesce("component", "doc").alias("component")))
    size = label.groupBy("family", "component").agg(F.count("*").alias("n"))
    family = size.groupBy("family").agg(F.sum("n").alias("weight"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    family = family.withColumn("odd_blocks", F.lit(1) if drawn else F.ceil((F.col("weight") - F.col("most")) / odd_block).cast("int")).withColumn("blocks", F.ceil(F.col("weight") / block).cast("int"))
    members = join_by_weight(label, materialize(family), "family", rows)
    if drawn:
        seeds = [F.min_by("doc", F.xxhash64("doc", F.lit(k))) for k in range(DRAWN)]
        hubs = label.groupBy("family").agg(F.array_distinct(F.array(*seeds)).alias("hub")).select(F.explode("hub").alias("doc"), F.lit(True).alias("turn"))
        members = members.join(hubs.hint("merge"), "doc", "left").withColumn("turn", F.coalesce("turn", F.lit(False)))
    else:
        members = members.withColumn("turn", F.col("component") != F.col("main"))
    members = materialize(members.join(sets.hint("merge"), "doc"))
    shards = parts(members.count(), 2000)
    mine = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = F.col("odd_blocks") * F.col("blocks") == 1
    cell = F.when(small, F.pmod(F.xxhash64("family"), F.lit(shards))).otherwise(F.xxhash64("family", "ob", "mb")).alias("cell")
    columns = ["family", "doc", "component", "shingles"]
    left = members.where("turn").withColumn("ob", mine("odd_blocks")).withColumn("mb", every("blocks")).select(cell, *columns)
    right = members.withColumn("mb", mine("blocks")).withColumn("ob", every("odd_blocks")).select(cell, *columns)
    links = materialize(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(percent), "a long, b long"))
    discard(label, members)
    return links


def _classes(every: DataFrame, rows: int) -> DataFrame:
    """(doc, n, digest, keys) to (doc, n, digest, rep, keys): rep is the smallest doc of the same
    set, itself where no other has it, null without shingles; only rows of a rep keep their keys."""
    classes = materialize(every.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("weight")).where("weight > 1"))
    found = join_by_weight(every, classes, "digest", rows, "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc")))
    out = materialize(found.select("doc", "n", "digest", "rep", F.when(F.col("doc") == F.col("rep"), F.col("keys")).alias("keys")))
    discard(classes)
    return out


def link(docs: DataFrame, shape: Shape, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[id_column].cast("long").alias("doc"), docs["text"].alias("text"))
    every = materialize(source.mapInArrow(lean(_signatures(shape)), "doc long, n long, digest binary, keys binary"))
    rows = every.count()
    whole = _classes(every, rows)
    discard(every)
    reps = whole.where("doc = rep").dropDuplicates(["doc", "digest"]).select("doc", "n", "keys")

    sizes = reps.select("doc", "n").groupBy("doc").agg(F.max("n").alias("n"))
    stars = _star_pairs(reps, shape.half, rows)
    sized = stars.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    pairs = materialize(sized.withColumn("fit", F.least("na", "nb") * 100 >= shape.percent * F.greatest("na", "nb")).select("a", "b", "fit"))
    discard(stars)
    active = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    # always a merge join: the ids are a share of all documents and no table to broadcast
    sets = materialize(source.join(active.hint("merge"), "doc", "left_semi").mapInArrow(lean(_set_rows(shape)), "doc long, shingles binary").dropDuplicates(["doc", "shingles"]))

    first = pairs.where("fit").groupBy("a").agg(F.min("b").alias("b"))
    links = materialize(_verify(first, sets, shape.percent))
    comp = components(links)
    # families whose members still lie in several components
    # (of any sizes: two members of a bucket may fit where its smallest fits neither). A document has
    # at most one candidate for each table and task: its smallest takes the others before they are joined
    m = F.min("b").over(Window.partitionBy("a"))
    near = pairs.select("a", "b", m.alias("m"))
    near = near.select("a", F.col("m").alias("b")).unionAll(near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    families = materialize(components(near).withColumnRenamed("component", "family"))
    for drawn in (True, False):
        # what is linked is one node from here on: only components, and links between them, are joined
        met = _meet_families(families, comp, sets, shape.percent, rows, drawn)
        if met.limit(1).count():
            more = materialize(links.unionAll(met))
            discard(links)
            links, comp = more, components(more)
        discard(met)
    comp = materialize(comp)
    discard(pairs, sets, links, families)

    out = whole.join(comp.select(F.col("doc").alias("rep"), "component"), "rep", "left")
    same = out.select("doc", "n", F.coalesce("component", "rep", "doc").alias("component_id"))
    return same.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, shape: Shape) -> DataFrame:
    """docs without rows linked to a smaller doc_id, and of rows that repeat a kept doc_id
    and its text, one. Documents without words and rows of null doc_id all stay."""
    bounded_batches(docs.sparkSession)
    key, digest = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    rows = docs.where("doc_id is not null").select(key.alias("_doc"), digest.alias("_text")).groupBy("_doc").agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    if rows.where("a <> b").limit(1).count():
        left = _rows_apart(docs, key, digest, shape)
    else:
        gone = link(docs, shape).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
        left = docs.join(gone, key == F.col("_gone"), "left_anti")
    return left.where("doc_id is null").unionAll(left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def _rows_apart(docs: DataFrame, key: Column, digest: Column, shape: Shape) -> DataFrame:
    """keep_first's rows where a doc_id has several texts: each text is linked by itself,
    under numbers in the order of doc_id."""
    texts = docs.where("doc_id is not null").select(key.alias("_doc"), digest.alias("_text")).distinct()
    numbers = materialize(texts.orderBy("_doc", "_text").withColumn("_node", F.monotonically_increasing_id()))
    found = docs.select(key.alias("_doc"), digest.alias("_text"), "text").join(numbers, ["_doc", "_text"])
    linked = link(found.select(F.col("_node").alias("doc_id"), "text"), shape).where("not kept").select(F.col("doc_id").alias("_node"), "component_id").distinct()
    first = numbers.select(F.col("_node").alias("component_id"), F.col("_doc").alias("_first"))
    gone = linked.join(numbers, "_node").join(first, "component_id").where("_first < _doc").select(F.col("_doc").alias("_gone"), F.col("_text").alias("_gone_text"))
    return docs.join(gone, (key == F.col("_gone")) & (digest == F.col("_gone_text")), "left_anti")
