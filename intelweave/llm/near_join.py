"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

* Texts with the same set of word shingles are one class; from here on a class stands for all its texts.
* Each class has MinHash values; BANDS groups of ROWS values are its bucket keys. Two classes of similarity 0.8
  share no bucket with a probability of 6e-7.
* Each bucket gives pairs of its first class with the others only. Values are compared step by step, and a pair is
  dropped when the posterior probability of reaching the threshold falls below the tolerance. A class with a share
  of LABEL equal values or more is labelled with that first class: large families of near copies get few labels.
  Classes of different labels that meet in a bucket lead to a pair of labels.
* Labels that meet form a family around the least of them. Members of one family, and of families that meet, are
  compared in blocks: step by step again, and what is left
  is verified exactly on the shingle sets. A block returns counts for each class, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, blocks, rested, written
from .shingles import WIDTH, mix, shingles

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: Values compared before each look at the posterior.
STEP = 30
TOLERANCE = 1e-7
#: Members of one side of a block; labels of a bucket that are compared at once with as many others.
CHUNK = 256
PAIRED = 256
#: Share of equal values from which a class takes the first class of a bucket as its label.
LABEL = 0.5


@lru_cache(8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n values compared, the least number of equal ones with P(similarity >= threshold) >= tolerance.

    The prior is uniform; a value of 8 bits is also equal by chance, once in 256.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    equal = grid + (1 - grid) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal) if n > m else m * np.log(equal)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (a[i], b[j]) that no look at the posterior drops, and their equal values."""
    alive, equal = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n, least in least_matches(threshold).items():
        equal[alive] += np.count_nonzero(a[i[alive], n - STEP : n] == b[j[alive], n - STEP : n], axis=1)
        alive = alive[equal[alive] >= least]
    return alive, equal[alive]


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(HASHES, dtype=np.uint64)
    return mix(k + np.uint64(1)) | np.uint64(1), mix(k + np.uint64(1 << 32))


def signatures(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit MinHash values and bucket keys of texts with n > 0 shingles each."""
    start = np.cumsum(n) - n
    least = np.empty((len(n), HASHES), np.uint64)
    for k, (a, b) in enumerate(zip(*_seeds(), strict=True)):
        least[:, k] = np.minimum.reduceat((values ^ b) * a, start)
    least = mix(least)
    keys = np.zeros((len(n), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, r::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    return (least & np.uint64(255)).astype(np.uint8), keys.astype(np.int64)


def _class_ids(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    stop = np.cumsum(n)
    return np.array([xxhash.xxh64_intdigest(values[e - k : e].tobytes()) for e, k in zip(stop, n, strict=True)], np.uint64).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    alone(None)
    for rows, texts in blocks(batches, "__text"):
        values, n = shingles(texts, width)
        some = n > 0
        sig, keys = signatures(values, n[some]) if some.any() else (np.zeros((0, HASHES), np.uint8), np.zeros((0, BANDS), np.int64))
        ids, sigs, buckets = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
        ids[some] = _class_ids(values, n[some])
        for k, i in enumerate(np.flatnonzero(some).tolist()):
            sigs[i], buckets[i] = sig[k].tobytes(), keys[k].tobytes()
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, mask=~some), pa.array(n), pa.array(sigs, pa.binary()), pa.array(buckets, pa.binary())], ["__id", "cls", "n", "sig", "keys"])


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls = b.column(0).to_numpy()
        if len(cls):
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(cls, BANDS))], ["key", "cls"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of a partition sorted by the first two, and where each group of the first starts. Two or three numbers a row."""
    parts = [tuple(b.column(k).to_numpy() for k in range(columns)) for b in batches]
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * columns
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) if len(order) else order
    return cols, first


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cls, first) of buckets with two classes or more."""
    (key, cls), first = _sorted_groups(batches, 2)
    size = np.diff(np.append(first, len(key)))
    lead = np.repeat(cls[first], size) if len(first) else cls
    keep = np.repeat(size > 1, size)
    for k in range(0, len(key), 1 << 16):
        some = np.flatnonzero(keep[k : k + (1 << 16)]) + k
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(cls[some]), pa.array(lead[some])], ["key", "cls", "first"])


def _label_pairs(batches: Iterator[pa.RecordBatch], threshold: float, loose: float) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of the different labels in each bucket that may hold a link; rows are (key, label, single, sig), all of a key in one partition.

    Two single labels are tested at threshold, a single one and a large one at loose, two large ones not at all.
    """
    key, label, single, sig = [], [], [], []
    for b in batches:
        key.append(b.column(0).to_numpy())
        label.append(b.column(1).to_numpy())
        single.append(b.column(2).to_numpy(zero_copy_only=False))
        sig.append(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, HASHES))
    if not key:
        return
    key, label, single, sig = (np.concatenate(x) for x in (key, label, single, sig))
    order = np.lexsort((label, key))
    key, label, single = key[order], label[order], single[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
        for i in range(s, e, PAIRED):
            for j in range(i, e, PAIRED):
                x, y = (k.ravel() for k in np.indices((min(PAIRED, e - i), min(PAIRED, e - j))))
                x, y = x + i, y + j
                x, y = x[x < y], y[x < y]
                both, one = single[x] & single[y], single[x] ^ single[y]
                for at, some in ((threshold, both), (loose, one), (None, ~both & ~one)):
                    k = np.flatnonzero(some)
                    if at is not None and len(k):
                        k = k[surviving(sig, sig, at, order[x[k]], order[y[k]])[0]]
                    if len(k):
                        yield pa.RecordBatch.from_arrays([pa.array(label[x[k]]), pa.array(label[y[k]])], ["a", "b"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches of numbers as larger ones."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 1 << 15:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _prune(threshold: float):
    """Keeps rows (x, y, xs, ys: the values) whose pair survives, with the share of equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                xs, ys = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                all_ = np.arange(len(xs))
                alive, equal = surviving(xs, ys, threshold, all_, all_)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive)), pa.array(equal / HASHES)], ["x", "y", "share"])

    return run


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, as products of 0-1 matrices over the shared members."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    column, row = column[several], row[several]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((len(a), len(b)), np.float32)
    wide = 1 << 14
    bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + wide, wide))
    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if e > s:
            m = np.zeros((len(a) + len(b), min(wide, int(column[e - 1]) - k * wide + 1)), np.float32)
            m[row[s:e], column[s:e] - k * wide] = 1
            out += m[: len(a)] @ m[len(a) :].T
    return out


def _links(left: list[tuple], right: list[tuple], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the similar pairs of two chunks of members (cls, docs, sig, set)."""
    i, j = np.triu_indices(len(left), 1) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    ls, rs = (np.frombuffer(b"".join(m[2] for m in x), np.uint8).reshape(-1, HASHES) for x in (left, right))
    alive, _ = surviving(ls, rs, threshold, i, j)
    i, j = i[alive], j[alive]
    a, b = ([np.frombuffer(m[3], np.uint64) for m in x] for x in (left, right))
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = size_a[i] + size_b[j]
    fits = np.minimum(size_a[i], size_b[j]) >= threshold / (1 + threshold) * both - 1e-9
    i, j, both = i[fits], j[fits], both[fits]
    if len(i) > 64:
        rows, cols = np.unique(i), np.unique(j)
        counts = _shared_counts([a[k] for k in rows], [b[k] for k in cols])
        shared = counts[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    similar = shared >= threshold * (both - shared) - 1e-9
    return i[similar], j[similar]


def _blocks_linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, cls, docs, sig, set) sorted by unit, to (cls, links, least) of the members with links.

    A unit is a pair of chunks, sides 0 and 1, or a chunk with itself, side 2. least is the least class that the
    links of the unit connect a member to.
    """
    out: list[tuple] = []

    def compare(members: dict[int, dict[int, tuple]]) -> None:
        same = 2 in members
        left = list(members.get(2 if same else 0, {}).values())
        right = left if same else list(members.get(1, {}).values())
        if not left or not right or (same and len(left) < 2):
            return
        links: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i, j in zip(*(x.tolist() for x in _links(left, right, same, threshold)), strict=True):
            (c, cd), (d, dd) = left[i][:2], right[j][:2]
            links[c] = links.get(c, 0) + dd
            links[d] = links.get(d, 0) + cd
            x, y = find(c), find(d)
            root[max(x, y)] = min(x, y)
        out.extend((c, n, find(c)) for c, n in links.items())

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["cls", "links", "least"])
        out.clear()
        return batch

    key, members = None, {}
    for b in batches:
        for unit, side, *member in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if unit != key:
                compare(members)
                key, members = unit, {}
                if len(out) > 1 << 14:
                    yield flush()
            members.setdefault(side, {})[member[0]] = tuple(member)
    compare(members)
    if out:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (cls, least): the least node of each connected component.

    Every round gives each node the least label among its neighbours' and its own, then the label of that label;
    the table of a round is written, so rounds don't pile up. Ends when no label changes.
    """
    both = edges.select(F.col("cls").alias("x"), F.col("least").alias("y"))
    both = written(both.union(both.select("y", "x")).filter("x <> y").distinct())
    now = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:
        near = both.join(now.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.least("root", "near").alias("lower"), "root")
        jump = now.select(F.col("node").alias("lower"), F.col("root").alias("further"))
        new = written(step.join(jump, "lower", "left").select("node", F.least("lower", F.coalesce("further", "lower")).alias("root"), F.col("root").alias("old")))
        changed = new.filter("root <> old").limit(1).count()
        now = new.select("node", "root")
        if not changed:
            return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """One row per input row: the id, class_id, n_links, text_class, n_shingles.

    Words are runs of letters and digits in lower case; a text of 1 to width - 1 words is one shingle. n_links counts
    the other rows with similarity of threshold or more; equal shingle sets are similar. class_id is the least id of
    the rows that links connect; a row without links is its own class. A null text, or one without words, has no
    links and text_class null. Repeated rows are rows of their own. A null id is a row; a class of null ids only has
    class_id null. Other columns aren't read; an empty table gives no rows. text_class names the set of shingles (64
    bits). Links between texts that share no bucket, or that the pruning drops, are lost with a probability under
    1e-6 each.
    """
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = plain.schema["__id"].dataType.simpleString()
    signed = written(plain.mapInArrow(rested(lambda b: _sign(b, width)), f"__id {kind}, cls long, n long, sig binary, keys binary"))
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    buckets = classes.select("cls", "keys").mapInArrow(rested(_bucket_rows), "key long, cls long").repartition("key").mapInArrow(rested(_full), "key long, cls long, first long")
    buckets = written(buckets)
    sigs = classes.select("cls", "sig")

    def pruned(pairs: DataFrame, at: float) -> DataFrame:
        x = sigs.withColumnsRenamed({"cls": "x", "sig": "xs"})
        y = sigs.withColumnsRenamed({"cls": "y", "sig": "ys"})
        return pairs.distinct().join(x, "x").join(y, "y").select("x", "y", "xs", "ys").mapInArrow(rested(_prune(at)), "x long, y long, share double")

    stars = pruned(buckets.filter("cls <> first").select(F.col("cls").alias("x"), F.col("first").alias("y")), LABEL)
    label = stars.filter(F.col("share") >= LABEL).groupBy(F.col("x").alias("cls")).agg(F.min("y").alias("label"))
    involved = written(buckets.select("cls").distinct().join(label, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label")))
    # a label needn't be a member of its own: its class may carry another label. So a label of one member is tested through that member
    tested = involved.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.min("cls").alias("sole")).select("label", "members", F.when(F.col("members") == 1, F.col("sole")).otherwise(F.col("label")).alias("by"))
    # two labels of one member each: the pair of members is tested. One such label: a member of the other is LABEL - 0.15
    # similar to its label at least, so that label keeps some of the similarity to the one member. Two large labels: not tested.
    # The values come to the buckets, so that only pairs that pass become rows.
    shown = tested.join(sigs.withColumnRenamed("cls", "by"), "by").select("label", (F.col("members") == 1).alias("single"), "sig")
    met = buckets.select("key", "cls").join(involved, "cls").select("key", "label").distinct().join(shown, "label").select("key", "label", "single", "sig").repartition("key")
    passed = written(met.mapInArrow(rested(lambda b: _merged(_label_pairs(b, threshold, max(0.01, LABEL - 0.15 + threshold - 1)))), "a long, b long").distinct())
    # labels that meet form families around the least of them, so that many small labels share blocks
    both_ways = passed.select(F.col("a").alias("label"), F.col("b").alias("other")).unionByName(passed.select(F.col("b").alias("label"), F.col("a").alias("other")))
    family = written(both_ways.groupBy("label").agg(F.least(F.min("other"), F.first("label")).alias("family")))
    of = lambda name: family.select(F.col("label").alias(name), F.col("family").alias(f"f{name}"))
    crossed = passed.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()
    involved = written(involved.join(family, "label", "left").select("cls", F.coalesce("family", "label").alias("label")))
    sizes = involved.groupBy("label").agg(F.count(F.lit(1)).alias("members")).withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int"))
    own = sizes.filter("members > 1").select(F.col("label").alias("a"), F.col("label").alias("b"), F.col("chunks").alias("ca"), F.col("chunks").alias("cb"))
    chunks = lambda name: sizes.select(F.col("label").alias(name), F.col("chunks").alias(f"c{name}"))
    every = own.unionByName(crossed.join(chunks("a"), "a").join(chunks("b"), "b").select("a", "b", "ca", "cb"))
    units = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ca") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cb") - 1))).filter("a <> b or i <= j")
    itself = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    # pairs of small labels share a block only with themselves; a block is one pair of chunks
    sides = F.when(itself, F.array(F.struct(F.col("a").alias("label"), F.col("i").alias("chunk"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("label"), F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("b").alias("label"), F.col("j").alias("chunk"), F.lit(1).alias("side")))
    )
    wanted = units.select(F.xxhash64("a", "b", "i", "j").alias("unit"), F.explode(sides).alias("s")).select("unit", "s.*")
    used = wanted.select("label").distinct()
    members = involved.join(used, "label", "left_semi").join(sizes.select("label", "chunks"), "label").join(classes.select("cls", "rep", "docs", "sig"), "cls")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    texts = plain.join(members.select(F.col("rep").alias("__rep"), F.col("cls").alias("__cls"), "label", "chunk", "docs", "sig"), F.col("__id").eqNullSafe(F.col("__rep")))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in blocks(batches, "__text"):
            values, n = shingles(found, width)
            stop = np.cumsum(n)
            ids = np.zeros(len(n), np.int64)
            ids[n > 0] = _class_ids(values, n[n > 0]) if (n > 0).any() else ids[n > 0]
            right = np.flatnonzero((n > 0) & (ids == rows.column(1).to_numpy()))
            sets = pa.array([values[stop[k] - n[k] : stop[k]].tobytes() for k in right.tolist()], pa.binary())
            picked = [rows.column(k).take(pa.array(right)) for k in range(1, 6)]
            yield pa.RecordBatch.from_arrays([*picked, sets], ["cls", "label", "chunk", "docs", "sig", "set"])

    sets = texts.select("__text", "__cls", "label", "chunk", "docs", "sig").mapInArrow(rested(with_sets), "cls long, label long, chunk int, docs long, sig binary, set binary")
    ready = wanted.join(sets, ["label", "chunk"]).select("unit", "side", "cls", "docs", "sig", "set").repartition("unit").sortWithinPartitions("unit")
    linked = written(ready.mapInArrow(rested(lambda b: _blocks_linked(b, threshold)), "cls long, links long, least long"))
    roots = components(linked.select("cls", "least"))
    n_links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    facts = classes.select("cls", "rep", "docs").join(n_links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    facts = facts.select("cls", "rep", F.coalesce("root", "cls").alias("root"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    least = facts.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_class = facts.join(least, "root").select("cls", "links", "class_id")
    out = signed.select("__id", "cls", "n").join(by_class, "cls", "left")
    return out.select(
        F.col("__id").alias(id_col),
        F.when(F.col("cls").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.col("cls").alias("text_class"),
        F.col("n").alias("n_shingles"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stand for their class: those with the least id, once each; all columns kept."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    stays = found.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stays, F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi").dropDuplicates([id_col, text_col])
