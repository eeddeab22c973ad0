"""Removal of repeated byte strings with sparse enhanced suffix arrays.

Every LENGTH-byte string of a text has an anchor: the place of the least GRAM-byte hash in it, the first one if
several are equal. Equal strings have their anchors at equal offsets, so only texts around anchors of one hash can
share a string. The suffixes that start at the anchors of one hash are sorted, neighbours give common prefix
lengths, and a stack scan of these gives the interval tree: an interval is a set of anchors with a common
right context. Children are joined to their parent smaller into larger, in the order of what stands left of the
anchor, so the longest left extension of each anchor stands next to it; where left and right context make up
LENGTH bytes, both places are covered. maximal_repeats gives the intervals with all their occurrences. A match that can
grow neither way is a maximal repeat; its digest names its group, and every occurrence found carries that name.

Contexts that are equal within a block of texts travel as one row with the list of their places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written
from .shingles import mix

LENGTH = 400
GRAM = 32
#: A passage is a match of at least so many words, and of so many bytes, that stands in two documents.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 204
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(28)  # bits of a place within a block of texts; longer texts are ranked in parts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _least_places(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w neighbouring values, the first one if their leading bits are equal."""
    n = len(x)
    rows = -(-n // w)
    wide = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = (x >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
    wide = wide.reshape(rows, w)
    ahead = np.minimum.accumulate(wide, 1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, place, first start, last start) of each anchor: places and starts count from the text's begin."""
    none = np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(data) - gram + 1, length - gram + 1
    if len(data) < length:
        return none, none, none, none, none
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * up[:-1], dtype=np.uint64)])
    grams = mix((sums[gram:] - sums[:-gram]) * down[:n])
    del sums, up, down
    least = np.empty(n - w + 1, np.int64)
    part = (1 << int(_PLACE)) - w
    for k in range(0, n - w + 1, part):
        least[k : k + part] = _least_places(grams[k : k + part + w - 1], w) + k
    ends = np.cumsum(size)
    runs = np.maximum(size - length + 1, 0)
    starts = np.arange(runs.sum()) + np.repeat(ends - size - (np.cumsum(runs) - runs), runs)
    at = least[starts]
    of = np.repeat(np.arange(len(texts)), runs)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    text = of[first]
    begin = (ends - size)[text]
    return text, grams[at[first]].astype(np.int64), at[first] - begin, starts[first] - begin, starts[last] - begin


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array, children before parents. lcp[k]: of k - 1 and k."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else -1
        first = k - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, k - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


class Bucket:
    """The contexts of one hash: (left, right) of each, left reversed, so that both are read away from the anchor."""

    def __init__(self, contexts: list[tuple[bytes, bytes]], length: int):
        self.length = length
        self.order = sorted(range(len(contexts)), key=lambda k: contexts[k][1])
        self.right = [contexts[k][1] for k in self.order]
        self.left = [contexts[k][0] for k in self.order]
        rank = sorted(range(len(contexts)), key=lambda k: self.left[k])
        self.rank = [0] * len(rank)
        for r, k in enumerate(rank):
            self.rank[k] = r
        self.by_rank = rank
        self.lcp = [0] + [common(a, b) for a, b in zip(self.right, self.right[1:], strict=False)]

    def covered(self, least: int | None = None) -> list[list[tuple[int, int, int]]]:
        """For each context, in the order given, spans (left of the anchor, right of it, a partner) of least bytes or more that another context shares."""
        least = self.length if least is None else least
        spans: list[list[tuple[int, int, int]]] = [[] for _ in self.order]
        sets: dict[int, tuple[int, list[int]]] = {}  # by the first suffix: the last one, and left ranks in order

        def pair(x: int, y: int, depth: int) -> None:
            if depth + min(len(self.left[x]), len(self.left[y])) >= least:
                n = common(self.left[x], self.left[y])
                if n + depth >= least:
                    for k, partner in ((x, y), (y, x)):
                        own = spans[self.order[k]]
                        if not own or own[-1] != (n, depth, self.order[partner]):
                            own.append((n, depth, self.order[partner]))

        for depth, first, last in intervals(self.lcp):
            parts, k = [], first
            while k <= last:
                end, ranks = sets.pop(k, (k, [self.rank[k]]))
                parts.append(ranks)
                k = end + 1
            parts.sort(key=len)
            whole = parts.pop()
            for ranks in parts:
                for r in ranks:
                    at = bisect_left(whole, r)
                    for near in whole[max(0, at - 1) : at + 1]:
                        pair(self.by_rank[r], self.by_rank[near], depth)
                    whole.insert(at, r)
            sets[first] = (last, whole)
        return spans

    def groups(self) -> Iterator[tuple[int, int, list[int]]]:
        """Maximal repeats: (bytes left of the anchor, right of it, contexts). A longer left extension would lose a
        context, a longer right one too: the bytes before, and those after, differ."""
        for depth, first, last in intervals(self.lcp):
            ranks = sorted(self.rank[first : last + 1])
            ways = [common(self.left[self.by_rank[a]], self.left[self.by_rank[b]]) for a, b in zip(ranks, ranks[1:], strict=False)]
            seen = set()
            for level, i, j in intervals([0, *ways]):
                members = [self.by_rank[r] for r in ranks[i : j + 1]]
                diverse = min(self.lcp[k] for k in range(min(members) + 1, max(members) + 1)) == depth
                if level + depth >= self.length and diverse and (level, *members) not in seen:
                    seen.add((level, *members))
                    yield level, depth, [self.order[k] for k in members]


def _repeated_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, k1, k2, pos) whose hash occurs at two different places; all of a hash in one partition."""
    parts = [tuple(b.column(k).to_numpy() for k in range(4)) for b in batches]
    if not parts:
        return
    h, k1, k2, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, k2, k1, h))
    h, k1, k2, pos = h[order], k1[order], k2[order], pos[order]
    if not len(h):
        return
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (pos[1:] != pos[:-1])])
    h, k1, k2, pos = h[fresh], k1[fresh], k2[fresh], pos[fresh]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.flatnonzero(np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h)))))
    for k in range(0, len(several), 1 << 16):
        some = several[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array(pos[some])], ["k1", "k2", "pos"])


def _bucket_contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, __text, places) to contexts (hash, left, right, k1, k2, places); equal contexts of a block make one row."""
    for rows, texts in blocks(batches, "__text"):
        raw = [t.encode() for t in texts]
        wanted = [set(p) for p in rows.column(3).to_pylist()]
        k1, k2 = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        found: dict[tuple, tuple[list, list, list]] = {}
        for text, h, at, lo, hi in zip(*(x.tolist() for x in anchors(raw, length, gram)), strict=True):
            if at in wanted[text]:
                t = raw[text]
                for held, x in zip(found.setdefault((h, t[lo:at][::-1], t[at : hi + length]), ([], [], [])), (k1[text], k2[text], at), strict=True):
                    held.append(x)
        keys = list(found)
        for k in range(0, len(keys), 4096):
            some = keys[k : k + 4096]
            cols = [*([x[c] for x in some] for c in range(3)), *([found[x][c] for x in some] for c in range(3))]
            kinds = (pa.int64(), pa.binary(), pa.binary(), *(pa.list_(pa.int64()) for _ in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["hash", "left", "right", "k1", "k2", "places"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[bytes, bytes], list[tuple[int, int, int]]]]:
    """For each hash, its different contexts (left, right) with all their places (k1, k2, place); rows come sorted by hash.

    Equal contexts, of one text or several, are repeats as a whole; one of them stands for all in the tree.
    """
    held: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
    key = None
    for b in batches:
        for h, left, right, k1, k2, at in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if h != key:
                if held:
                    yield held
                held, key = {}, h
            held.setdefault((left, right), []).extend(zip(k1, k2, at, strict=True))
    if held:
        yield held


def _words(b: bytes) -> int:
    """Words that stand in b whole."""
    n = len(b.split())
    return n - (b[:1] > b" ") - (b[-1:] > b" ") if n else 0


def _cover(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Occurrences (k1, k2, start, end, repeat, passage) of maximal repeats of length bytes or more, or of passages.

    repeat is a digest of the string; passage tells that it has enough words and stands in two texts.
    """
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 5, pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "start", "end", "repeat", "passage"])
        out.clear()
        return batch

    for places in _by_bucket(batches):
        contexts = list(places)
        texts = [{p[:2] for p in places[c]} for c in contexts]
        least = min(length, PASSAGE_BYTES)
        spans = Bucket(contexts, length).covered(least) if len(contexts) > 1 else [[]]
        for k, (c, found) in enumerate(zip(contexts, spans, strict=True)):
            n_texts = len(texts[k])
            best: dict[tuple[int, int], bool] = {}
            if len(places[c]) > 1 and len(c[0]) + len(c[1]) >= least:
                best[len(c[0]), len(c[1])] = n_texts > 1
            for n, depth, partner in found:
                best[n, depth] = best.get((n, depth), False) or n_texts > 1 or texts[partner] != texts[k]
            # a span within another of the same kind adds nothing
            for two in (True, False):
                kept: list[tuple[int, int]] = []
                for n, depth in sorted((x for x, other in best.items() if other is two or not two), reverse=True):
                    if not kept or depth > kept[-1][1]:
                        kept.append((n, depth))
                for n, depth in kept:
                    if not two and n + depth < length:
                        continue
                    string = c[0][:n][::-1] + c[1][:depth]
                    passage = two and _words(string) >= PASSAGE_WORDS
                    if n + depth >= length or passage:
                        name = xxhash.xxh64_intdigest(string) - (1 << 63)
                        out.extend((k1, k2, p - n, p + depth, name, passage) for k1, k2, p in places[c])
            if len(out) >= 1 << 15:
                yield flush()
    if out:
        yield flush()


def _texts_and_contexts(docs: DataFrame, text_col: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Different texts (k1, k2, __text, copies, places), and the contexts of their repeated anchors.

    k1 and k2, 96 bits of digest, name a text; a null text is empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(text.alias("__text")).select(F.xxhash64("__text").alias("k1"), F.crc32(F.col("__text").cast("binary")).alias("k2"), "__text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "__text"):
            text, h, at, _, _ = anchors([t.encode() for t in texts], length, gram)
            k1, k2 = (rows.column(k).to_numpy()[text] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k1), pa.array(k2), pa.array(at)], ["hash", "k1", "k2", "pos"])

    placed = plain.mapInArrow(find, "hash long, k1 long, k2 long, pos long").repartition("hash").mapInArrow(_repeated_places, "k1 long, k2 long, pos long")
    by_text = placed.groupBy("k1", "k2").agg(F.collect_list("pos").alias("places"))
    once = plain.groupBy("k1", "k2").agg(F.first("__text").alias("__text"), F.count(F.lit(1)).alias("copies"))
    texts = written(once.join(by_text, ["k1", "k2"], "left"))
    asked = texts.filter("places is not null").select("k1", "k2", "__text", "places")
    contexts = asked.mapInArrow(lambda b: _bucket_contexts(b, length, gram), "hash long, left binary, right binary, k1 array<long>, k2 array<long>, places array<long>")
    return texts, contexts.repartition("hash").sortWithinPartitions("hash")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats around each anchor: repeat (a digest of the string), n_bytes, occurrences (array of struct id, start).

    A repeat longer than the text around one anchor shows as several that overlap. Texts of one content are one
    occurrence each. Rows as in drop_repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _by_bucket(batches):
            contexts = list(places)
            out = []
            for n, depth, members in Bucket(contexts, length).groups():
                left, right = contexts[members[0]]
                where = [{"k1": k1, "k2": k2, "start": p - n} for k in members for k1, k2, p in places[contexts[k]]]
                out.append((hashlib.md5(left[:n][::-1] + right[:depth]).hexdigest(), n + depth, where))
            if out:
                kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64())]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["repeat", "n_bytes", "where"])

    _, contexts = _texts_and_contexts(docs, text_col, length, gram)
    found = contexts.mapInArrow(run, "repeat string, n_bytes long, where array<struct<k1:long,k2:long,start:long>>").select("repeat", "n_bytes", F.inline("where"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"))
    return found.join(ids, ["k1", "k2"]).groupBy("repeat", "n_bytes").agg(F.array_sort(F.collect_set(F.struct("id", "start"))).alias("occurrences"))


def _cut(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "n_repeats", "n_passages", "passage_words")}
    for text, copies, found in zip(pdf["__text"], pdf.copies, pdf.found, strict=True):
        raw = text.encode()
        spans = [] if found is None else [(s["start"], s["end"], s["repeat"], s["passage"]) for s in found]
        whole = copies > 1
        parts, at, n, k, end = [], 0, 0, 0, -1
        for s, e in [(0, len(raw))] if whole and len(raw) >= length else sorted(x[:2] for x in spans if x[1] - x[0] >= length):
            if s > end:
                k += 1
                parts.append(raw[at:s])
                n += e - s
            elif e > end:
                n += e - end
            if e > end:
                end = at = e
        parts.append(raw[at:])
        own = len(raw.split()) if whole else 0
        passages = {x[2]: _words(raw[x[0] : x[1]]) for x in spans if x[3]} | ({None: own} if own >= PASSAGE_WORDS else {})
        row = (len(raw), n, k, b"".join(parts), len({x[2] for x in spans if x[1] - x[0] >= length}), len(passages), max(passages.values(), default=0))
        for c, x in zip(out, row, strict=True):
            out[c].append(x)
    return pd.DataFrame({"k1": pdf.k1, "k2": pdf.k2} | out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the bytes left), n_repeats, n_passages, passage_words.

    A byte goes if a string of length bytes over it also starts at any other place of any row; repeated rows are
    other places. n_repeats counts the different maximal repeats of length bytes or more found in the text.
    n_passages counts those of PASSAGE_WORDS whole words or more that another row shares, whatever their bytes, and
    passage_words is the longest; under length bytes they are found where their anchors agree, which
    is so for nearly all. A null text is empty; a null id is kept; other columns aren't read; no rows, no result.
    Matches don't cross rows. The bytes left need not be whole characters.
    """
    texts, contexts = _texts_and_contexts(docs, text_col, length, gram)
    found = contexts.mapInArrow(lambda b: _cover(b, length), "k1 long, k2 long, start long, end long, repeat long, passage boolean")
    by_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "repeat", "passage")).alias("found"))
    shape = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeats long, n_passages long, passage_words long"
    done = texts.drop("places").join(by_text, ["k1", "k2"], "left").mapInPandas(lambda it: (_cut(p, length) for p in it), shape)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"))
    return ids.join(done, ["k1", "k2"]).drop("k1", "k2")
