"""Alignment of two tokenisers' tokens over the same bytes.

Texts are shuffled by their full text, so that each distinct text is tokenised and aligned once, with its multiplicity;
rows take the measures of their text by its digest. Pair counts are sums of links by multiplicity over all texts.

Both tokenisers start anew where a blank follows something that is not white space: no pattern of A and no piece of B
goes across such a place. So a text is cut there, and what a cut-out part gives (ids, groups, links) is worked out once
and remembered by each task, within a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, blocks, lookup, rested, tokenizer_path, written

PIECES = "piece_bpe_32k.model"
#: Cut before a blank that follows no white space, but not before the last character: B gives nothing for an empty rest.
_PLACES = re.compile(r"(?<=\S)(?= [\s\S])")
#: Characters of a text that are cut up at a time, parts that are measured at a time, and bytes of new parts that are tokenised at a time.
SLICE, AT_ONCE, BATCH = 1 << 20, 1 << 17, 1 << 17
#: About so many bytes of parts are remembered; then a task starts anew.
HELD = 160 << 20


class Aligner:
    """Ids, groups and links of the parts of texts. Parts are numbered as they come up; arrays hold what is known of each."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letter = _byte_letters()
        found = {i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [found.get(i, b"") for i in range(max(found) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: the bytes differ
        self.sizes = np.zeros((1024, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.first = np.zeros(1024, np.int64)  # of its links
        self.links, self.n_links, self.held = np.zeros(4096, np.int64), 0, 0

    def _keep(self, sizes: np.ndarray, links: np.ndarray, groups: list[bytes | None]) -> None:
        """Parts with the next numbers: sizes in rows, links one part after the other."""
        at = len(self.groups)
        while at + len(sizes) > len(self.first):
            self.sizes, self.first = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.first, np.zeros_like(self.first)])
        while self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.sizes[at : at + len(sizes)] = sizes
        self.first[at : at + len(sizes)] = self.n_links + np.cumsum(sizes[:, 3]) - sizes[:, 3]
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)
        self.groups += groups

    def _learn(self, parts: list[str]) -> None:
        """Number new parts. Many are tokenised as one text: at the blank that each starts with both tokenisers start anew."""
        plain: list[str] = []
        size = 0
        for p in parts:
            if "▁" in p or p[-1].isspace() or not self.cuts:  # may differ from its bytes, or reach into the next part
                if not self._align([p]):
                    self._differs(p)
                continue
            plain.append(p)
            size += len(p)
            if size > BATCH:
                self._learn_batch(plain)
                plain, size = [], 0
        if plain:
            self._learn_batch(plain)

    def _learn_batch(self, parts: list[str]) -> None:
        if not self._align(parts):
            for p in parts:
                if not self._align([p]):
                    self._differs(p)

    def _differs(self, part: str) -> None:
        self.number[part] = len(self.groups)
        self._keep(np.zeros((1, 4), np.int64), np.zeros(0, np.int64), [None])

    def _align(self, parts: list[str]) -> bool:
        """Align and keep parts; False, with nothing kept, if their bytes or ends aren't those of the tokens."""
        text = "".join(parts)
        whole = text.encode()
        a_ids, b_ids = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join([self.a_bytes[i] for i in a_ids]) != whole or b"".join([self.b_bytes[i] for i in b_ids]) != whole:
            return False
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        end = np.cumsum([len(p.encode()) for p in parts]) if len(parts) > 1 else np.array([len(whole)])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(end, both).all():
            return False
        # Between two ends that follow each other one token of A and one of B overlap: each such place is a link.
        places = np.union1d(a_end, b_end)
        links = (a[np.searchsorted(a_end, places)] << 32) + b[np.searchsorted(b_end, places)]
        count = lambda ends: np.bincount(np.searchsorted(end, ends), minlength=len(parts))
        sizes = np.stack([count(a_end), count(b_end), count(both), count(places)], 1)
        a_at, b_at = [0, *(np.searchsorted(a_end, both) + 1).tolist()], [0, *(np.searchsorted(b_end, both) + 1).tolist()]
        a_text, b_text = list(map(str, a_ids)), list(map(str, b_ids))
        groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:n])}" for i, j, k, n in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)]
        at = [0, *np.cumsum(sizes[:, 2]).tolist()]
        for k, p in enumerate(parts):
            self.number[p] = len(self.groups) + k
        self._keep(sizes, links, [";".join(groups[i:j]).encode() for i, j in zip(at, at[1:], strict=False)])
        self.held += 350 * len(parts) + 12 * len(whole)
        return True

    def _numbers(self, parts: list[str]) -> list[int]:
        get = self.number.get
        out = [get(p, -1) for p in parts]
        if -1 in out:
            self._learn(list(dict.fromkeys([p for p, k in zip(parts, out, strict=True) if k < 0])))
            out = [self.number[p] for p in parts]
        return out

    def texts(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, links of each pair) of whole texts; zeros, "" and no pairs if the bytes differ."""
        n = len(texts)
        sizes, digests, same = np.zeros((n, 4), np.int64), [hashlib.sha256() for _ in texts], [bool(t) for t in texts]
        begun, pairs = [False] * n, [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        waiting = 0
        for k, t in enumerate(texts):
            for parts in self._sliced(t):
                held.append((k, parts))
                waiting += len(parts)
                if waiting > AT_ONCE:
                    self._add(held, sizes, digests, same, begun, pairs)
                    held, waiting = [], 0
        self._add(held, sizes, digests, same, begun, pairs)
        out = []
        for k in range(n):
            if not same[k]:
                out.append((0, 0, 0, 0, "", [], []))
                continue
            ids, links = pairs[k][0] if len(pairs[k]) == 1 else (np.concatenate(x) for x in zip(*pairs[k], strict=True))
            if len(pairs[k]) > 1:
                ids, where = np.unique(ids, return_inverse=True)
                links = np.bincount(where, links).astype(np.int64)
            out.append((*sizes[k].tolist(), digests[k].hexdigest(), ids, links))
        return out

    def _sliced(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, some at a time."""
        if not text:
            return
        text, at = " " + text, 0
        if not self.cuts:
            yield [text]
            return
        while at < len(text):
            m = _PLACES.search(text, at + SLICE) if len(text) - at > SLICE else None
            to = m.start() if m else len(text)
            yield _PLACES.split(text[at:to] if at or m else text)
            at = to

    def _add(self, held, sizes, digests, same, begun, pairs) -> None:
        """Add up parts by text: held has (place of the text, parts) in order."""
        if not held:
            return
        if self.held > HELD:
            self.forget()
        parts = [p for _, x in held for p in x]
        numbers = self._numbers(parts)
        ids, at = np.array(numbers, np.int64), 0
        owner = np.repeat(np.array([k for k, _ in held]), [len(x) for _, x in held])
        for k, x in held:
            texts = [self.groups[i] for i in numbers[at : at + len(x)]]
            at += len(x)
            if None in texts:
                same[k] = False
            else:
                digests[k].update((b";" if begun[k] else b"") + b";".join(texts))
                begun[k] = True
        np.add.at(sizes, owner, self.sizes[ids])
        n = self.sizes[ids, 3]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[ids], n)
        pair, which = np.unique(self.links[place], return_inverse=True)
        found, links = np.unique(np.repeat(owner, n) * len(pair) + which, return_counts=True)
        of, pair = found // max(len(pair), 1), pair[found % max(len(pair), 1)]
        edge = np.flatnonzero(np.diff(of)) + 1
        for k, x, y in zip(of[np.concatenate([[0], edge])] if len(of) else [], np.split(pair, edge), np.split(links, edge), strict=False):
            pairs[k].append((x, y))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in plain]
    return {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(rest)}


_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "links"]


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = alone(("align", a, b), lambda: Aligner(a, b))
        for rows, texts in blocks(batches, "text"):
            found = aligner.texts(texts)
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *cols, pa.array([x[4] for x in found], pa.string()), *lists], _NAMES)

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = PIECES) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens don't give back their bytes in both tokenisers, have zeros and an empty
    groups_sha256. Repeated rows and rows of equal texts each get their text's measures, and each counts in the pair
    counts. Ties of the highest count of a B id are all best. Other columns aren't read, whatever their names; a null
    id is kept; no rows give no rows. A very long text is tokenised part by part; one without blanks is a single part.
    """
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("digest"))
    distinct = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = written(distinct.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text").mapInArrow(rested(_aligned(tokenizer_path(a), tokenizer_path(b))), f"digest binary, copies long, {_MEASURES}, pair array<long>, links array<long>"))

    each = texts.select("digest", "copies", F.explode(F.arrays_zip("pair", "links")).alias("p")).select("digest", "copies", F.col("p.pair").alias("pair"), F.col("p.links").alias("links"))
    counted = each.groupBy("pair").agg(F.sum(F.col("links") * F.col("copies")).alias("count"), F.count(F.lit(1)).alias("n_texts"))
    counts = written(counted.withColumn("b", F.expr("pair & 4294967295")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = written(counts.join(most, "b").select("pair", "count", "n_texts", (F.col("count") == F.col("most")).alias("best")))

    known = lookup(each.select("digest", "pair", "links"), judged, ["pair"], "n_texts", "digest", 64)
    sums = known.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    measures = written(texts.drop("pair", "links").join(sums, "digest", "left"))
    done = lookup(rows, measures, ["digest"], "copies", "id", 250)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
