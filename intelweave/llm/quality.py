"""Quality rules from tokeniser fertility: how well a public vocabulary fits a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, blocks, rested, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: A band has lo, hi and slack: characters per token lie from lo - slack / sqrt(n) to hi + slack / sqrt(n), n being the
#: tokens, so that a short text has a wide band. bytes: the largest share of byte-fallback tokens. full, per_doubling: the
#: entropy of the tokens, as a share of the most that n tokens can have, is at least full - per_doubling * log2(n).
#: These bands by script are wide, so that plain prose of any language stays; fit_bands makes narrow ones by language.
SCRIPT_BANDS: dict[str, dict[str, float]] = {
    "latin": {"lo": 1.5, "hi": 6.0, "slack": 5.25, "bytes": 0.1, "full": 1.05, "per_doubling": 0.05},
    "greek, cyrillic": {"lo": 0.7, "hi": 5.0, "slack": 5.25, "bytes": 0.3, "full": 1.0, "per_doubling": 0.05},
    "hebrew, arabic": {"lo": 0.4, "hi": 5.0, "slack": 5.25, "bytes": 0.6, "full": 1.0, "per_doubling": 0.05},
    "indic": {"lo": 0.3, "hi": 5.0, "slack": 5.25, "bytes": 0.9, "full": 1.0, "per_doubling": 0.05},
    "cjk": {"lo": 0.3, "hi": 3.0, "slack": 5.25, "bytes": 0.9, "full": 1.0, "per_doubling": 0.05},
    "other": {"lo": 0.2, "hi": 8.0, "slack": 5.25, "bytes": 1.0, "full": 0.9, "per_doubling": 0.05},
}
_SCRIPTS = list(SCRIPT_BANDS)
#: fit_bands looks at so many labelled documents at most, and gives a band to languages with LEAST_GOOD good ones.
FIT_ROWS, LEAST_GOOD = 4_000, 50
#: Of the good documents that a band is fitted to, so many may fall out on each of its sides.
LOST = 1 / 800
#: The script of a letter by its first byte in UTF-8; -1 where that doesn't tell one.
SCRIPT_OF = np.full(256, -1, np.int64)
for _first, _last, _script in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xC9, 0), (0xCD, 0xD4, 1), (0xD6, 0xDF, 2), (0xE0, 0xE1, 3), (0xE3, 0xED, 4), (0xF0, 0xF4, 5)):
    SCRIPT_OF[_first : _last + 1] = _script
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy_share double, script string"


def _pieces(path: str):
    def load():
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return pieces, np.array([pieces.is_byte(k) for k in range(pieces.get_piece_size())])

    return alone(("pieces", path), load)


def _sums(flags: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of flags in each of the runs that end at stop."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[stop]
    return np.diff(total, prepend=0)


def _repeated(word: np.ndarray, stop: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text within windows of width words that occur at least twice in that text."""
    n = len(word)
    text = np.repeat(np.arange(len(stop), dtype=np.uint64), np.diff(stop, prepend=0))
    covered = np.zeros(n + 1, np.int64)
    if n >= width:
        mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        key = text[: n - width + 1] * np.uint64(0x94D049BB133111EB)
        for k in range(width):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
        whole = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        order = whole[np.argsort(key[whole], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, twice + width, 1)
    return _sums(np.cumsum(covered)[:n] > 0, stop)


def _measure(texts: list[str], path: str) -> list[np.ndarray | pa.Array]:
    pieces, is_byte = _pieces(path)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    inside = ~SPACES[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = (ends - [len(r) for r in raw])[[len(r) > 0 for r in raw]]
    start[begins] = inside[begins]
    packed = data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    where = coded.indices.to_numpy()
    n_words = _sums(start, ends)
    stop = np.cumsum(n_words)
    chars = _sums(inside & ((data & 0xC0) != 0x80), ends)
    lines = []
    for t in texts:
        full = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        lines.append(len(full) - len(set(full)))
    spelt = pieces.encode(coded.dictionary.to_pylist(), num_threads=1) if len(coded.dictionary) else []
    flat = np.fromiter((i for w in spelt for i in w), np.int64)
    size = np.fromiter(map(len, spelt), np.int64, len(spelt))
    each = size[where]
    upto = np.cumsum(each)
    ids = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat((np.cumsum(size) - size)[where] - (upto - each), each)]
    stops = np.concatenate([[0], upto])[stop]
    n_tokens = np.diff(stops, prepend=0)
    n_bytes = _sums(is_byte[ids], stops)
    of = np.repeat(np.arange(len(texts)), n_tokens)
    key, times = np.unique(of * len(is_byte) + ids, return_counts=True)
    spent = np.bincount(key // len(is_byte), times * np.log2(times), len(texts))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.log2(n_tokens) - spent / n_tokens
        share = np.where(n_tokens > 1, entropy / np.log2(np.minimum(n_tokens, len(is_byte))), 1.0)
        letters = np.array([_sums(SCRIPT_OF[data] == k, ends) for k in range(len(_SCRIPTS))])
        letters[-1, letters.sum(0) == 0] = 1
        script = pa.array(_SCRIPTS, pa.string()).take(pa.array(letters.argmax(0)))
        return [n_words, chars, _sums(SYMBOLS[data], ends), np.array(lines, np.int64), _repeated(where, stop), n_tokens, np.where(n_tokens > 0, chars / n_tokens, 0.0), np.where(n_tokens > 0, n_bytes / n_tokens, 0.0), share, script]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id, lang and the figures in MEASURES.

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return. The
    vocabulary spells every word on its own. A null text has no words: all counts 0, both shares 0, entropy 1.
    script is the one that most letters belong to; other if there are none. Null ids and languages are kept, repeated
    rows give repeated results, an empty table gives none; other columns aren't read; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x) if isinstance(x, np.ndarray) else x for x in _measure(texts, tokenizer_path(vocabulary)))], ["__id", "__lang", *(x.split()[0] for x in MEASURES.split(", "))])

    plain = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    kind = plain.schema["__id"].dataType.simpleString()
    return plain.mapInArrow(rested(run), f"__id {kind}, __lang string, {MEASURES}").withColumnsRenamed({"__id": id_col, "__lang": lang_col})


def _outside(band: dict[str, float]) -> dict[str, Column]:
    """The rules of a band that a row breaks, by name."""
    n, c = F.greatest(F.col("n_tokens"), F.lit(1)), F.col("chars_per_token")
    slack = band["slack"] / F.sqrt(n)
    return {
        "few_chars": c < band["lo"] - slack,
        "many_chars": c > band["hi"] + slack,
        "bytes": F.col("byte_share") > band["bytes"],
        "entropy": F.col("entropy_share") < band["full"] - band["per_doubling"] * F.log2(n),
    }


def _tightest(good: np.ndarray, bad: np.ndarray, bends: np.ndarray, sides: str, bend: np.ndarray, bend_bad: np.ndarray) -> tuple[float, float, float]:
    """(bend, lo, hi): of all bends the one whose limits reject most bad values.

    good + k * bend may fall below lo, good - k * bend above hi, for LOST of the good values; the limits are wider the
    fewer good values there are. sides names the limits in use.
    """
    best = (-1, 0.0, 0.0, 0.0)
    spare = 2 / np.sqrt(len(good))
    for k in bends:
        lo, hi = np.quantile(good + k * bend, LOST), np.quantile(good - k * bend, 1 - LOST)
        lo, hi = lo - spare * max(0.0, np.median(good + k * bend) - lo), hi + spare * max(0.0, hi - np.median(good - k * bend))
        out = np.zeros(len(bad), bool)
        if "lo" in sides:
            out |= bad + k * bend_bad < lo
        if "hi" in sides:
            out |= bad - k * bend_bad > hi
        best = max(best, (int(out.sum()), float(k), float(lo), float(hi)), key=lambda x: x[0])
    return best[1:]


def fit_bands(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", vocabulary: str = VOCABULARY) -> dict[str, dict[str, float]]:
    """A band for each language that has enough good documents among at most rows labelled ones, for verdict and good_rows.

    labels has 1 (good) or 0 (bad) by id. The sample is the labelled ids of least hash; its size is bounded by rows, at
    every size of the tables, and only its figures (six numbers a document) come to the driver. Texts that the base rules
    reject teach nothing. Null ids, labels and languages are left out; an id labelled both ways is bad; of rows with one id
    one counts. Empty tables, and languages with under LEAST_GOOD good documents, give no band, so that the wide bands by
    script hold. Costs one more scan of ids and texts; texts outside the sample go before Python sees them.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label")).filter("__id is not null and __label is not null")
    chosen = known.groupBy("__id").agg((F.min("__label") > 0).alias("__good")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    good_of = {r[0]: r[1] for r in chosen.collect()}
    if not good_of:
        return {}
    ids = docs.sparkSession.createDataFrame([(i,) for i in good_of], chosen.select("__id").schema)
    sample = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__t"), F.col(lang_col).alias("__l")).join(F.broadcast(ids), F.col("__key") == F.col("__id"), "left_semi")
    measured = verdict(measure(sample, "__key", "__t", "__l", vocabulary), "__l").filter("not base_failed and __l is not null")
    figures = measured.groupBy("__key").agg(F.min(F.struct("__l", "n_tokens", "chars_per_token", "byte_share", "entropy_share")).alias("f")).select("__key", "f.*").collect()
    out = {}
    for lang in sorted({r[1] for r in figures}):
        mine = sorted(r for r in figures if r[1] == lang)
        good = np.array([good_of[r[0]] for r in mine])
        if good.sum() < LEAST_GOOD:
            continue
        n, chars, byte, entropy = (np.array([r[k] for r in mine], float) for k in (2, 3, 4, 5))
        root, long = 1 / np.sqrt(np.maximum(n, 1)), np.log2(np.maximum(n, 1))
        slack, lo, hi = _tightest(chars[good], chars[~good], np.arange(1, 8.25, 0.25), "lo hi", root[good], root[~good])
        per, full, _ = _tightest(entropy[good], entropy[~good], np.arange(0, 0.0825, 0.0025), "lo", long[good], long[~good])
        out[lang] = {"lo": lo, "hi": hi, "slack": slack, "bytes": float(byte[good].max()) + 0.05, "full": full, "per_doubling": per}
    return out


def verdict(measured: DataFrame, lang_col: str = "lang", bands: dict[str, dict[str, float]] | None = None, script_bands: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds base_failed, rejected_by and kept. base_failed: under 10 words, or over a fifth of the words in repeated windows.

    bands holds bands by language, as fit_bands gives them; without, all rows are judged by the wide bands of their script.
    rejected_by is the first rule broken of the band of the row's language, or of its script where the language is null
    or has no band: few_chars, many_chars, bytes, entropy; null if none is. kept: not base_failed, and no rule broken.
    """
    judged = F.lit(None).cast("string")
    for column, known in (("script", SCRIPT_BANDS if script_bands is None else script_bands), (lang_col, bands or {})):
        for name, band in known.items():
            broken = F.lit(None).cast("string")
            for rule, hit in reversed(_outside(band).items()):
                broken = F.when(hit, rule).otherwise(broken)
            judged = F.when(F.col(column) == name, broken).otherwise(judged)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("rejected_by", judged)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def good_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of docs that the verdict keeps, all columns as they are. The rows are judged where they lie; no join.

    Nulls, repeated rows and very long texts as in measure; an empty table gives none; other columns may have any name.
    """
    names = [f"__{c.split()[0]}" for c in MEASURES.split(", ")]
    places = {c: f"__c{k}" for k, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, places[text_col]):
            found = [pa.array(x) if isinstance(x, np.ndarray) else x for x in _measure(texts, tokenizer_path(VOCABULARY))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *found], [*rows.schema.names, *names])

    plain = docs.toDF(*places.values())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    measures = ", ".join(f"__{c}" for c in MEASURES.split(", "))
    measured = plain.mapInArrow(rested(run), f"{kinds}, {measures}")
    judged = verdict(measured.withColumnsRenamed({n: n[2:] for n in names}), places[lang_col], bands)
    return judged.filter("kept").select(*places.values()).toDF(*docs.columns)
