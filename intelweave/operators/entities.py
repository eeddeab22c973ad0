"""Typed entities of paragraphs, with their places, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BLACKLIST, DICTIONARIES, GATES, GUARDS, PATTERNS, WORD_LISTS, Vocabulary
from ..session import by_key, kept, lookup
from .dictionary import candidate_patterns, far, folded, known_keys, known_terms, numbered_terms, rank_pattern, term_index, term_rows

#: Matches of a text whose places are added up at once.
_CHUNK = 256
#: So few matches get their places by a sum for each.
_FEW = 8
#: Marks put around a match and its group. Taken out of the text first.
_OPEN, _GROUP, _CLOSE = "\u0001", "\u0002", "\u0003"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans_sql(text: str, pattern: str, grouped: bool, fields: str, keep: str) -> str:
    """Array of structs (fields, then text, start) of all matches of pattern (SQL) in the column text that keep holds for.

    The text is marked and cut at the marks once (m); the places of the parts are sums of their lengths, for many parts a
    running sum, chunk by chunk. A group ends its match, and so does the span.
    """
    marks = _literal(f"{_OPEN}$0{_GROUP}$1{_CLOSE}" if grouped else f"{_OPEN}$0{_CLOSE}")
    first = f"substring_index(p, '{_CLOSE}', 1)"
    named = f"substring_index({first}, '{_GROUP}', -1)" if grouped else first
    after = f"length(p) - length({named}) - 2" if grouped else "length(p) - 1"
    before = f"length(substring_index(p, '{_GROUP}', 1)) - length({named})" if grouped else "0"
    span = lambda at: f"named_struct({fields}'text', {named}, 'start', {at} + {before})"
    parts = "slice(m, 2, greatest(size(m) - 1, 0))"
    few = f"transform({parts}, (p, i) -> {span(f'aggregate(slice(m, 2, i), length(m[0]), (acc, p) -> acc + {after})')})"
    # Sums of chunks first: an array that grows by one is copied each time, here once for each of a chunk.
    sums = lambda lengths, first: f"aggregate({lengths}, named_struct('at', {first}, 'every', cast(array() AS array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'every', concat(acc.every, array(acc.at))), acc -> acc.every)"
    chunks = f"transform(sequence(0, greatest(size(m) - 2, 0) div {_CHUNK}), c -> transform(slice(m, cast(c AS int) * {_CHUNK} + 2, {_CHUNK}), p -> {after}))"
    total = "transform(ch, x -> aggregate(x, 0, (acc, n) -> acc + n))"
    places = f"element_at(transform(array({chunks}), ch -> flatten(zip_with(ch, {sums(total, 'length(m[0])')}, (x, base) -> {sums('x', 'base')}))), 1)"
    every = f"CASE WHEN size(m) <= {_FEW + 1} THEN {few} ELSE zip_with({parts}, {places}, (p, at) -> {span('at')}) END"
    return f"element_at(transform(array(split(regexp_replace({text}, {pattern}, {marks}), '{_OPEN}', -1)), m -> filter({every}, s -> {keep})), 1)"


def extract_spans(text: str, pattern: str, grouped: bool) -> Column:
    """Array of (text, start, end) of all matches in the column text, in order; a group, if there is one, replaces its match."""
    return F.expr(f"transform({_spans_sql(text, _literal(pattern), grouped, '', 'true')}, s -> named_struct('text', s.text, 'start', s.start, 'end', s.start + length(s.text)))")


def long_enough(text: Column) -> Column:
    return F.length(text).between(2, 100)


def blacklisted(text: Column) -> Column:
    return F.lower(text).isin(BLACKLIST)


def _guard_sql(label: str, fold: str, is_far: str) -> str:
    literals, pattern = GUARDS[label]
    near = [x for x in literals if x.isascii()]
    held = lambda some: " OR ".join(f"contains({fold}, {_literal(x)})" for x in some)
    tests = [gate for gate, (_, labels) in GATES.items() if label in labels]
    tests += [" OR ".join(([held(near)] if near else []) + ([f"{is_far} AND ({held(rest)})"] if (rest := [x for x in literals if x not in near]) else []))] if literals else []
    tests += [f"{fold} RLIKE {_literal(pattern)}"] if pattern and pattern not in [GATES[t][0] for t in tests if t in GATES] else []
    return " AND ".join(f"({t})" for t in tests)


def extract_entities(paragraphs: DataFrame, vocabulary: Vocabulary | None = None, terms: DataFrame | None = None) -> DataFrame:
    """entities of paragraphs (report_id, paragraph_index, text): one row per mention, numbered within its paragraph.

    Ordered by label, then place. Texts of fewer than 2 or more than 100 characters and blacklisted ones are left
    out. Labels that a pattern and a dictionary share give a mention at one place once. A null text has no mentions.
    terms (label, term; labels of DICTIONARIES) adds to the vocabulary any number of terms that never pass the driver.
    (report_id, paragraph_index) must be a key of paragraphs: dictionaries of more than INLINE_TERMS terms are joined by it.
    """
    return _rows(*_mentions(paragraphs, ["report_id", "paragraph_index"], vocabulary, terms))


#: Bytes that the mentions of a text may take in memory.
_TEXT_BYTES = 4000


def extract_entities_by_text(paragraphs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The rows of extract_entities, for paragraphs that are often alike: each different text is looked through once.

    Paragraphs are kept as a table; the mentions of a text meet them by the text's digest. Texts that very many paragraphs
    share are dealt out to several tasks.
    """
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    every = kept(paragraphs.filter("text IS NOT NULL").select("report_id", "paragraph_index", "text", key.alias("text_id")))
    texts = every.groupBy("text").agg(F.count(F.lit(1)).alias("n_paragraphs")).select(key.alias("text_id"), "n_paragraphs", "text")
    both, mentions = _mentions(texts, ["text_id", "n_paragraphs"], vocabulary)
    found = kept(both.select("text_id", "n_paragraphs", mentions.alias("mentions"))).filter("size(mentions) > 0")
    met = lookup(every.drop("text"), found.hint("merge"), ["text_id"], "n_paragraphs", "report_id", _TEXT_BYTES)
    return _rows(met, F.col("mentions"))


def _rows(paragraphs: DataFrame, mentions: Column) -> DataFrame:
    # the array stands inside the explode: as a column it would be made once for its rows and once for a filter on its size
    out = paragraphs.select("report_id", "paragraph_index", F.posexplode(mentions).alias("ordinal", "e"))
    return out.select("report_id", "paragraph_index", F.col("e.label").alias("label"), F.col("e.text").alias("text"), F.col("e.start").alias("start"), (F.col("e.start") + F.length("e.text")).alias("end"), F.col("e.label_rank").alias("label_rank"), (F.col("ordinal") + 1).alias("ordinal"))


def _mentions(paragraphs: DataFrame, ids: list[str], vocabulary: Vocabulary | None, terms: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """paragraphs (ids, text) as a table with ids, and an array of all mentions in order as a column of it."""
    vocabulary, spark = vocabulary or Vocabulary(), paragraphs.sparkSession
    known = spark.createDataFrame(vocabulary.terms(), "label_rank int, place int, term string")
    ranks = sorted({r for r, _, _ in vocabulary.terms()} | set(range(len(PATTERNS), len(PATTERNS) + len(DICTIONARIES)) if terms is not None else ()))
    if terms is not None:
        ranked = F.array_position(F.lit(DICTIONARIES), F.col("label")).cast("int")
        known = known.union(terms.filter(ranked > 0).select(ranked + (len(PATTERNS) - 1), F.lit(0), "term"))
    whole, marks = F.coalesce("text", F.lit("")), _OPEN + _GROUP + _CLOSE
    clean = F.when(whole.rlike(f"[{marks}]"), F.translate(whole, marks, "")).otherwise(whole)
    if terms is not None:
        paragraphs = paragraphs.select(*ids, "text").repartition(*ids)
    plain = paragraphs.select(*ids, clean.alias("__text")).withColumn("__fold", folded(F.col("__text"))).withColumn("__far", far(F.col("__fold")))
    plain = plain.withColumns({gate: F.col("__fold").rlike(test) for gate, (test, _) in GATES.items()})
    index = term_index(known)
    few = term_rows(index)
    if few is not None:  # few terms: each paragraph is judged by itself, without a shuffle
        listed = numbered_terms(few)
        ranks, edge = sorted({r for r, _, _ in listed}), ""
        both = plain.withColumn("__keys", known_keys(F.col("__fold"), few)).withColumn("__terms", known_terms(F.col("__keys"), listed))
        both = both.select(*plain.columns, *[rank_pattern(F.col("__terms"), listed, r).alias(f"t{r}") for r in ranks])
    else:  # texts are dealt out once: their keys, candidates and patterns stay with them
        both, edge = plain.join(by_key(candidate_patterns(plain, index, ranks, ids, "__fold")), ids, "left"), r"\\b"

    stays = f"length(s.text) BETWEEN 2 AND 100 AND lower(s.text) NOT IN ({', '.join(map(_literal, BLACKLIST))})"
    none = "cast(array() AS array<struct<label_rank: int, label: string, text: string, start: int>>)"
    spans, labels = [], []
    for rank, label in enumerate([label for label, _, _ in PATTERNS] + DICTIONARIES):
        if rank < len(PATTERNS) and label not in WORD_LISTS:
            pattern, grouped = vocabulary.pattern(rank)
            guard, pattern = _guard_sql(label, "__fold", "__far"), _literal(pattern)
        elif rank in ranks:
            guard, pattern, grouped = f"t{rank} IS NOT NULL", f"concat('(?iU){edge}(?:', t{rank}, ')\\\\b')", False
        else:
            continue
        labels.append(label)
        spans.append(f"CASE WHEN {guard} THEN {_spans_sql('__text', pattern, grouped, f"'label_rank', {rank}, 'label', {_literal(label)}, ", stays)} ELSE {none} END")
    every = F.expr(f"concat({', '.join(spans)})") if spans else F.expr(none)
    shared = sorted({x for x in labels if labels.count(x) > 1})
    if shared:
        named = lambda e: F.struct(e["start"], F.length(e["text"]), e["label"])
        by_pattern = lambda e: (e["label_rank"] < len(PATTERNS)) & e["label"].isin(shared)
        unlike = lambda m: F.transform(F.array(F.transform(F.filter(m, by_pattern), named)), lambda first: F.filter(m, lambda e: (e["label_rank"] < len(PATTERNS)) | ~e["label"].isin(shared) | ~F.array_contains(first, named(e))))
        every = F.element_at(F.flatten(F.transform(F.array(every), unlike)), 1)
    return both, every


def deduplicate_mentions(entities: DataFrame) -> DataFrame:
    """The first row, by ordinal, of mentions of a paragraph that agree in place, label and lower-case text."""
    cols = [c for c in entities.columns if c not in ("report_id", "paragraph_index", "start", "end", "label")]
    first = entities.groupBy("report_id", "paragraph_index", "start", "end", "label", F.lower("text").alias("__key")).agg(F.min_by(F.struct(*cols), "ordinal").alias("f"))
    return first.select("report_id", "paragraph_index", "label", "start", "end", "f.*").select(*entities.columns)
