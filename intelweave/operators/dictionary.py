"""Large vocabularies: which of their terms may stand in which paragraph, by a join of word n-grams.

A term's key is the hash of its first words, four at most; a paragraph's keys are the hashes of its word n-grams, once
each. Terms that share a key with a paragraph are its candidates, a few among any number of terms. They make up the
paragraph's own pattern, which settles case, separators, overlaps and places just as one pattern of all terms would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.metadata import strip
from ..session import broadcast_if_small

#: Words that make up a key at most.
KEY_WORDS = 4
#: Characters that a pattern takes for more than themselves.
_SPECIAL = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"


#: Lower-case letters that share their capital with another one, and that other one (ſ and s, ς and σ, ...).
_TWINS = {c: f for c in map(chr, range(0x20000)) if len(u := c.upper()) == 1 and len(f := u.lower()) == 1 and f != c == c.lower()}


#: Characters that folded maps one by one: _TWINS and İ have none below ı but µ and İ itself.
_RARE = r"[\xB5\x{130}-\x{10FFFF}]"
#: Characters beyond Latin 1.
_FAR = r"[\x{100}-\x{10FFFF}]"


def _holds(text: Column, rare: str) -> Column:
    """Whether rare, a class without ASCII characters, is in text. A text of as many bytes as characters is not looked through."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(rare)


def far(text: Column) -> Column:
    return _holds(text, _FAR)


def folded(text: Column) -> Column:
    """text in a form in which letters that differ in case only are equal; as long as text."""
    each = F.translate(F.lower(F.translate(text, "İ", "i")), "".join(_TWINS), "".join(_TWINS.values()))
    return F.when(_holds(text, _RARE), each).otherwise(F.lower(text))


def words(folded_text: Column) -> Column:
    return F.filter(F.split(folded_text, r"(?U)\W+", -1), lambda w: w != "")


def escaped(term: Column) -> Column:
    return F.regexp_replace(term, _SPECIAL, r"\\$1")


def normalized_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term) without blanks around it; null and empty ones are left out, repeated ones stay."""
    return terms.select(strip(F.col(column)).alias("term")).filter("term <> ''")


def term_index(terms: DataFrame) -> DataFrame:
    """(key, n_words, label_rank, place, escaped, head, first) from terms (label_rank, place, term): blanks around terms go, and so do empty terms.

    Of terms that match at one place the first by (place, escaped) counts. A term without a word has key 0.
    """
    clean = terms.select("label_rank", "place", strip(F.col("term")).alias("term")).filter("term <> ''").distinct()
    keyed = clean.withColumn("w", F.slice(words(folded(F.col("term"))), 1, KEY_WORDS))
    key = F.when(F.size("w") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*[F.get("w", F.lit(k)) for k in range(KEY_WORDS)]))
    return keyed.select(key.alias("key"), F.size("w").alias("n_words"), "label_rank", "place", escaped(F.col("term")).alias("escaped"), escaped(F.left(folded(F.col("term")), F.lit(1))).alias("head"), F.get("w", F.lit(0)).alias("first"))


def alternation(terms: Column) -> Column:
    """Alternatives of terms (place, escaped, head), in order. Those of one first letter stand together behind a look at that letter: others can't match at the same place."""
    of_head = lambda h: F.array_join(F.transform(F.filter(terms, lambda t: t["head"] == h), lambda t: t["escaped"]), "|")
    heads = F.array_distinct(F.transform(terms, lambda t: t["head"]))
    return F.array_join(F.transform(heads, lambda h: F.concat(F.lit("(?="), h, F.lit(")(?:"), of_head(h), F.lit(")"))), "|")


def paragraph_keys(folded_text: Column, lengths: list[int]) -> Column:
    """Distinct keys of all n-grams of the given lengths; 0 is always among them."""
    grams = lambda w: F.flatten(F.transform(w, lambda _, i: F.array(*[F.xxhash64(*[F.get(w, i + k) for k in range(n)]) for n in lengths])))
    inside = F.transform(F.array(words(folded_text)), lambda w: grams(w)) if lengths else F.array(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.element_at(inside, 1)))


#: So many terms at most go into the plan as literals; more are joined.
INLINE_TERMS = 4096


def term_rows(index: DataFrame) -> list[Row] | None:
    """The rows of an index of few terms; None, after a look at a bounded number of rows, if there are more."""
    rows = index.limit(INLINE_TERMS + 1).collect()
    return rows if len(rows) <= INLINE_TERMS else None


def known_keys(folded_text: Column, rows: list[Row]) -> Column:
    """The keys among paragraph_keys that terms of few rows have. Only n-grams that begin like a term are hashed."""
    firsts = sorted({r.first for r in rows if r.first is not None})
    lengths = sorted({r.n_words for r in rows if r.n_words > 0})
    always = F.array(F.lit(0).cast("long")) if any(r.n_words == 0 for r in rows) else F.array().cast("array<bigint>")
    if not firsts:
        return always
    at = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.isin(firsts), i)), lambda i: i.isNotNull())
    grams = lambda w: F.flatten(F.transform(at(w), lambda i: F.array(*[F.xxhash64(*[F.get(w, i + k) for k in range(n)]) for n in lengths])))
    inside = F.element_at(F.transform(F.array(words(folded_text)), grams), 1)
    return F.concat(always, F.filter(inside, lambda h: h.isin(sorted({r.key for r in rows}))))


def numbered_terms(rows: list[Row]) -> list[tuple[int, str, set[int]]]:
    """(rank, alternative, keys) of the terms of rows: by rank, then in the order of alternation."""
    keys: dict[tuple, set[int]] = {}
    for r in rows:
        keys.setdefault((r.label_rank, r.place, r.escaped.encode("utf-8"), f"(?={r.head})\\b{r.escaped}"), set()).add(r.key)
    return [(t[0], t[3], k) for t, k in sorted(keys.items())]


def known_terms(keys: Column, terms: list[tuple[int, str, set[int]]]) -> Column:
    """Numbers of the terms that have one of the keys, ascending."""
    of_key: dict[int, list[int]] = {}
    for n, (_, _, own) in enumerate(terms):
        for k in own:
            of_key.setdefault(k, []).append(n)
    if not of_key:
        return F.array().cast("array<int>")
    numbers = F.create_map(*[x for k, own in of_key.items() for x in (F.lit(k).cast("long"), F.array(*map(F.lit, own)))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys, lambda k: numbers[k]))))


def rank_pattern(numbers: Column, terms: list[tuple[int, str, set[int]]], rank: int) -> Column:
    """Alternatives of the terms of a rank among numbers, each with the edge of a word before it; null without any."""
    own = [n for n, t in enumerate(terms) if t[0] == rank]
    listed = F.array(*[F.lit(terms[n][1]) for n in own])
    found = F.transform(F.filter(numbers, lambda n: n.between(own[0], own[-1])), lambda n: F.get(listed, n - own[0]))
    return F.when(F.size(numbers) > 0, F.nullif(F.array_join(found, "|"), F.lit("")))


def candidate_patterns(paragraphs: DataFrame, index: DataFrame, ranks: list[int], keys: list[str], folded_col: str) -> DataFrame:
    """(keys, t<rank> for each rank): alternatives of the terms of a rank that may stand in the paragraph; null without any.

    The index is broadcast when its measured size is small; a larger one is dealt out by key, as are the paragraphs' keys.
    """
    lengths = sorted(r.n_words for r in index.filter("n_words > 0").select("n_words").distinct().collect())  # four numbers at most
    each = paragraphs.select(*keys, F.explode(paragraph_keys(F.col(folded_col), lengths)).alias("key"))
    found = each.join(broadcast_if_small(index.drop("n_words", "first")), "key")
    of_rank = lambda r: F.array_sort(F.collect_set(F.when(F.col("label_rank") == r, F.struct("place", "escaped", "head")))).alias(f"s{r}")
    named = found.groupBy(*keys).agg(*[of_rank(r) for r in ranks])
    return named.select(*keys, *[F.nullif(alternation(F.col(f"s{r}")), F.lit("")).alias(f"t{r}") for r in ranks])
