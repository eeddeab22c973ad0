"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, html_text, line_dedup, merkle, near_join, packing, quality, substring_dedup, token_counts, url_filters, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(tricky)
    done = chat.format_chats(turns).withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(again, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bands = quality.fit_bands(docs, table(spark, sf_dir, "labels"))
    measured = quality.verdict(quality.measure(docs), bands=bands)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measured.select(*base, "n_tokens", "chars_per_token", "byte_share", "entropy_share", "script", "rejected_by")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeats", "n_passages", "passage_words", (F.col("n_passages") > 0).alias("repeats_passage"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), share=line_dedup.SHARE, short_words=line_dedup.SHORT_WORDS)
    return done.select("doc_id", "text", "n_equal", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return done.select(F.col("source_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "record")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


#: The rules of the query (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]).drop("proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_html_extraction": op10_html_extraction,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_url_filters": op12_url_filters,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), '<+>', '<\+>')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _template_sql() -> str:
    """SQL of op12: the tree level by level, as many levels as url_filters.DEPTH."""
    rule = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (h, p, _) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][0] + r[1][1])))
    names, verdicts = [f"'{h}{p}'" for h, p, _ in URL_RULES], [f"'{v}'" for _, _, v in URL_RULES]
    depth = url_filters.DEPTH
    levels = []
    for k in range(depth):
        chi = " + ".join(
            f"CASE WHEN all_{c} > 0 THEN ({c}::DOUBLE - n::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE) * ({c}::DOUBLE - n::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE) / (n::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE)"
            f" + (all_{c} - {c} - (all_n - n)::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE) * (all_{c} - {c} - (all_n - n)::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE) / ((all_n - n)::DOUBLE * all_{c}::DOUBLE / all_n::DOUBLE) ELSE 0 END"
            for c in ("bad", "good", "none")
        )
        levels.append(f"""
on{k} AS MATERIALIZED (SELECT *, segs[{k + 1}] AS child FROM at{k} WHERE len(segs) > {k}),
child{k} AS MATERIALIZED (
  SELECT *, next || ' ' || CASE WHEN none >= bad AND none >= good THEN 'none' WHEN bad >= good THEN 'bad' ELSE 'good' END AS pool FROM (
    SELECT host, prefix, child, list(next ORDER BY n DESC, next DESC)[1] AS next, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, sum(n - bad - good) AS none FROM (
      SELECT host, prefix, child, coalesce(segs[{k + 2}], '/') AS next, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM on{k} GROUP BY ALL) GROUP BY host, prefix, child)),
branch{k} AS MATERIALIZED (
  SELECT host, prefix, child, CASE WHEN NOT contains(child, '#') AND (k > {url_filters.FANOUT} OR k > 1 AND {chi} <= {url_filters.CHI}) THEN '* ' || pool ELSE child END AS branch
  FROM child{k} LEFT JOIN (SELECT host, prefix, pool, count(*) AS k, sum(n) AS all_n, sum(bad) AS all_bad, sum(good) AS all_good, sum(none) AS all_none FROM child{k} WHERE NOT contains(child, '#') GROUP BY ALL) USING (host, prefix, pool)),
at{k + 1} AS MATERIALIZED (
  SELECT host, segs, n, bad, good, prefix FROM at{k} WHERE len(segs) <= {k}
  UNION ALL SELECT host, segs, n, bad, good, prefix || '/' || branch FROM on{k} JOIN branch{k} USING (host, prefix, child))""")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, CASE{rule.format(*names)} END AS rule, CASE{rule.format(*verdicts)} END AS ruled, CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') END AS every FROM h),
p AS MATERIALIZED (SELECT * EXCLUDE (every), CASE WHEN len(every) > {depth} THEN every[:{depth - 1}] || [array_to_string(every[{depth}:], '/')] ELSE every END AS segs FROM s),
at0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good, '' AS prefix FROM p GROUP BY host, segs),{",".join(levels)},
t AS (SELECT host, prefix, sum(bad)::BIGINT AS n_bad, sum(good)::BIGINT AS n_good FROM at{depth} GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN (n_bad + 1) / (n_bad + n_good + 2) >= {url_filters.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template, n_bad, n_good, (n_bad + 1) / (n_bad + n_good + 2) AS purity
FROM p JOIN at{depth} USING (host, segs) JOIN t USING (host, prefix)"""


def _merkle_sql(in_source: int = 6, over: int = 4) -> str:
    """SQL of op13 for sources of up to 16 ** in_source rows and up to 16 ** over sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce([4294967295] || {digits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

    def levels(name: str, count: int) -> list[str]:
        out = []
        for k in range(count):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT src, n, idx // 16 AS idx, CASE WHEN n > {16**k} THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY src, n, idx // 16)")
            side = lambda frame: f"CASE WHEN n > {16**k} THEN coalesce(string_agg(digest, '') OVER (PARTITION BY src, idx // 16 ORDER BY idx ROWS BETWEEN {frame}), '') ELSE '' END"  # noqa: B023, E731
            out.append(f"{name}_s{k} AS MATERIALIZED (SELECT src, idx, n > {16**k} AS up, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}{k})")
        return out

    def climb(name: str, before: str, count: int, src: str, idx: str) -> list[str]:
        out = []
        for k in range(count):
            out.append(f"{name}c{k + 1} AS (SELECT c.* EXCLUDE (fold, proof), CASE WHEN up THEN sha256(b || fold || a) ELSE fold END AS fold, proof || b || a AS proof FROM {f'{name}c{k}' if k else before} c JOIN {name}_s{k} s ON s.src = {src} AND s.idx = {idx} // {16**k})")
        return out

    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents)",
        "l AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)",
        "t0 AS (SELECT src, n, idx, leaf AS digest FROM l)",
        *levels("t", in_source),
        f"r0 AS MATERIALIZED (SELECT 0 AS src, count(*) OVER () AS n, src AS idx, digest FROM t{in_source})",
        *levels("r", over),
        "l0 AS (SELECT *, coalesce(tampered, leaf) AS fold, '' AS proof FROM l)",
        *climb("t", "l0", in_source, "c.src", "c.idx"),
        *climb("r", f"tc{in_source}", over, "0", "c.src"),
    ]
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, leaf, u.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
FROM rc{over} c JOIN t{in_source} u USING (src) CROSS JOIN r{over} r"""


ORACLE_SQL: dict[str, str] = {
    "op12_url_filters": _template_sql(),
    "op13_merkle_manifest": _merkle_sql(),
    "op2_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), s AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS more FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("text")}) + CASE WHEN more THEN 3 ELSE 14 + length(replace({_ESCAPED.format("role")}, ':', '\\:')) END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id""",
    "op7_decontamination": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) AS gram
  FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
occ AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, k, n, item_id FROM occ JOIN win USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
