"""The same tables in DuckDB's SQL: shared steps that the SQL of a query starts from."""

from __future__ import annotations

from ..functions.metadata import DATE_PATTERNS, NO_TAGS, UNKNOWN_GROUPS, VENDOR_HINTS
from ..functions.patterns import BLACKLIST, DICTIONARIES, PATTERNS, Vocabulary, compile_dictionary
from ..functions.vectors import NODE_TYPES
from ..operators.graph import _EVENTS, _HASHES, ROOT_LABEL, RULES
from .views import view_sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


_FORMATS = {"mdY": "%m-%d-%Y", "Ymd": "%Y-%m-%d", "mdy": "%m-%d-%y"}


def group_sql(name: str) -> str:
    first = rf"upper(regexp_split_to_array(trim({name}), '[\s_\-]+')[1])"
    return f"CASE WHEN {first} IN ({listed(UNKNOWN_GROUPS)}, '') THEN 'UNKNOWN' WHEN regexp_full_match({first}, '(APT)?\\d{{1,3}}') THEN 'APT' || regexp_replace({first}, '^APT', '') ELSE {first} END"


def date_sql(name: str) -> str:
    tries = []
    for pattern, order in DATE_PATTERNS:
        fmt = _FORMATS[order].replace("-", "") if pattern.startswith("_") else _FORMATS[order]
        tries.append(f"try_strptime(trim(regexp_extract({name}, {quoted(pattern)}), '()_'), '{fmt}')::DATE")
    return f"coalesce({', '.join(tries)})"


def vendor_sql(name: str, group: str) -> str:
    cases = " ".join(f"WHEN contains(lower({name}), {quoted(h)}) THEN {quoted(h.upper())}" for h in VENDOR_HINTS)
    later = rf"list_filter(regexp_split_to_array(trim({name}), '[()\s]+')[2:], lambda p: NOT starts_with(upper(p), {group}) AND regexp_full_match(p, '[A-Z]+') AND length(p) > 2)[1]"
    return f"CASE {cases} ELSE {later} END"


def tags_sql(name: str, group: str, vendor: str) -> str:
    tech = r"regexp_full_match(upper(p), 'T\d{4}(\.\d{3})?')"
    stays = f"p <> '' AND upper(p) <> {group} AND upper(p) IS DISTINCT FROM {vendor} AND ({tech} OR (upper(p) NOT IN ({listed(NO_TAGS)}) AND length(p) > 2))"
    return rf"list_transform(list_filter(regexp_split_to_array(trim({name}), '[()\s_]+'), lambda p: {stays}), lambda p: CASE WHEN {tech} THEN upper(p) ELSE p END)"


def slug_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '_', 'g'), '_')"


def segment_sql(text: str) -> str:
    clean = rf"regexp_replace(regexp_replace(replace(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return f"list_filter(list_transform(string_split({strip.format(clean)}, chr(10) || chr(10)), lambda x: {strip.format('x')}), lambda x: length(x) >= 20)"


def entities_sql() -> str:
    """Mentions in order. Letters outside ASCII become q first: DuckDB's word boundaries know ASCII only."""
    v, lists = Vocabulary(), []
    patterns = [(k, label, p, not cased) for k, (label, p, cased) in enumerate(PATTERNS)]
    patterns += [(len(PATTERNS) + k, label, compile_dictionary(getattr(v, label.lower())), True) for k, label in enumerate(DICTIONARIES) if compile_dictionary(getattr(v, label.lower()))]
    for rank, label, p, ignore in patterns:
        group = 1 if p.replace(r"\(", "").count("(") > p.count("(?") else 0
        lists.append(f"list_transform(regexp_extract_all(m, {quoted(('(?i)' if ignore else '') + p)}, {group}), lambda x: {{'label_rank': {rank}, 'label': {quoted(label)}, 'text': x}})")
    every = lists[0]
    for x in lists[1:]:
        every = f"list_concat({every}, {x})"
    return f"""SELECT report_id, paragraph_index, unnest(range(1, len(es) + 1))::INTEGER AS ordinal, unnest(es, recursive := true) FROM (
  SELECT report_id, paragraph_index, list_filter({every}, lambda e: length(e.text) BETWEEN 2 AND 100 AND lower(e.text) NOT IN ({listed(BLACKLIST)})) AS es
  FROM (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g') AS m FROM p))"""


def rules_sql() -> str:
    pairs = sorted({(a, b) for s, t in RULES for a in s for b in t})
    return "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ") AS rule(src_label, dst_label)"


_PLACE = f"list_position([{listed(_HASHES)}], {{}})"
#: Steps by name, each after those it needs.
STEPS: dict[str, str] = {
    "v": view_sql("duckdb"),
    "r1": f"SELECT *, {group_sql('raw_name')} AS apt_group, {date_sql('raw_name')} AS published_date FROM v",
    "r2": f"SELECT *, {vendor_sql('raw_name', 'apt_group')} AS source_vendor FROM r1",
    "r": f"SELECT *, {tags_sql('raw_name', 'apt_group', 'source_vendor')} AS extra_tags, {slug_sql('''concat_ws('_', apt_group, strftime(published_date, '%Y%m%d'), source_vendor)''')} || '_' || substr(md5(raw_name), 1, 8) AS report_id FROM r2",
    "p": f"SELECT report_id, apt_group, source_vendor, published_date, lang, unnest(range(len(ps)))::INTEGER AS paragraph_index, unnest(ps) AS text FROM (SELECT *, {segment_sql('text')} AS ps FROM r)",
    "e": entities_sql(),
    "k": "SELECT *, lower(trim(text)) AS text_key FROM e WHERE trim(text) <> ''",
    "n1": "SELECT report_id, text_key, label, min({'p': paragraph_index, 'o': ordinal, 't': text}) AS m FROM k GROUP BY ALL",
    "n2": "SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY m.p, m.o)::INTEGER AS node_idx, label, m.t AS text, text_key, m.p AS paragraph_index FROM n1",
    "n3": f"SELECT * FROM n2 UNION ALL SELECT DISTINCT report_id, 0, '{ROOT_LABEL}', report_id, lower(report_id), NULL FROM n2",
    "n": f"SELECT * FROM n3 WHERE report_id IN (SELECT report_id FROM n2 GROUP BY report_id HAVING count(*) >= 3)",
    "own": f"SELECT * FROM n WHERE label <> '{ROOT_LABEL}'",
    "f": "SELECT k.report_id, k.paragraph_index, k.ordinal, own.node_idx, k.label FROM k JOIN own USING (report_id, text_key, label)",
    "pl": "SELECT DISTINCT report_id, paragraph_index, node_idx FROM f",
    "x_cooc": "SELECT DISTINCT a.report_id, a.node_idx AS src, b.node_idx AS dst FROM pl a JOIN pl b USING (report_id, paragraph_index) WHERE a.node_idx < b.node_idx",
    "x_single": "SELECT DISTINCT report_id, min(node_idx) AS src, max(node_idx) AS dst FROM pl GROUP BY report_id, paragraph_index HAVING count(*) = 1",
    "near": "SELECT DISTINCT a.report_id, a.node_idx AS anchor, b.node_idx FROM pl a JOIN pl b USING (report_id, paragraph_index) WHERE (a.report_id, a.node_idx) IN (SELECT report_id, node_idx FROM pl GROUP BY ALL HAVING count(*) > 1)",
    "x_cross": "SELECT DISTINCT a.report_id, a.node_idx AS src, b.node_idx AS dst FROM near a JOIN near b USING (report_id, anchor) WHERE a.node_idx < b.node_idx",
    "x_root": "SELECT report_id, 0 AS src, node_idx AS dst FROM own",
    "x_semantic": f"SELECT DISTINCT a.report_id, a.node_idx AS src, b.node_idx AS dst FROM own a JOIN {rules_sql()} ON a.label = src_label JOIN own b ON b.report_id = a.report_id AND b.label = dst_label WHERE NOT (a.label IN ({listed(_HASHES)}) AND b.label IN ({listed(_HASHES)})) OR ({_PLACE.format('a.label')}, a.node_idx) < ({_PLACE.format('b.label')}, b.node_idx)",
    "x_campaign": f"SELECT DISTINCT a.report_id, a.node_idx AS src, b.node_idx AS dst FROM f a JOIN f b USING (report_id, paragraph_index) WHERE a.ordinal < b.ordinal AND (report_id, paragraph_index) IN (SELECT report_id, paragraph_index FROM f WHERE label IN ({listed(_EVENTS)}))",
    "x_small": "SELECT a.report_id, a.node_idx AS src, b.node_idx AS dst FROM own a JOIN own b USING (report_id) WHERE a.node_idx < b.node_idx AND report_id IN (SELECT report_id FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4)",
    "x1": "SELECT * FROM x_cooc UNION SELECT * FROM x_single UNION SELECT * FROM x_cross UNION SELECT * FROM x_root UNION SELECT * FROM x_semantic UNION SELECT * FROM x_campaign UNION SELECT * FROM x_small",
    "x": "SELECT * FROM x1 UNION SELECT report_id, dst, src FROM x1",
    "deg": "SELECT n.report_id, n.node_idx, coalesce(d, 0) AS d FROM n LEFT JOIN (SELECT report_id, src AS node_idx, count(*) AS d FROM x GROUP BY ALL) USING (report_id, node_idx)",
    "st": """SELECT report_id, num_nodes, coalesce(num_edges, 0) AS num_edges, max_degree, avg_degree, num_paragraphs, num_entities, apt_group, source_vendor, published_date
      FROM (SELECT report_id, count(*) AS num_nodes, max(d)::DOUBLE AS max_degree, avg(d) AS avg_degree FROM deg GROUP BY 1)
      LEFT JOIN (SELECT report_id, count(*) AS num_edges FROM x GROUP BY 1) USING (report_id)
      LEFT JOIN (SELECT report_id, count(*) AS num_paragraphs FROM p GROUP BY 1) USING (report_id)
      LEFT JOIN (SELECT report_id, count(*) AS num_entities FROM e GROUP BY 1) USING (report_id)
      JOIN r USING (report_id)""",
    "sc": "SELECT doc_id AS report_id, l.label, ((doc_id * 7 + l.k * 13 + doc_id % 11 * l.k) % 17 + 1)::DOUBLE / 100 AS raw FROM documents CROSS JOIN (VALUES ('de', 1), ('en', 2), ('es', 3), ('fr', 4)) AS l(label, k)",
    "scores": "SELECT report_id, label, raw / sum(raw) OVER (PARTITION BY report_id) AS probability FROM sc",
    "truth": "SELECT doc_id AS report_id, lang AS label FROM documents",
    "lp": "SELECT doc_id, quality AS label, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)",
    "hist": "SELECT user_id % 40 AS run_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS epoch, value AS val_loss, floor(value) % 7 / 7 AS val_acc, event_id FROM events",
    "t3": r"SELECT report_id, node_idx, least(length(text) / 100.0, 1.0) AS x0, length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)::DOUBLE AS x1, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)::DOUBLE AS x2 FROM n",
}


def steps(sql: str) -> str:
    """sql with the steps that it reads, and those that they read, in front."""
    import re

    wanted: set[str] = set()

    def add(text: str) -> None:
        for s in STEPS:
            if s not in wanted and re.search(rf"(?:FROM|JOIN|,)\s+{s}\b", text):
                wanted.add(s)
                add(STEPS[s])

    add(sql)
    parts = [f"{s} AS ({STEPS[s]})" for s in STEPS if s in wanted]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


TYPE_INDEX = f"coalesce(list_position([{listed(NODE_TYPES)}], {{}}) - 1, {len(NODE_TYPES)})"
