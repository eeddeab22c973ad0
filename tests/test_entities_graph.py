import re

from intelweave.functions.patterns import BLACKLIST, DICTIONARIES, MALWARE_FILE, PATTERNS, Vocabulary, compile_dictionary
from intelweave.operators import entities as D
from intelweave.operators import graph as G
from intelweave.sources.files import load_vocabulary

RICH = (
    "éon 😀 on host dc01.corp user admin-x at 10.0.0.1, evil.example.com, a@b.example.org, d41d8cd98f00b204e9800998ecf8427e; T1059.001 CVE-2021-1234 CWE-79 "
    "http://x.example.com/a?b=c C:\\Windows\\evil.dll HKLM\\Software\\Run; port 8443; 端口 445; process svchost.exe; service WinUpdate. "
    "Operation Night Owl. Campaign Dust-4. 金融 北京 Cobalt Strike by Kaspersky; port 7; user password; Boeing in China"
)


def _python(text, vocabulary):
    out = set()
    patterns = [(label, re.compile(p, 0 if cased else re.I)) for label, p, cased in PATTERNS]
    patterns += [(label, re.compile(p, re.I)) for label in DICTIONARIES if (p := compile_dictionary(getattr(vocabulary, label.lower())))]
    for label, p in patterns:
        for m in p.finditer(text):
            g = 1 if m.lastindex else 0
            if 2 <= len(m.group(g)) <= 100 and m.group(g).lower() not in BLACKLIST:
                out.add((label, m.group(g), m.start(g), m.end(g)))
    return out


def test_spans_equal_python(spark):
    texts = [RICH, "", "service " + "word " * 40, "nothing", RICH[::-1]]
    rows = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)], "report_id string, paragraph_index int, text string")
    v = Vocabulary(operation=["night owl"], industry=["金融"])
    found = D.extract_entities(rows, v).collect()
    for k, t in enumerate(texts):
        own = [e for e in found if e.paragraph_index == k]
        assert {(e.label, e.text, e.start, e.end) for e in own} == _python(t, v)
        assert [e.ordinal for e in sorted(own, key=lambda e: (e.label_rank, e.start))] == list(range(1, len(own) + 1)) or v.operation
        assert all(t[e.start : e.end] == e.text for e in own)


def _entities(spark, rows):
    return spark.createDataFrame([("r", p, label, t, 0, len(t), 0, o) for o, (p, label, t) in enumerate(rows, 1)], "report_id string, paragraph_index int, label string, text string, start int, end int, label_rank int, ordinal int")


def test_graph(spark):
    e = _entities(spark, [(0, "IP", "10.0.0.1"), (0, "DOMAIN", "a.example.com"), (1, "IP", "10.0.0.1"), (1, "CVE", "CVE-2021-1"), (2, "EMAIL", "x@y.org"), (3, "CAMPAIGN", "Dust"), (3, "IP", "9.9.9.9"), (3, "IP", "9.9.9.9")])
    nodes = G.build_nodes(e).cache()
    at = {r.text_key: r.node_idx for r in nodes.collect()}
    assert at["r"] == 0 and sorted(at.values()) == list(range(7))
    m = G.mentions(e, nodes)
    as_set = lambda df: {(r.src, r.dst) for r in df.collect()}
    ip, dom, cve, mail, dust, nine = (at[k] for k in ("10.0.0.1", "a.example.com", "cve-2021-1", "x@y.org", "dust", "9.9.9.9"))
    assert as_set(G.edges_cooccurrence(m)) == {(ip, dom), (ip, cve), (dust, nine)}
    assert as_set(G.edges_single_selfloop(m)) == {(mail, mail)}
    assert (dom, cve) in as_set(G.edges_cross_paragraph(m))
    assert (nine, nine) in as_set(G.edges_campaign(m))
    assert as_set(G.edges_semantic(nodes)) == {(ip, dom), (nine, dom), (dust, cve)}
    edges = G.build_edges(e, nodes).cache()
    both = as_set(edges)
    assert both == {(b, a) for a, b in both}
    d = G.degrees(edges, nodes).head()
    assert abs(d.avg_degree * 7 - len(both)) < 1e-9
    assert max(sum(1 for a, _ in both if a == k) for k in range(7)) == d.max_degree
    assert G.prune_edges(edges, nodes, 1).count() == len({a for a, _ in both})


def test_small_and_empty(spark):
    e = _entities(spark, [(0, "IP", "1.1.1.1"), (1, "IP", "2.2.2.2")])
    nodes = G.build_nodes(e)
    assert G.min_entities_filter(nodes).count() == 0
    assert {(r.src, r.dst) for r in G.edges_small_graph(nodes).collect()} == {(1, 2)}
    assert {(r.src, r.dst) for r in G.edges_fallback(nodes, G.edges_small_graph(nodes).limit(0)).collect()} == {(1, 1), (0, 1)}
    assert G.build_nodes(e.limit(0)).count() == 0


def test_whole_malware_list(spark):
    v = Vocabulary()
    assert len(v.malware) == len(set(v.malware)) == 464 and load_vocabulary(spark, str(MALWARE_FILE), "malware") == v.malware
    names = ["formbook", "greyenergy", "dogcall", "elise", "crosswalk", "gameover zeus", "plugx", "ozone"]
    p = spark.createDataFrame([("r", 0, "Seen: " + ", ".join(names) + ".")], "report_id string, paragraph_index int, text string")
    assert {r.text for r in D.extract_entities(p).filter("label = 'MALWARE'").collect()} == set(names)
