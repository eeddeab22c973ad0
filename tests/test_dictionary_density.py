"""Large vocabularies, density clusters, components and the stateful stream against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from intelweave import session
from intelweave.functions.patterns import GUARDS, PATTERNS, WORD_LISTS, Vocabulary, compile_dictionary
from intelweave.operators import density
from intelweave.operators import entities as D
from intelweave.operators.components import connected_components
from intelweave.streaming.ingest import ingest_new_files


@pytest.fixture(params=["broadcast", "shuffled"])
def join_by(request, monkeypatch):
    """With no bytes allowed to be broadcast, indexes and facts are dealt out by key."""
    if request.param == "shuffled":
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    return request.param


def _paragraphs(spark, texts):
    return spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)], "report_id string, paragraph_index int, text string")


def _only(**lists):
    return Vocabulary(**{"malware": [], "tool": [], "org": [], "country": []} | lists)


def test_every_pattern_is_guarded_or_a_list():
    assert {label for label, _, _ in PATTERNS} == set(GUARDS) | set(WORD_LISTS) and not set(GUARDS) & set(WORD_LISTS)


def test_terms_equal_one_regular_expression(spark, join_by):
    terms = [
        "Sony", "Sony Pictures", "sony pictures entertainment group holding", "one two three four five", "one two three four six", "net", "at.exe", ".net", "c++", "++", "ATT&CK", "7zip", "İstanbul", "straße", "STRASSE", "ſign", "Kelvin",
        "金融", "a", "tab\tterm", "Ida Pro", "ida", " padded ", "x(y)[z]", "naïve", "two  blanks", "",
    ]
    texts = [
        "SONY pictures and Sony Pictures Entertainment Group Holding; sony.", "one two three four five six one two three four six ONE TWO THREE FOUR five", "use at.exe, asp.net, .NET and net; C++x c++ x++y 7ZIP", "att&ck ATT CK",
        "in istanbul, İSTANBUL, STRAẞE, strasse, Straße, SIGN, Kelvin kelvin", "金融 金融业 A a b", "tab\tterm tab term", "IDA PRO ida pro2 padded", "x(y)[z] x(y)[z]a", "NAÏVE naive", "two  blanks two blanks", "", None, "word " * 3000 + "Sony",
    ]
    got = {(r.paragraph_index, r.text, r.start, r.end) for r in D.extract_entities(_paragraphs(spark, texts), _only(malware=terms)).filter("label = 'MALWARE'").collect()}
    plain = re.compile(r"\b(?:" + "|".join(sorted({re.escape(t.strip()) for t in terms if t.strip()})) + r")\b", re.I)
    found = {(k, m.group(), m.start(), m.end()) for k, t in enumerate(texts) for m in plain.finditer(t or "")}
    want = {f for f in found if 2 <= len(f[1]) <= 100 and f[1].lower() not in D.BLACKLIST}
    assert got == want and len(want) > 25


def test_built_in_terms_equal_their_regular_expressions(spark, join_by):
    rng = random.Random(3)
    v = Vocabulary()
    labels = ["MALWARE", "TOOL", "ORG", "COUNTRY"]
    every = [t for label in labels for t in getattr(v, label.lower())]
    assert len(every) > 800
    words = ["the", "of", "strike", "panda", "group", "net", "exe", "south", "-", ".", ";"]
    texts = [" ".join(rng.choice([rng.choice(every), rng.choice(every).upper(), rng.choice(words)]) for _ in range(60)) for _ in range(60)]
    got = Counter((r.paragraph_index, r.label, r.text, r.start, r.end) for r in D.extract_entities(_paragraphs(spark, texts)).collect() if r.label in labels)
    want = Counter()
    for label in labels:
        p = re.compile(compile_dictionary(getattr(v, label.lower())), re.I)
        want += Counter((k, label, m.group(), m.start(), m.end()) for k, t in enumerate(texts) for m in p.finditer(t) if len(m.group()) > 1 and m.group().lower() not in D.BLACKLIST)
    assert got == want


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("'MALWARE' AS label", "concat('mal', id, if(id % 3 = 0, ' loader kit', '')) AS term")
    texts = [f"saw mal{k} loader kit and MAL{k + 1}, mal{k + 2}x" for k in range(0, 3000, 3)]
    got = Counter(r.text.lower() for r in D.extract_entities(_paragraphs(spark, texts), _only(), terms).filter("label = 'MALWARE'").collect())
    assert got == Counter(x for k in range(0, 3000, 3) for x in (f"mal{k} loader kit", f"mal{k + 1}"))


def _plain_clusters(ids, vectors, eps, least):
    near = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    cluster: dict = {}
    for i in np.argsort(ids):
        if core[i] and i not in cluster:
            todo, cluster[i] = [i], ids[i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if j not in cluster:
                        cluster[j] = ids[i]
                        todo.append(j)
    beside = lambda i: min(np.flatnonzero(near[i] & core), key=lambda j: ids[j], default=None)
    return {ids[i]: (int(near[i].sum()), bool(core[i]), cluster.get(i) if core[i] else cluster.get(beside(i))) for i in range(len(ids))}


@pytest.mark.parametrize("held", [1024, 7])
def test_density_clusters_equal_brute_force(spark, monkeypatch, join_by, held):
    monkeypatch.setattr(density, "HELD", held)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    vectors = np.concatenate([centres[k % 4] + rng.normal(scale=0.12, size=6) for k in range(120)] + [rng.normal(size=6) for _ in range(40)]).reshape(160, 6)
    vectors[150:] = vectors[0]  # copies
    ids = rng.permutation(160).tolist()
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)] + [(999, None, 1)]
    got = {r.report_id: (r.n_near, r.core, r.cluster) for r in density.dbscan(spark.createDataFrame(rows, "report_id long, v array<double>, weight int"), 0.45, 5).collect()}
    assert got.pop(999) == (0, False, None)
    want = _plain_clusters(ids, vectors, 0.45, 5)
    assert got == want
    assert len({c for _, _, c in want.values()}) > 3 and any(c is None for _, _, c in want.values()) and any(c is not None and not core for _, core, c in want.values())


def test_density_clusters_of_nothing(spark):
    assert density.dbscan(spark.createDataFrame([], "report_id long, v array<double>"), 1.0, 2).collect() == []


def test_components(spark, join_by):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_stream_reads_json_and_other_suffixes_and_keeps_its_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_bytes(text)
    run = lambda **more: ingest_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", _only(), **more).awaitTermination()
    long = b"Seen from 10.1.2.3 and nowhere else in all of these days."
    put("APT28_a.json", b'{"z": "Seen from 10.9.9.9 in these days", "a": 1}')
    put("FIN7_b.log", long)
    put("noname", long)
    put("APT1_c.pdf", b"%PDF-1.7")
    run()
    table = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    first = {r.raw_name: r.file_type for r in table("reports").collect()}
    assert first == {"APT28_a": "json", "FIN7_b": "log", "noname": ""}
    assert {r.text for r in table("entities").filter("label = 'IP'").collect()} == {"10.9.9.9", "10.1.2.3"}
    before = sorted(map(str, table("entities").collect()))
    put("FIN7_b.text", b"The same name again, with another text: 10.7.7.7 it says.")
    run()
    assert sorted(map(str, table("entities").collect())) == before and table("reports").count() == 3
    put("FIN8_d.txt", long)
    run()
    assert table("reports").count() == 4


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "APT28_a.txt").write_text("Seen from 10.1.2.3 and nowhere else in all of these days.")
    run = lambda: ingest_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", _only(), within="30 days").awaitTermination()
    run()
    rows = lambda: sorted(str(r) for name in ("reports", "paragraphs", "entities") for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect())
    before = rows()
    for f in (tmp_path / "cp" / "commits").glob("*0"):  # as if the driver had been lost before it noted that the batch was done
        f.unlink()
    run()
    assert rows() == before and len(before) > 2


def test_places_of_many_matches(spark):
    text = "".join(f"10.0.{k % 256}.{k % 7} x" + " " * (k % 3) for k in range(1500))
    got = [(s.text, s.start) for r in _paragraphs(spark, [text]).select(D.extract_spans("text", r"\b10\.0\.\d+\.\d+\b", False).alias("s")).collect() for s in r.s]
    assert got == [(m.group(), m.start()) for m in re.finditer(r"\b10\.0\.\d+\.\d+\b", text)] and len(got) == 1000
