"""Tokenizer alignment, URL filters and the Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from intelweave.llm import alignment, common, merkle, url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=["broadcast", "shuffled"])
def join_by(request, monkeypatch):
    """Small facts are broadcast; with no bytes allowed every lookup deals out its rows, hot keys by salt."""
    if request.param == "shuffled":
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    return request.param


TEXTS = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " "), (6, "  two  blanks \n\n end "), (7, "a▁b is no text"),
    (8, "<s> <|endoftext|> <0x41> \x00"), (9, "é中文 \U0001f600\U0001f600 x  "), (10, "a　 b\tc\r\n d\x1c \x85 ​e"), (11, "q" * 3000 + " don't  I'll\n x"), (None, "null id"), (12, "word " * 4000),
]


def _plain_alignment(rows):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}

    def ends(parts):
        out = []
        for p in parts:
            out.append((out[-1] if out else 0) + len(p))
        return out

    def one(text):
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            return None
        ea, eb = ends(ba), ends(bb)
        links, k = [], 0
        for i, e in enumerate(ea):
            while eb[k] <= e - len(ba[i]):
                k += 1
            j = k
            while j < len(eb) and eb[j] - len(bb[j]) < e:
                links.append((ia[i], ib[j]))
                j += 1
        cuts = sorted(set(ea) & set(eb))
        groups = [f"{','.join(str(i) for i, e in zip(ia, ea) if lo < e <= hi)}|{','.join(str(i) for i, e in zip(ib, eb) if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(cuts) < 500 else None
        return len(ia), len(ib), len(cuts), links, groups

    found = [(i, one(t)) for i, t in rows]
    count = Counter(link for _, x in found if x for link in x[3])
    most: dict = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = Counter()
    for i, x in found:
        if not x:
            out[(i, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            sha = hashlib.sha256(";".join(x[4]).encode()).hexdigest() if x[4] else None
            out[(i, x[0], x[1], x[2], len(x[3]), sum(count[n] == most[n[1]] for n in x[3]), sum(count[n] for n in x[3]), sha)] += 1
    return out


def test_alignment_equals_plain_python(spark, join_by):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("pair", F.lit("x")).withColumn("copies", F.lit(0))
    got = Counter(tuple(x) for x in alignment.align(docs).collect())
    want = _plain_alignment(TEXTS)
    blind = lambda c: Counter({(*k[:7], k[7] if k[0] not in (11, 12) else None): n for k, n in c.items()})
    assert blind(got) == blind(want)
    assert {k[7] for k in got if k[1] == 0} == {""}


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_parts_that_are_forgotten_are_found_again(monkeypatch):
    texts = [" ".join(f"w{k} x" for k in range(300)), "", "b▁d  \n", "a  b " * 50 + "x▁y", "é中 " * 400 + "\x00", " ", "ab" * 3000]
    plain = lambda found: [(*x[:5], list(x[5]), list(x[6])) for x in found]
    make = lambda: alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want = plain(make().texts(texts))
    whole = make()
    whole.cuts = False
    assert plain(whole.texts(texts)) == want
    for name, value in (("SLICE", 40), ("AT_ONCE", 7), ("BATCH", 30), ("HELD", 2000)):
        monkeypatch.setattr(alignment, name, value)
    small = make()
    assert plain(small.texts(texts)) == want and plain(small.texts(texts[::-1])) == want[::-1]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_hosts_paths_and_rules(spark, join_by):
    urls = [
        (1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "https://m.example.net/en/1?q#f", "m.example.net", "/en/1", "example.net/en/", "allow"), (3, "https://m.example.net/EN/1", "m.example.net", "/EN/1", "net/", "block"),
        (4, "http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), (5, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (6, "http://example.com/de", "example.com", "/de", None, "allow"),
        (7, "x.net/a", "", "", None, "allow"), (8, None, "", "", None, "allow"), (9, "http://net", "net", "", None, "allow"), (10, "://b.org/fr/?x://y", "b.org", "/fr/", "org/fr/", "allow"), (11, "http://É.net/ä", "É.net", "/ä", "net/", "block"),
        (12, "http://h.com#/de/", "h.com", "", None, "allow"), (12, "http://h.com?a=1", "h.com", "", None, "allow"), (13, "http://h.com/" + "/".join("ab" for _ in range(3000)), "h.com", "/" + "/".join("ab" for _ in range(3000)), None, "allow"), (None, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(u[0], u[1]) for u in urls], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("segs", F.lit(2)).withColumn("rule", F.lit("z"))
    got = Counter(tuple(x) for x in url_filters.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == Counter((u[0], *u[2:]) for u in urls)


def test_templates_of_bad_pages_are_rejected(spark, join_by):
    rows = []
    for k in range(60):
        rows += [(f"http://s.com/casino/{k}.html", True if k < 30 else None), (f"http://s.com/news/{k}.html", False if k < 30 else None)]  # half is labelled
        rows += [(f"http://s.com/by/{chr(97 + k % 26)}{chr(97 + k // 26)}x/{k}", None)]  # a variable of many values
        rows += [(f"http://s.com/{s}/view/{k}", None) for s in ("red", "blue")]  # alike: one branch
    rows += [(f"http://t.com/a/{k}", True) for k in range(5)]  # too few to tell
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, bad boolean")
    out = {r.page_id: r for r in url_filters.judge_urls(pages, [], bad_col="bad").collect()}
    at = {url: out[k] for k, (url, _) in enumerate(rows)}
    assert {at[f"http://s.com/casino/{k}.html"].verdict for k in range(60)} == {"block"}
    assert {r.verdict for u, r in at.items() if "casino" not in u} == {"allow"}
    assert len({r.template for u, r in at.items() if "/by/" in u}) == 1
    assert len({r.template for u, r in at.items() if "/view/" in u}) == 1
    casino = at["http://s.com/casino/50.html"]
    assert (casino.n_bad, casino.n_good) == (30, 0) and casino.purity == 31 / 32
    assert at["http://t.com/a/1"].purity == 6 / 7


def test_urls_of_an_empty_table(spark):
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _h(*map(field, r))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = Counter()
    for s in order:
        for place, r in enumerate(by[s]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now, proof = leaf((*r[:4], r[4].translate(LOWER) if changed and r[4] is not None else r[4])), ""
            for levels, k in ((trees[s], place), (top, order.index(s))):
                for nodes in levels[:-1]:
                    a, b = "".join(nodes[k // 16 * 16 : k]), "".join(nodes[k + 1 : k // 16 * 16 + 16])
                    now, proof, k = _h(a, now, b), proof + a + b, k // 16
            out[(r[0], leaf(r), trees[s][-1][0], top[-1][0], _h(proof), now, now == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_manifest_equals_plain_python(spark, monkeypatch, join_by, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(k, "big", "en", k % 7, f"Text {k}") for k in range(5000 if block == 2 else 700)] + [(k, f"s{k}", None, None, None) for k in range(40)] + [(9000 + k, None, "x", 1, "é Ü A") for k in range(17)]
    rows += [(1, "s1", "en", 1, ""), (1, "s1", "en", 1, ""), (1, "s1", "en", 2, "B"), (None, "s2", None, None, "Q"), (None, None, None, None, None), (77777, "é", "en", 3, "X" * 100_000), (5, "", "en", 1, "C")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("idx", F.lit("a")).repartition(7)
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"])
    got = Counter(tuple(x) for x in out.drop("proof").collect())
    assert got == _plain_manifest(rows)
    assert any(not k[-1] for k in got) and any(k[-1] for k in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, docs.columns).drop("proof").collect()
    assert Counter(map(tuple, got)) == (_plain_manifest(rows) if n else Counter())
