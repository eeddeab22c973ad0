"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from intelweave.llm import chat, decontaminate, html_text, line_dedup, near_join, packing, quality, substring_dedup, token_counts, warc
from intelweave.llm.common import tokenizer_path
from intelweave.llm.transducer import BpeTransducer

WORDS = "the of and a quick brown fox jumps over lazy dogs while seven wizards brew potent elixirs near old stone bridges at dawn".split()


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def _docs(spark, texts):
    """documents with a null id, repeated rows and columns whose names clash with inner ones."""
    rows = [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(texts)] + [(None, "alone in here", "en", "s", 0, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string, n long")


@pytest.fixture(scope="module")
def texts(rng):
    def sentence(n):
        return " ".join(rng.choice(WORDS, n))

    base = [sentence(int(n)) for n in rng.integers(3, 120, 40)]
    near = [base[k] + " end" for k in range(0, 40, 4)]
    lines = ["\n".join(base[k : k + 3]) for k in range(0, 30, 5)]
    odd = [None, "", " \n\t ", "'s 'll <|endoftext|> it's", "日本語 テキスト é😀", "word " * 3000, "a" * 5000, "x\r\n\r\ny", base[0], base[0]]
    return base + near + lines + odd


def test_token_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in token_counts.count_tokens(_docs(spark, texts)).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(_docs(spark, []).limit(0)).count() == 0


def test_transducer_on_random_strings(rng):
    from tokenizers import Tokenizer

    lib, machine = Tokenizer.from_file(tokenizer_path()), BpeTransducer(tokenizer_path())
    letters = list("ab 's tre\n\tvl'dm1²½éß日́😀 .!# 　<|>")
    samples = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 500)]
    assert [x.tolist() for x in machine.id_texts(samples)] == [e.ids for e in lib.encode_batch(samples, add_special_tokens=False)]
    assert machine.count_texts(samples).tolist() == [len(x) for x in machine.id_texts(samples)]


def test_chat_reads_back(spark):
    tricky = ["\\### Assistant: </turn> ok", "<+>", "## \\\\ <</turn></turn>\n", "#####", None, "", "a:b", "\\"]
    rows = [(1, k, "user" if k < 3 else "assistant", t) for k, t in enumerate(tricky)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 5, "we:ird\\", "y"), (3, None, "assistant", "z")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select("conv_id", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {r.conv_id: r for r in got}
    assert [(t.role, t.text) for t in by[1].turns] == [("user" if k < 3 else "assistant", t or "") for k, t in enumerate(tricky)]
    assert by[1].loss == "".join(t or "" for t in tricky[3:])
    assert [(t.role, t.text) for t in by[2].turns] == [("", "x"), ("", "x")] and by[2].loss == ""
    assert [(t.role, t.text) for t in by[None].turns] == [("we:ird\\", "y")]
    formatted = {r.conv_id: r.formatted for r in out.collect()}
    assert formatted[1].count("### ") == 2  # adjacent turns of a role are one message


def test_quality_base(spark, texts):
    got = {r.doc_id: r for r in quality.verdict(quality.measure(_docs(spark, texts))).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit), failed)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert not (r.kept and failed)
    assert quality.verdict(quality.measure(_docs(spark, []).limit(0))).count() == 0
    kept = quality.good_rows(_docs(spark, texts))
    assert kept.columns == _docs(spark, texts).columns and kept.count() == sum(r.kept for r in got.values())


BANDS = {
    "en": {"lo": 2.16, "hi": 2.35, "slack": 3.0, "bytes": 0.05, "full": 1.13, "per_doubling": 0.05},
    "de": {"lo": 2.22, "hi": 2.36, "slack": 5.25, "bytes": 0.05, "full": 1.06, "per_doubling": 0.045},
    "fr": {"lo": 1.96, "hi": 2.10, "slack": 4.25, "bytes": 0.05, "full": 1.07, "per_doubling": 0.045},
    "es": {"lo": 1.93, "hi": 2.10, "slack": 3.5, "bytes": 0.05, "full": 1.12, "per_doubling": 0.05},
}
PROSE = [
    ("en", "The committee met on Thursday afternoon to discuss the repairs to the old bridge, which has been closed since the floods of last spring. Several residents complained that the detour adds twenty minutes to their journey to work, and a farmer explained that he can no longer move his cattle to the lower meadows. The engineer said that the foundations are sound but that two of the arches need to be rebuilt."),
    ("en", "If you leave the dough in a warm place for about two hours, it should double in size. Press it down gently, shape it into a loaf and let it rest again while the oven heats up. A bowl of water on the lowest shelf gives the crust a better colour. Bake it for forty minutes, then knock on the bottom: when it sounds hollow, the bread is done."),
    ("de", "Am frühen Morgen lag noch Nebel über dem See, und die ersten Fischer kehrten bereits mit ihren Booten zurück. Auf dem Marktplatz wurden die Stände aufgebaut, während der Bäcker die Türen öffnete und der Duft von frischem Brot durch die Gassen zog. Niemand ahnte, dass wenige Stunden später ein Gewitter die Straßen unter Wasser setzen und die Feuerwehr bis in die Nacht beschäftigen würde."),
    ("fr", "Depuis plusieurs années, les habitants du quartier demandent la création d'un jardin public à la place de l'ancienne usine. La mairie a enfin présenté un projet qui prévoit des arbres, une aire de jeux et un petit marché couvert. Les travaux devraient commencer au printemps prochain, mais certains voisins craignent le bruit et la poussière pendant toute la durée du chantier."),
    ("es", "Cuando llegamos al pueblo ya era de noche y apenas quedaba gente en la plaza. El dueño de la posada nos recibió con una sopa caliente y nos contó que el camino de la montaña estaba cortado por la nieve desde hacía una semana. Decidimos quedarnos dos días más, aprovechando para visitar la iglesia antigua y conversar con los pastores de la zona."),
]


def test_quality_keeps_plain_prose(spark):
    df = spark.createDataFrame([(k, t, x) for k, (lang, t) in enumerate(PROSE) for x in (lang, None)], "doc_id long, text string, lang string")
    assert [r.rejected_by for r in quality.verdict(quality.measure(df)).collect()] == [None] * 10
    assert quality.good_rows(df).count() == 10


def test_quality_bands_on_held_out_labels(spark):
    """Bands fitted to half of the labelled documents, judged by the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted, other = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    bands = quality.fit_bands(docs, fitted)
    assert set(bands) == {"en", "de", "fr", "es"}
    judged = quality.verdict(quality.measure(docs.join(other, "doc_id", "left_semi")), bands=bands).join(other, "doc_id").filter("not base_failed")
    kept = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1][1] > 1000 and kept[1][0] > 0.98 and kept[0][1] > 100 and kept[0][0] < 0.15, kept


def test_quality_bands_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    bands = quality.fit_bands(docs, labels)
    assert bands
    odd = spark.createDataFrame([(None, "x", "en"), (3, None, None), (None, None, None)], "doc_id long, text string, lang string")
    more = spark.createDataFrame([(None, 1), (10**9, 0), (10**9 + 1, None)], "doc_id long, quality long")
    twice = docs.union(docs.filter("doc_id != 3")).union(odd).withColumns({"__id": F.lit("x"), "quality": F.lit(7), "n_tokens": F.lit(None)})
    assert quality.fit_bands(twice, labels.union(labels).union(more)) == quality.fit_bands(docs.union(odd), labels) == quality.fit_bands(docs.repartition(13), labels.repartition(5))
    assert quality.fit_bands(docs, labels.limit(0)) == quality.fit_bands(docs.limit(0), labels) == quality.fit_bands(docs, labels, rows=quality.LEAST_GOOD - 1) == {}
    bad = quality.fit_bands(docs, labels.withColumn("quality", F.lit(0)).union(labels))  # labelled both ways: bad
    assert bad == {}
    renamed = docs.toDF("key", "body", "tongue")
    assert quality.fit_bands(renamed, labels.toDF("key", "mark"), id_col="key", text_col="body", lang_col="tongue", label_col="mark") == bands


def test_quality_verdict(spark, texts):
    """Measures and bands, word by word, for languages with a band, null and unknown ones, and other scripts."""
    import math

    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(quality.VOCABULARY))
    more = ["привет мир это обычный русский текст без особых примет и слов " * 3, "日本語の文章です。これはテストです。 " * 5, "𒀀𒀁 𒀂𒀃 " * 20, "|| ## $$ 12 %% && " * 9, "ZXQJ KVWQ PPLX QQZT " * 12, "1 2 3 4 5 6 7 8 9 10 11", "q z x # @ 7 ~ ^ " * 40, " ".join(WORDS * 4) + " 𒀀𒀁 𒀂𒀃 𒀄𒀅", *(" ".join(f"{w}{k}" for k, w in enumerate(WORDS * n)) for n in (1, 4))]
    rows = [(k, t, ("en", "de", "fr", "es", None, "xx")[k % 6]) for k, t in enumerate([*texts, *more])]
    rows += [(None, t, lang) for t in more for lang in ("en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.verdict(quality.measure(df), bands=BANDS).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.lang].append((r.script, r.n_tokens, round(r.byte_share, 9), round(r.entropy_share, 9), r.rejected_by, r.kept))
    want, rules = defaultdict(list), Counter()
    for k, t, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ids = [i for w in words for i in pieces.encode(w)]
        n = len(ids)
        counts = Counter(ids)
        most = math.log2(min(n, pieces.get_piece_size())) if n > 1 else 1
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / most if n > 1 else 1.0
        share = sum(pieces.is_byte(i) for i in ids) / n if n else 0.0
        chars = sum(map(len, words)) / n if n else 0.0
        kinds = [sum(x) for x in zip(*([c.isascii() and c.isalpha() or "\u00c0" <= c <= "\u027f", "\u0370" <= c <= "\u052f", False, False, "\u3000" <= c <= "\ud7ff", c > "\uffff"] for c in t or ""), strict=True)] or [0] * 6
        script = quality._SCRIPTS[kinds.index(max(kinds)) if max(kinds) else 5]
        band = BANDS.get(lang) or quality.SCRIPT_BANDS[script]
        slack = band["slack"] / math.sqrt(max(n, 1))
        checks = {"few_chars": chars < band["lo"] - slack, "many_chars": chars > band["hi"] + slack, "bytes": share > band["bytes"], "entropy": entropy < band["full"] - band["per_doubling"] * math.log2(max(n, 1))}
        rule = next((x for x, hit in checks.items() if hit), None)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        rules[rule] += 1
        want[k, lang].append((script, n, round(share, 9), round(entropy, 9) + 0.0, rule, not failed and rule is None))
    assert {k: sorted(map(str, v)) for k, v in by.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    assert {"few_chars", "many_chars", "bytes", "entropy"} <= set(rules)


def _shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, texts, rng):
    long = " ".join(rng.choice([f"w{k}" for k in range(400)], 300)).split()
    family = [" ".join(long[:k] + ["changed"] + long[k + 1 :]) for k in range(0, 300, 1)]
    every = texts + family
    sets = {k: _shingles(t) for k, t in enumerate(every)} | {None: _shingles("alone in here")}
    inverted, both = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            inverted[x].append(k)
    for owners in inverted.values():
        for i, a in enumerate(owners):
            for b in owners[i + 1 :]:
                both[a, b] += 1
    links, root = Counter(), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    docs = _docs(spark, every)
    got = {r.doc_id: r for r in near_join.near_duplicates(docs).collect()}
    assert {k: (got[k].n_links, got[k].class_id) for k in sets} == {k: (links[k], find(k)) for k in sets}
    one = near_join.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({find(k) for k in sets})
    assert near_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_chained_labels(spark, rng):
    """z ~ y ~ x are half alike and x ~ b is a link: y's label holds x alone, x's label holds b alone."""
    texts = []
    while len(texts) < 4 * 12:
        w = rng.integers(0, 1 << 40, (4, 300)).astype(str)
        z = w[0]
        y = np.concatenate([w[1][:85], z[85:]])
        x = np.concatenate([y[:215], w[2][215:]])
        b = np.concatenate([x[:140], w[3][140:164], x[164:]])
        chain = [" ".join(t) for t in (z, y, x, b)]
        ids = near_join._class_ids(*near_join.shingles(chain, near_join.WIDTH)).tolist()
        if ids == sorted(ids):
            texts += chain
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_join.near_duplicates(_docs(spark, texts).filter("doc_id is not null")).collect()}
    assert got == {k: (int(k % 4 > 1), k - (k % 4 == 3)) for k in range(len(texts))}


def _removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        g = np.cumsum(gone)[: len(t)] > 0
        starts = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(g.sum()), starts, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return out


def test_repeated_substrings(spark, rng):
    base = ["".join(rng.choice(["a", "b"], int(n))) for n in rng.integers(0, 60, 60)] + ["ab" * 40, "a" * 70, "a" * 30, "é" * 20, None, ""]
    base += [base[3], base[5] + "x" + base[7]]
    for length, gram in ((12, 4), (20, 5)):
        got = {r.doc_id: r for r in substring_dedup.drop_repeats(_docs(spark, base), length=length, gram=gram).collect()}
        want = _removed([(t or "").encode() for t in base] + [b"alone in here"], length)
        assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, hashlib.sha256(bytes(got[k].kept)).hexdigest()) for k in range(len(base))] == want[:-1]
    assert substring_dedup.drop_repeats(_docs(spark, base).limit(0)).count() == 0
    for r in substring_dedup.maximal_repeats(_docs(spark, base), length=12, gram=4).collect():
        strings = {(base[o.id] or "").encode()[o.start : o.start + r.n_bytes] for o in r.occurrences}
        assert len(strings) == 1 and len(r.occurrences) > 1


def test_passages_that_documents_share(spark, rng):
    """A passage of over 50 words in two documents is told, one of fewer words or of one document alone isn't."""
    words = lambda n: " ".join(rng.choice([f"word{k}" for k in range(5000)], n))
    long, short, own = words(60), words(30), words(60)
    texts = [f"{words(40)} {long} {words(40)}", f"{words(9)} {long} {words(90)}", f"{words(40)} {short} {words(40)}", f"{short} {words(50)}", f"{own} {words(20)} {own}", words(200), words(80)]
    texts += [texts[-1]]
    got = {r.doc_id: (r.n_passages, r.passage_words, r.n_removed > 0) for r in substring_dedup.drop_repeats(_docs(spark, texts)).collect()}
    assert [got[k][0] > 0 for k in range(8)] == [True, True, False, False, False, False, True, True]
    assert 51 <= got[0][1] <= 62 and got[6][1] == 80 and got[4][2] and not got[5][2]
    assert len({got[k][0] for k in (0, 1)}) == 1


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(rng):
    a = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 25, 400)]
    b = ["".join(x for x in t if rng.random() > 0.08) + "c" * int(rng.integers(0, 2)) for t in a]
    for edits in range(4):
        assert line_dedup.within(a, b, edits).tolist() == [_distance(x, y) <= edits for x, y in zip(a, b, strict=True)]
    # bands of several words, and too wide for words
    a = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(150, 420, 40)]
    b = ["".join(x for x in t if rng.random() > 0.15) + "c" * int(rng.integers(0, 30)) for t in a]
    far = [_distance(x, y) for x, y in zip(a, b, strict=True)]
    for edits in (25, 31, 40, 63, 64, 90, 100, 127, 128, 200):
        assert line_dedup.within(a, b, edits).tolist() == [d <= edits for d in far]
    assert line_dedup.within(a, b, np.array(far)).all() and not line_dedup.within(a, b, np.array(far) - 1).any()
    assert all(line_dedup._long_distance(x, y, d) == d and line_dedup._long_distance(x, y, d - 1) == d for x, y, d in zip(a, b, far, strict=True))


def test_line_dedup(spark, texts, rng):
    lines = [" ".join(rng.choice(WORDS, 12)) for _ in range(30)]
    edited = [x[:5] + "_" + x[6:] for x in lines[:15]] + [x[:-1] for x in lines[15:25]] + [x + "abc" for x in lines[25:]]
    every = texts + ["\n".join(lines), "\n".join(edited + ["short"]), "\n".join(lines[:3])]
    docs = _docs(spark, every).filter("doc_id is not null")
    seen, order = {}, []
    for k, t in enumerate(every):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 40 and x not in seen:
                seen[x] = (k, i)
                order.append(x)
    near = {x for k, x in enumerate(order) for y in order[:k] if abs(len(x) - len(y)) <= 2 and _distance(x, y) <= 2}
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    for k, t in enumerate(every):
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if len(x) < 40 or (seen[x] == (k, i) and x not in near))
        assert got[k].text == want
    assert near and line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_with_growing_edits(spark, rng):
    lines = [" ".join(rng.choice(WORDS, int(n))) for n in rng.integers(12, 220, 60)]
    edited = []
    for x in lines:
        y, k = list(x), max(2, len(x) // 20) - 1
        for at in sorted(rng.choice(len(x), k, replace=False).tolist(), reverse=True):
            y[at : at + 1] = ["", "#", y[at] + "#"][int(rng.integers(0, 3))]
        edited.append("".join(y))
    far = ["".join("#" if k % 12 == 0 else c for k, c in enumerate(x)) for x in lines]
    near = lambda a, b: _distance(a, b) <= max(2, min(len(a), len(b)) // 20)
    assert max(len(x) // 20 for x in lines) > 31
    docs = _docs(spark, ["\n".join(lines), "\n".join(edited), "\n".join(far)]).filter("doc_id is not null")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_repeated_lines(docs, share=line_dedup.SHARE).collect()}
    assert got[0] == lines
    # edits scattered evenly, as many as are allowed, are the worst case: nothing that stays far goes, and nearly all that is near
    for k, wanted in ((1, [y for x, y in zip(lines, edited, strict=True) if not near(x, y)]), (2, [z for x, y, z in zip(lines, edited, far, strict=True) if not near(x, z) and not near(y, z)])):
        assert set(wanted) <= set(got[k]) and len(set(got[k]) - set(wanted) - {""}) <= 0.05 * len(lines)


def test_line_dedup_loses_no_pair_within_the_sure_edits(spark, rng):
    lines = [" ".join(rng.choice([f"w{k}" for k in range(500)], int(n))) for n in rng.integers(12, 220, 80)]
    edited = []
    for x in lines:
        y, k = list(x), max(2, (len(x) - line_dedup.RUN) // (line_dedup.RUN + 1))
        for at in [int((i + 0.5) * len(x) / k) for i in range(k)]:  # as evenly as can be
            y[at] = "#"
        edited.append("".join(y))
    docs = _docs(spark, ["\n".join(lines), "\n".join(edited)]).filter("doc_id is not null")
    got = {r.doc_id: (r.n_equal, r.n_near) for r in line_dedup.drop_repeated_lines(docs, share=line_dedup.SHARE).collect()}
    assert got == {0: (0, 0), 1: (0, len(lines))}


def test_line_dedup_finds_all_pairs_within_the_share(spark, rng):
    """As many edits as are allowed, as evenly as can be, and one more; lines of 20 to 39 characters may have one, with and without blanks."""
    lines = [(" " if k % 3 else "").join(rng.choice([f"w{n}" for n in range(500)], 200))[: int(n)] for k, n in enumerate([*range(20, 70), *rng.integers(70, 900, 50)])]

    def edited(x, n):
        y = list(x)
        for at in [int((i + 0.5) * len(x) / n) for i in range(n)]:
            y[at] = "#"
        return "".join(y)

    near, far = [edited(x, len(x) // 20) for x in lines], [edited(x, len(x) // 20 + 1).replace("#", "~") for x in lines]
    docs = _docs(spark, ["\n".join(lines), "\n".join(near), "\n".join(far), "a line of nineteen.\na line of nineteen!"]).filter("doc_id is not null")
    got = {r.doc_id: (r.equal_lines, r.near_lines) for r in line_dedup.repeated_lines(docs, share=line_dedup.SHARE, short_words=1).collect()}
    assert sorted(got[1][1]) == list(range(len(lines))) and got[0] == got[2] == got[3] == ([], [])


def test_line_dedup_of_a_large_group(spark, rng, monkeypatch):
    """Groups larger than GROUP are dealt out as pairs of chunks; columns with the names of results stay in texts_left."""
    monkeypatch.setattr(line_dedup, "GROUP", 8)
    common = "this very common beginning of many lines stands in all of them, and then comes something else: "
    lines = [common + "".join(rng.choice(list("abcdefghij"), 40)) for _ in range(60)]
    near = [x[:-1] + "#" for x in lines[:30]]
    docs = _docs(spark, [*lines, *near]).filter("doc_id is not null").withColumn("near_lines", F.lit("mine")).withColumn("n_equal", F.lit("mine"))
    got = {r.doc_id: r.n_near for r in line_dedup.drop_repeated_lines(docs.drop("near_lines"), share=line_dedup.SHARE).collect()}
    want = {}
    for k, x in enumerate([*lines, *near]):
        want[k] = int(any(_distance(x, y) <= min(len(x), len(y)) // 20 for y in [*lines, *near][:k]))
    assert got == want and sum(want.values()) >= 30
    left = line_dedup.texts_left(docs).collect()
    assert left[0].near_lines == left[0].n_equal == "mine" and len(left) == 90 - sum(want.values())


def test_line_dedup_of_short_lines(spark):
    short = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    docs = _docs(spark, ["\n".join([*short, "}", "one two three", ""]), "\n".join([short[1], "}", "one two three", "", "Released under the MIT Licence."]), None])
    got = {r.doc_id: (r.text, r.n_equal, r.n_near) for r in line_dedup.drop_repeated_lines(docs.filter("doc_id is not null"), short_words=line_dedup.SHORT_WORDS).collect()}
    assert got[0][1:] == (0, 0) and got[1] == ("\nReleased under the MIT Licence.", 3, 0) and got[2] == (None, 0, 0)
    assert line_dedup.drop_repeated_lines(docs.limit(0), share=line_dedup.SHARE, short_words=1).count() == 0


def test_decontamination(spark, texts, monkeypatch):
    items = spark.createDataFrame([(1, texts[1]), (2, texts[1]), (10, "Jumps, OVER lazy"), (3, None), (4, ""), (5, texts[5])], "item_id long, text string")
    docs = _docs(spark, [*texts, "so it " + (texts[1] or "").upper() + " there"])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for r in items.collect():
        w = split(r.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else []:
            windows[tuple(w[i : i + n])].add(r.item_id)

    def check():
        got = {r.doc_id: r for r in decontaminate.judged(decontaminate.find_hits(docs, items)).collect()}
        for r in docs.collect():
            w, hit, ids = split(r.text), set(), set()
            for g, own in windows.items():
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        ids |= own
            x = got[r.doc_id]
            assert (x.n_words, x.n_hit, set(x["items"]), x.contaminated) == (len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w))

    check()
    monkeypatch.setattr(decontaminate, "SET_SIZE", 0)
    check()
    assert decontaminate.remove_documents(docs, items.limit(0)).count() == docs.count()
    twice = docs.union(docs).withColumn("row", F.lit("mine"))
    assert decontaminate.find_hits(twice, items).count() == twice.count() == 2 * docs.count()
    assert decontaminate.find_hits(docs.limit(0), items).count() == decontaminate.remove_spans(docs.limit(0), items).count() == 0
    left = decontaminate.remove_documents(twice, items)
    assert left.columns == twice.columns and left.count() == 2 * decontaminate.remove_documents(docs, items).count() < twice.count()


def test_open_windows_hold_no_whole_document():
    packer = packing.Packer(1024, 0)
    for k in range(50):
        packer.add(k, np.arange(200_000, dtype=np.uint32))
        packer.rows.clear()
    assert packer.held and all(len(ids.base if ids.base is not None else ids) <= 1024 for pieces in packer.held.values() for _, _, ids, _ in pieces)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    ids = {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in [*enumerate(texts), (None, "alone in here")]}
    rows = packing.pack(_docs(spark, texts).coalesce(2)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(bytes(r.ids)) >= 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, whole in [*((pieces[k], len(ids[k])) for k in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 2


def test_html(spark):
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav>{body}<footer>foot &copy;</footer></body></html>"
    art = "<article><h1>Head&nbsp;line</h1><p>One <b>two<br>three &amp; 4<aside>side</aside><div class='ad'>buy<div>x</div></div><form>f</form><p>five</p></article><section id=comments>c</section>"
    rows = [(1, "http://h.org/a/1", page(art)), (2, "http://h.org/a/2", page("<p>Shared line</p><p>Only here</p>")), (3, "http://h.org/a/3?x=1", page("<p>Shared line</p><p>Other text</p>")), (4, None, None), (5, "odd", ""), (1, "http://h.org/a/1", page(art))]
    got = defaultdict(list)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert got[1] == [("Head line One two three & 4 five", 32)] * 2
    assert got[3][0][0] == "Other text" and got[2][0][0] in ("Only here", "Shared line Only here")
    assert got[4] == got[5] == [("", 0)]
    rows = [(k, f"http://copy.org/{k}", page("<article><p>same words</p></article>")) for k in range(3)]
    copies = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.text, r.n_shared, r.n_marked) for r in copies} == {("same words", 3, 0)}  # title, menu and foot go by differencing


def _brute_text(rows):
    """Pairing by a plain sort of each host's paths, and lines deleted by an alignment of whole texts."""
    import difflib

    split = lambda u: re.match(r"^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?", u).groups("")
    by = defaultdict(dict)
    for i, u, h in sorted(rows):
        host, path, q = split(u)
        by[host].setdefault(re.sub(r"(/|\.html?)$", "", path) + q, [x[0] for x in html_text.lines_of(h)])
    out = {}
    for i, u, h in rows:
        host, path, q = split(u)
        path = re.sub(r"(/|\.html?)$", "", path) + q
        paths = sorted(by[host])
        k = paths.index(path)
        near = [(html_text._alike(path, paths[j]), -(j > k), j) for j in (k - 1, k + 1) if 0 <= j < len(paths)]
        own = [x[0] for x in html_text.lines_of(h)]
        gone = set()
        if near:
            for m in difflib.SequenceMatcher(None, own, by[host][paths[max(near)[2]]], False).get_matching_blocks():
                gone |= set(range(m.a, m.a + m.size))
        out[i] = " ".join(x for j, x in enumerate(own) if j not in gone)
    return out


def test_html_pairing_does_not_depend_on_partitions(spark):
    page = lambda k: f"<p>Site menu</p><p>Story {k}</p><p>Part {k % 3}</p><p>Site foot</p>"
    rows = [(k, "http://many.org/a", page(0)) for k in range(7)] + [(7, "http://many.org/b", page(7))] + [(k, f"http://query.org/show?id={k}", page(k)) for k in range(8, 12)]
    rows += [(k, f"http://deep.org/x{k % 4}/y{k}.html", page(k)) for k in range(12, 60)]
    want = _brute_text(rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
            assert {r.page_id: r.text for r in got} == want and all(r.n_shared + len(r.text.split("Story")) - 1 >= 1 for r in got)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_lines(rng):
    def lcs(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    for _ in range(60):
        a, b = (list(rng.choice(list("abcde"), int(rng.integers(0, 12)))) for _ in range(2))
        places = sorted(html_text.shared_lines(a, b))
        rest = iter(b)
        assert len(places) == lcs(a, b) and all(a[k] in rest for k in places)
    long = [f"line {k}" for k in range(20_000)]
    assert len(html_text.shared_lines([x for k, x in enumerate(long) if k % 3], [x for k, x in enumerate(long) if k % 2])) == sum(k % 3 > 0 and k % 2 > 0 for k in range(20_000))


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h.org/a b", "<p>One</p><p>é</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    made = warc.derivatives(source)
    warc.write_warc(source.select("record").union(made.select("record")), f"{tmp_path}/w")
    back = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len(back) == 9 and all(r.intact for r in back)
    ids = {r.headers["warc-record-id"] for r in back if r.headers["warc-type"] == "response"}
    for r in back:
        assert r.headers["warc-block-digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        if r.headers["warc-type"] != "response":
            assert r.headers["warc-refers-to"] in ids
    assert {r.block for r in back if r.headers["warc-type"] == "conversion"} == {"One\né", ""}
    assert any("http-header-Content-Type: text/html" in r.block for r in back if r.headers["warc-type"] == "metadata")


def test_warc_reads_by_length(spark, tmp_path):
    import gzip

    mark = "\r\n\r\nWARC/1.1\r\n"
    record = lambda block, length=None, name="n": f"WARC/1.1\r\nWARC-Type: resource\r\nX-Name: {name}\r\nContent-Length: {len(block.encode()) if length is None else length}\r\n\r\n{block}\r\n\r\n"
    held = ["plain", f"a{mark}b", f"{mark}", f"Content-Length: 3\r\n\r\nabc{mark}WARC-Type: x\r\nContent-Length: 1\r\n\r\nz", "", "é" * 40_000 + mark * 3, "ends\r\n\r\n", "\r\n\r\n"]
    for k, name in enumerate(("a.warc", "b.warc.gz")):
        data = [record(x, name=f"{k}").encode() for x in held]
        with open(tmp_path / name, "wb") as f:  # gzip: a member for each record
            f.write(b"".join(gzip.compress(x) for x in data) if k else b"".join(data))
    (tmp_path / "c.warc").write_bytes((record("good") + record("short", 9) + record("long", 2) + record("after") + record("cut", 10**6)).encode() + record("x").encode().replace(b"x", b"\xff"))
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"WARC/1.1\r\nX-Name: e\r\n\r\nno length\r\n\r\n")
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = warc.read_warc(spark, str(tmp_path)).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.headers.get("x-name")].append((r.block, r.intact))
        assert by["0"] == by["1"] == [(x, True) for x in held]
        assert by["n"] == [("good", True), ("short", False), ("long", False), ("after", True), ("cut", False), ("\ufffd", True)]
        assert by["e"] == [("no length", False)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_remove_spans_keeps_the_rest(spark):
    item = [f"w{k}" for k in range(13)]
    passage = ", ".join(item).upper()
    texts = [f"First: keep THIS! {passage}. And, that too...", f"{passage}", f"no Hit -- here\n", None, "", f"({passage}) ({passage})", f"x {passage}\n", f"Ünï {' '.join(item)} Ende"]
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hit string").withColumnRenamed("__hit", "item")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    got = defaultdict(list)
    for r in decontaminate.remove_spans(docs, items).collect():
        got[r.doc_id].append((r.text, r.item))
    assert sorted(got[0]) == [("First: keep THIS! . And, that too...", x) for x in ("again", "extra")]
    assert got[None] == [("First: keep THIS! . And, that too...", None)]
    want = {1: "", 2: texts[2], 3: None, 4: "", 5: "()", 6: "x \n", 7: "Ünï  Ende"}
    assert {k: [t for t, _ in got[k]] for k in want} == {k: [t] for k, t in want.items()}
