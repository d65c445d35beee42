"""Language ID, toxicity, fingerprints, chat and urls."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, fingerprints, langid, queries, toxicity, urls
from tabulon.llm.common import crc_of_id


def test_kneser_ney_by_hand():
    """Probabilities sum to one over the seen symbols and the rest, and follow the definition."""
    keys = langid.grams(["abab abba cab", "abc abd", "aabb"])[0]
    values, counts = np.unique(keys, return_counts=True)
    model = langid.Model(values, counts)
    grams = {int(k): int(c) for k, c in zip(values, counts)}
    tables = {4: grams}
    for order in (3, 2, 1):
        table = {}
        for k in tables[order + 1]:
            low = k & ((1 << 16 * order) - 1)
            table[low] = table.get(low, 0) + 1
        tables[order] = table

    def p(order, k):
        if not order:
            return 1 / 1024
        k &= (1 << 16 * order) - 1
        t = tables[order]
        once, twice = (sum(c == n for c in t.values()) for n in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {g: c for g, c in t.items() if g >> 16 == k >> 16}
        if not same:
            return p(order - 1, k)
        total = sum(same.values())
        return max(same.get(k, 0) - d, 0) / total + d * len(same) / total * p(order - 1, k)

    probe = np.concatenate([values, values ^ np.uint64(3), values ^ np.uint64(5 << 16)])
    assert model.log(probe) == pytest.approx([math.log(p(4, int(k))) for k in probe], rel=1e-4)


def test_language_of_held_out_rows(corpus, odd, empty):
    held = crc_of_id() % 4 == 2
    model = langid.train(corpus.filter(~held))
    rows = langid.identify(corpus, model, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert not any(r.rejected for r in rows)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert sorted(r.doc_id for r in got if r.lang_pred == "und" and r.doc_id) == [3, 4, 5, 7]
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}
    assert set(langid.identify(odd, model, keep=odd.columns).columns) == {*odd.columns, "lang_pred", "score", "cross_entropy", "rejected"}


def test_models_keep_all_grams(spark):
    """More distinct 4-grams than the 131,072 that models once kept: every one counts, and so do the statistics of lower orders."""
    rng = np.random.default_rng(3)
    letters = np.array([chr(c) for c in range(0x4E00, 0x4E00 + 400)])
    texts = ["".join(letters[rng.integers(0, 400, 2500)]) + "." for _ in range(80)]
    values, counts = np.unique(langid.grams(texts)[0], return_counts=True)
    assert len(values) > 1 << 17
    got = langid.train(spark.createDataFrame([(t, "zz") for t in texts] + [("the fox", "en")], "text string, lang string"))
    assert got.langs == ["en", "zz"]
    want = langid.Model(values, counts)
    for a, b in zip(got.models["zz"].grams + got.models["zz"].backoff, want.grams + want.backoff):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_limits_from_all_rows(spark):
    """A rare language of short texts has a limit in a large table too, and copies of a text count once."""
    rng = np.random.default_rng(5)
    words = ["the", "ring", "wood", "light", "house", "river", "stone", "walk", "and", "thing"]
    texts = {"en": [" ".join(rng.choice(words, rng.integers(3, 60))) + "." for _ in range(400)], "zz": ["qax vuq xaq.", "vuq qax.", "xaq xaq vuq."]}
    rows = [(t, x) for x, ts in texts.items() for t in ts] + [(texts["en"][0], "en")] * 3000 + [("12 3", "en"), ("", "zz")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert sorted(model.limits) == ["en", "zz"]
    for i, lang in enumerate(model.langs):
        middle, high = np.percentile(model.entropies(sorted(set(texts[lang])))[0][:, i], [50, 90])
        assert model.limits[lang] == pytest.approx((middle, max((high - middle) / 1.28, 0.02)), abs=2 / langid.BINS)


def test_cache_collisions():
    class Small(langid.Identifier):
        SLOTS = 8

    texts = ["the quick brown fox", "der schnelle fuchs", "", "123"]
    models = {}
    for lang, text in (("a", texts[0]), ("b", texts[1])):
        values, counts = np.unique(langid.grams([text])[0], return_counts=True)
        models[lang] = langid.Model(values, counts)
    a, b = Small(models, {}).entropies(texts)[0], langid.Identifier(models, {}).entropies(texts)[0]
    assert a == pytest.approx(b)


def test_letters_of_all_planes():
    """Every letter of Unicode is one, and lower and upper case share a symbol."""
    symbols = langid._symbols()
    letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    assert np.array_equal(symbols > 0, letters)
    assert symbols[ord("A")] == symbols[ord("a")] and symbols[0x10400] == symbols[0x10428]
    values, counts = np.unique(langid.grams(["the fox"])[0], return_counts=True)
    found = langid.Identifier({"en": langid.Model(values, counts)}, {}).identify(["\U00030000" * 10, "123"])
    assert [r[0] for r in found] == ["en", "und"] and found[0][1] > 0


def labels_of(corpus):
    return corpus.select("doc_id", F.col("text").contains("idiot").cast("int").alias("toxic"))


def test_toxicity(corpus, odd, empty):
    labels = labels_of(corpus)
    scorer = toxicity.train(corpus, labels.filter(crc_of_id() % 3 != 1))
    rows = toxicity.score(corpus, scorer).join(labels, "doc_id").collect()
    assert all((r.score >= queries.TOXIC) == bool(r.toxic) for r in rows)
    got = toxicity.score(odd, scorer, keep=odd.columns)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert len({r.score for r in got.filter("text is null or btrim(text) = ''").collect()}) == 1
    assert toxicity.score(empty, scorer).count() == 0
    plain = toxicity.train(empty, labels)
    assert plain.score("what a stupid worthless idiot") > 0.7 > plain.score("a fine day")
    again = toxicity.train(corpus, labels.filter(crc_of_id() % 3 != 1))
    assert again.weights == scorer.weights


def test_unlabelled_documents_count(spark, corpus, monkeypatch):
    """Documents without a label get a posterior from the voters and train the classifier; samples are bounded whatever the ids."""
    labels = labels_of(corpus).filter("doc_id % 5 = 0")
    seen = []
    fit = toxicity.LabelModel.fit.__func__
    monkeypatch.setattr(toxicity.LabelModel, "fit", classmethod(lambda cls, votes, start, *a: seen.append(start) or fit(cls, votes, start, *a)))
    scorer = toxicity.train(corpus, labels, unlabelled=50)
    known = labels.count()
    assert len(seen[0]) == known + 50 and len({float(x) for x in seen[0]}) == 3
    rows = toxicity.score(corpus, scorer).join(labels_of(corpus), "doc_id").collect()
    assert sum((r.score >= queries.TOXIC) == bool(r.toxic) for r in rows) >= 0.99 * len(rows)
    hot = corpus.unionByName(corpus.withColumn("doc_id", F.lit(0).cast("bigint")))
    toxicity.train(hot, labels, sample=30, unlabelled=20)
    assert len(seen[-1]) == 50


def test_label_model_shares_weight_of_copies():
    rng = np.random.default_rng(1)
    y = rng.random(800) < 0.3
    votes = np.stack([(rng.random(800) < np.where(y, 0.7, 0.02)).astype(float) for _ in range(3)], axis=1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    model = toxicity.LabelModel.fit(votes, np.where(y, 0.9, 0.1))
    assert model.correlations[0, 3] > 0.9 > 0.3 > abs(model.correlations[1, 2])
    assert model.weight[0] < 0.5 < model.weight[1]
    assert model.rates[1][1] == pytest.approx(0.7, abs=0.1)


def test_syncmers_are_context_free(spark):
    rows = [(1, "a b c d e f g h i j k l"), (2, "z a b c d e f g h i j k l"), (3, "x y"), (4, "")]
    got = {r.doc_id: r for r in fingerprints.anchors(spark.createDataFrame(rows, "doc_id int, text string"), F.col("text"), "a").collect()}
    first = {a.hash for a in got[1].a}
    assert first <= {a.hash for a in got[2].a}
    shift = {a.hash: a["at"] for a in got[2].a}
    assert all(shift[a.hash] == a["at"] + 1 for a in got[1].a)
    assert len(got[3].a) == 1 and not got[4].a


def test_units_at_every_offset(spark):
    texts = ["ab cd", "abcdefgh abcdefghi", "x" * 7 + "\U0001f600\U0001f601yz", "  a\tb\u3000c \U0001f600 ", "", " "]
    got = [r.u for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints._units(F.col("t")).alias("u")).orderBy("i").collect()]
    n = fingerprints.UNIT
    assert got == [[r[i : i + n] for r in re.findall(r"\S+", t, re.ASCII) for i in range(max(1, len(r) - n + 1))] for t in texts]


def test_insertion_in_unspaced_text(spark):
    rng = np.random.default_rng(11)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 3000))
    rows = [("same", text), ("front", "x" + text), ("middle", text[:1500] + "x" + text[1500:]), ("passage", "y" * 13 + text[1001:])]
    df = spark.createDataFrame(rows, "name string, t string")
    got = {r.name: {a.hash for a in r.a} for r in fingerprints.anchors(df, F.col("t"), "a").collect()}
    assert got["same"] <= got["front"]
    assert len(got["same"] & got["middle"]) > 0.98 * len(got["same"])
    assert len(got["same"] & got["passage"]) > 0.6 * len(got["same"])
    found = fingerprints.anchors(df, F.col("t"), "s")
    both = found.crossJoin(found.filter("name = 'same'").select(F.col("s").alias("o")))
    near = {r.name: r for r in both.select("name", fingerprints.likeness(F.array_distinct("s.hash"), F.array_distinct("o.hash")).alias("near"), fingerprints.placed(F.col("s"), F.col("o")).alias("placed")).collect()}
    assert near["front"].near > 0.95 and near["middle"].near > 0.95 and near["passage"].near > 0.4
    assert near["same"].near == 1 and near["front"].placed == 0 and 0.4 < near["middle"].placed / len(got["same"]) < 0.6


def test_fingerprints(spark, odd, empty, corpus):
    for df in (odd, corpus):
        rows = df.collect()
        got = fingerprints.compare(df).collect()
        assert len(got) == len(rows)
        ids = sorted({r.doc_id for r in rows if r.doc_id is not None}, reverse=True)
        texts = {r.doc_id: r.text or "" for r in rows}
        after = dict(zip(ids, ids[1:] + ids[:1]))
        for g in got:
            if g.doc_id is None or g.doc_id in (9, 8):  # 8 is there twice
                continue
            t = texts[g.doc_id]
            k = len(t) // 3
            assert g.edited_sha256 == hashlib.sha256((t[: len(t) - k] + texts[after[g.doc_id]][:k]).encode()).hexdigest()
            assert g.n_chars == len(t) and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        same = {}
        for g, t in ((g, texts.get(g.doc_id)) for g in got if g.doc_id is not None):
            assert same.setdefault(t, g.fingerprint) == g.fingerprint
    assert fingerprints.compare(empty).count() == 0
    near = [g for g in fingerprints.compare(corpus).collect() if g.n_chars > 200]
    assert sum(g.near_edited for g in near) / len(near) > 0.35


def brute_anchors(text, hashed):
    """Anchors (place, key) of a text by the definition; ``hashed`` gives the 64-bit hash of units and of pairs."""
    n, k = fingerprints.UNIT, fingerprints.K
    units = [r[i : i + n] for r in re.findall(r"\S+", text, re.ASCII) for i in range(max(1, len(r) - n + 1))]
    h = [hashed[u] for u in units]
    if len(h) < k:
        return {(1, tuple(h))} if h else set()
    out = set()
    for i in range(len(h) - k + 1):
        p = [hashed[a, b] for a, b in zip(h[i:], h[i + 1 : i + k])]
        if min(p) in (p[0], p[-1]):
            out.add((i + 1, (p[0], p[-1])))
    return out


def test_fingerprints_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["ring", "wood", "a", "unbelievably", "x", "日本語の文章です", "zz"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(24)]
    texts += [texts[3], texts[4] + " ring", "ring wood a x", "x", "", " "]
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    after = {i: texts[i - 1] for i in range(len(texts))}
    edited = {i: t[: len(t) - len(t) // 3] + after[i][: len(t) // 3] for i, t in enumerate(texts)}
    n = fingerprints.UNIT
    units = sorted({r[i : i + n] for t in [*texts, *edited.values()] for r in re.findall(r"\S+", t, re.ASCII) for i in range(max(1, len(r) - n + 1))})
    hashed = {r.u: r.h for r in spark.createDataFrame([(u,) for u in units], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    pairs = [(hashed[a], hashed[b]) for a in units for b in units]
    hashed |= {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for r in fingerprints.compare(df).collect():
        i = r.doc_id // 2
        own, changed, other = (brute_anchors(t, hashed) for t in (texts[i], edited[i], after[i]))
        near = lambda a, b: len({k for _, k in a} & {k for _, k in b}) / len({k for _, k in a} | {k for _, k in b}) if a or b else 1.0
        assert r.near_edited == pytest.approx(near(own, changed)) and r.near_next == pytest.approx(near(own, other)), i
        assert (r.placed_edited, r.placed_next) == (len(own & changed), len(own & other))
        assert len(r.fingerprint) == 16 * min(fingerprints.MOST, len({k for _, k in own}))


def test_anchors_are_taken_over(spark):
    """A text's anchors are found once and handed to the row before, and the edited text's are those of its parts; equal to those found in whole texts."""
    rng = np.random.default_rng(4)
    parts = ["a", "bc", " ", "  ", "\n", "\u3000", "unbelievably", "日本語の文章です", "\U0001f600", "x" * 9, "y" * 40, "z y x "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(60)] + ["x" * 50, " " * 9, "a b c", "a b c d", "abcdefgh" * 3 + " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = fingerprints.compare(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(own" in plan and "regexp_extract_all(_next" not in plan
    edited = [t[: len(t) - len(t) // 3] + texts[i - 1][: len(t) // 3] for i, t in enumerate(texts)]
    whole = spark.createDataFrame([(i, t, edited[i], texts[i - 1]) for i, t in enumerate(texts)], "i bigint, t string, e string, o string")
    for c in "teo":
        whole = fingerprints.anchors(whole, F.col(c), f"a_{c}")
    t, e, o = (F.array_distinct(F.col(f"a_{c}")["hash"]) for c in "teo")
    want = whole.select("i", *(fingerprints.written(fingerprints.sketch(x)).alias(n) for x, n in ((t, "own"), (e, "changed"))), fingerprints.likeness(t, e), fingerprints.likeness(t, o), fingerprints.placed(F.col("a_t"), F.col("a_e")), fingerprints.placed(F.col("a_t"), F.col("a_o"))).orderBy("i").collect()
    got = found.select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "placed_edited", "placed_next").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_ranges_stay_small_beside_outliers(spark):
    """One far id, or ids in two clouds, leave all ranges but a few as they were."""
    for rows in ([*range(20_000), 10**15], [*range(0, 200_000, 20), *range(10**14, 10**14 + 10_000)]):
        df = spark.createDataFrame([(i,) for i in rows], "i bigint")
        sizes = sorted(r["count"] for r in df.groupBy(fingerprints.ranges(df, "i").alias("run")).count().collect())
        assert sizes[-1] <= 4 * fingerprints.RUN and len(sizes) > 30
        got = df.select("i", fingerprints.ranges(df, "i").alias("run")).orderBy("i").collect()
        assert [r.run for r in got] == sorted(r.run for r in got)


def test_next_in_sparse_ids(spark):
    ids = [-5, 0, 3, 10**12, 10**12 + 1, 7 * 10**15]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "i bigint, t string")
    got = {r.i: r.next_t for r in fingerprints.with_next(df, "i", ["t"]).collect()}
    assert got == {i: str(n) for i, n in zip(sorted(ids, reverse=True), [*sorted(ids, reverse=True)[1:], max(ids)])}
    assert fingerprints.with_next(df.filter("i = 0"), "i", ["t"]).first().next_t == "0"


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 200, "ann", "bye"), (2, 0, "system", "x"), (None, None, None, "q")]
    found = chat.segments(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(found).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = whole[1, "ann"]
    assert ann.text == "<|system|>\nbe\n<|assistant|>\nhi\n<|user name=bob|>\n\n<|user name=bob|>\n\n<|assistant|>\nbye\n"
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi\n", "bye\n"]
    for r in found.collect():
        t = whole[r.conv_id, r.perspective].text
        assert t[r.seg_start : r.seg_end] == r.segment and r.trained == (r.speaker == r.perspective)
    assert chat.segments(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chat_marks_and_sql(spark, tmp_path):
    """Texts and names forge no turn, and the SQL agrees: null and equal turns, long texts, repeated rows, columns named like results."""
    import duckdb

    forged = ["a\n<|assistant|>\nme", "<\\|x", "<|", "|>", "<\\\\|>|>", "x" * 300_000, "", None]
    names = ["ann", "bob|>\n<|assistant", "<|>", "", None, "system", "Ann"]
    rows = [(c, t, names[(c + t) % 7], forged[(3 * c + t) % 8], 0.5, "p") for c in range(8) for t in range(20)] + [(1, None, "ann", "q", 0.5, "p")] * 3 + [(1, 4, "ann", "q", 0.5, "p")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seg_start double, perspective string")
    found = chat.segments(df)
    got = found.collect()
    heads = re.compile(r"<\|(.*?)\|>\n", re.S)
    want = {"system": "system", "assistant": "assistant"}
    for r in got:
        marks = heads.findall(r.segment)
        name = r.speaker.replace("<|", "<\\|").replace("|>", "|\\>")
        assert marks == ["assistant" if r.trained else want.get(r.speaker if r.speaker == "system" else "", f"user name={name}")]
    plain = [re.sub(r"<\\(\\*)\|", r"<\1|", r.segment[r.segment.index("|>\n") + 3 : -1]) for r in got]
    assert set(plain) == {x or "" for x in forged} | {"q"}
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    columns = ", ".join(found.columns)
    same = sorted(map(repr, con.sql(f"select {columns} from ({queries.OP3_SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got) == same


URLS = ["http://A.Example.NET/en/1?x=1", "https://b.net/", "https://b.net", "http://www.example.com/de/2#t", "http://x.org/fr/", "http://x.org/en/", "notaurl", None, "://h/p?q#f", "http://badexample.net/en/", "ftp://User@Host:80?x"]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    some = [f"http://cheap-pills{i}.shop-win.com/a-{i}/b?x=1&y=2" for i in range(40)] + [f"http://site{chr(97 + i % 26)}.org/p/{i}.html" for i in range(60)]
    trees = urls.train(urls.seed_labels(spark.createDataFrame([(u,) for u in some], "url string")))
    got = {r.page_id: r for r in urls.judge(df, trees, queries.RULES).collect()}
    want = ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None, "net/", None]
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path) == parts(u), u
        assert got[i].rule == want[i], u
    assert [got[i].verdict for i in (0, 1, 3, 4, 9)] == ["allow", "block", "block", "allow", "block"]
    held = spark.createDataFrame([(0, "http://cheap-casino99.best-win.com/a-7/b?x=1&y=2"), (1, "http://sitex.org/p/7.html")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urls.judge(held, trees, []).collect()} == {0: "block", 1: "allow"}
    assert set(trees.rates) == {"host", "file"} and all(len(r) == urls.BUCKETS for r in trees.rates.values())
    odd = spark.createDataFrame([(0, "http://a.org/" + "p/" * 40_000 + "?x=1"), (1, "http://a.org/"), (2, "http://a.org/"), (None, "http://a.org/"), (5, ""), (6, None)], "page_id bigint, url string")
    odd = odd.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "score", "_host", "_url", "label")})
    rows = urls.judge(odd, trees, queries.RULES).collect()
    assert len(rows) == 6 and len({(r.verdict, r.score) for r in rows if r.path == "/"}) == 1
    none = urls.train(urls.seed_labels(df.filter(F.lit(False))))
    assert {r.verdict for r in urls.judge(df, none, []).collect()} == {"allow"}
    assert urls.judge(df.filter(F.lit(False)), trees, queries.RULES).count() == 0
    assert zlib.crc32(b"1") == df.select(crc_of_id("page_id")).collect()[1][0]


def test_classifier_reaches_its_minimum():
    r = np.random.default_rng(1)
    x = r.random((5000, 40)) < 0.1
    target = np.clip(0.2 * r.random(5000) + 0.6 * x[:, 0], 0, 1)
    rows = [np.flatnonzero(v).astype(np.uint16) for v in x]
    w, b = toxicity._logistic(rows, target, 40, np.zeros(40), np.full(40, 3.0))
    rest = 1 / (1 + np.exp(-(x @ w + b))) - target
    assert np.abs(x.T @ rest + 3 * w).max() < 1e-3 and abs(rest.sum()) < 1e-2
    turn = r.permutation(5000)  # the order of rows changes sums by rounding only
    again, _ = toxicity._logistic([rows[i] for i in turn], target[turn], 40, np.zeros(40), np.full(40, 3.0))
    assert np.abs(w - again).max() < 1e-6
