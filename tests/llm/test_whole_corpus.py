"""Jaccard join, mixing, sharding, the graph, and the pipeline, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import graph, jaccard, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, percent):
    sets, parent = defaultdict(set), {}
    for i, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] |= {tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def generated(seed, n, base_words, edits):
    """Texts of many sizes with chains of edited copies around the threshold, and a passage that most share."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = []
    for i in range(n):
        if i % 3 and texts:
            words = rng.choice(texts[-6:]).split(" ")
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, base_words))]
            if i % 2:
                words += passage.split(" ")
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_groups(spark, n, percent):
    rows = generated(percent, 150, 80, 4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(df, n, percent).collect()}
    assert got == brute(rows, n, percent)
    assert 5 < len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize(("cuts", "growth"), [(0, 1.5), (3, 1.5), (2, 100), (2, 0)])
def test_large_regions_are_cut(spark, monkeypatch, cuts, growth):
    """Voronoi cuts, cuts that grow, and blocks alone give the same groups as one region."""
    monkeypatch.setattr(jaccard, "REGION", 600)
    monkeypatch.setattr(jaccard, "MEMBERS", 20)
    monkeypatch.setattr(jaccard, "CUTS", cuts)
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    rng = random.Random(9 + cuts)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, f"a b c d{i % 9}") for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == brute(rows, 3, 90)
    assert 3 < len({c for _, c in got.values()}) < len(rows)


def test_a_common_passage_copies_nothing(spark, monkeypatch):
    """Documents that share no more than a passage come apart before regions are cut, where copies grow with the square of their number; a
    row that is there twice changes nothing."""
    monkeypatch.setattr(jaccard, "REGION", 600)
    monkeypatch.setattr(jaccard, "MEMBERS", 20)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, passage + [f"w{i}x{j}" for j in range(20)]) for i in range(160)]
    rows += [(200 + i, [*rows[i][1][:-1], "new"]) for i in range(0, 160, 4)]
    rows = [(i, " ".join(words)) for i, words in rows]
    met = []
    joined = jaccard._joined
    monkeypatch.setattr(jaccard, "_joined", lambda regions, percent: met.append(regions.count()) or joined(regions, percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string"), 3, 80).collect()}
    assert got == brute(rows, 3, 80) and len({c for _, c in got.values()}) == 160
    assert sum(met) <= 100


def test_shuffled_rows_are_short():
    rng = np.random.default_rng(3)
    keys, nodes = (rng.integers(-(2**63), 2**63, 1000) for _ in range(2))
    rows = jaccard._packed(keys, nodes)
    k, v = jaccard._unpacked(np.frombuffer(rows.tobytes(), dtype=jaccard._ROW))
    assert len(rows.tobytes()) == 11_000 and (k == keys & (1 << 40) - 1).all() and (v == nodes & jaccard._NODE).all()


def test_main_group_is_the_largest(spark):
    """Bits 0 and 1 meet in a member, bit 2 has more members than either but not than both, and the old main group is bit 8."""
    rows = [(1, 0b01)] * 2 + [(1, 0b10)] * 2 + [(1, 0b11)] + [(1, 0b100)] * 4 + [(1, 0)] * 9 + [(2, 0)] + [(3, 1 << jaccard.PIVOTS)] * 3 + [(3, 1)]
    got = {r.region: r.main_bits for r in jaccard._mains(spark.createDataFrame(rows, "region bigint, bits int")).collect()}
    assert got == {1: 0b11, 3: 1 << jaccard.PIVOTS}


def test_one_id_with_several_texts(spark):
    """Texts of one id are sets of their own, of equal size and with the same smallest n-gram too, and tie what links to them."""
    rng = random.Random(3)
    a = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        b = list(a)
        b[rng.randrange(50, 150)] = f"x{k}"
        c, d = list(a), list(b)
        for i in range(4):
            c[5 + 2 * i] = f"c{k}{i}"
            d[180 + 2 * i] = f"d{k}{i}"
        words = lambda t: " ".join(f"k{k}{w}" for w in t)  # noqa: E731, B023
        rows += [(100 * k + 5, words(a)), (100 * k + 5, words(b)), (100 * k + 9, words(c)), (100 * k + 10, words(d))]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in brute(rows, 3, 90).items()}
    assert {r.component_id % 100 for r in found} == {5} and {r.n_shingles for r in found} == {198}


def test_odd_groups(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(odd, 3, 90).collect()), key=str)
    assert len(got) == odd.count()
    want = brute([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 3, 90)
    assert all((n, c) == want[i] for i, n, c in got if i is not None)
    assert [(n, c) for i, n, c in got if i is None] == [(0, None), (3, None)]
    assert jaccard.groups(empty, 3, 90).count() == 0


def test_projections_lose_no_link():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90):
        for _ in range(150):
            size = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            most = (100 - percent) * len(a) // 100
            drop, add = (int(x) for x in rng.multinomial(int(rng.integers(0, most + 1)), [0.5, 0.5]))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            common = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
            assert np.intersect1d(jaccard.projections(a, common, percent), jaccard.projections(b, common, percent)).size


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, 8), (7, 8), (8, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    out, capped = {s: total * weight[s] / sum(weight.values()) for s in names}, set()
    while over := [s for s in names if s not in capped and out[s] > 2 * sizes[s] + 1e-9]:
        excess = sum(out[s] - 2 * sizes[s] for s in over)
        for s in over:
            out[s] = 2.0 * sizes[s]
        capped |= set(over)
        free = [s for s in names if s not in capped]
        for s in free:
            out[s] += excess * weight[s] / sum(weight[f] for f in free)
    return out


def test_mix(corpus, odd, empty):
    for df in (corpus, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = targets(sizes)
        taken = Counter()
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutation(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(7).cast("bigint")).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def test_shard_counts_are_drawn(spark, corpus):
    """Counts by source and shard are draws of a multinomial: totals as the targets say, spread as chance has it, ranges without gaps; the mix by
    shard follows them."""
    sources = spark.createDataFrame([("a", 400_000, 600_000.0), ("b", 50_000, 60_000.5), (None, 3_000, 3_000.0), ("none", 0, 0.0)], "source string, source_size bigint, target double")
    counts = mixing.shard_counts(sources, block=32, shard_blocks=512).collect()
    by = defaultdict(list)
    for r in counts:
        by[r.source].append((r.shard, r["first"], r.n))
    shards = -(-663_001 // (32 * 512))
    assert set(by) == {"a", "b", None}
    for name, rows in by.items():
        rows.sort()
        at = 0
        for _, first, n in rows:
            assert first == at
            at += n
        held = np.array([n for _, _, n in rows] + [0] * (shards - len(rows)))
        chi = ((held - at / shards) ** 2 / (at / shards)).sum()
        assert shards / 3 < chi < 3 * shards, (name, chi)
    assert sum(n for _, _, n in by["a"]) == 400_000 // 32 + 200_000 // 32
    assert sorted(map(str, counts)) == sorted(map(str, mixing.shard_counts(sources.repartition(3), block=32, shard_blocks=512).collect()))
    assert sorted(map(str, counts)) != sorted(map(str, mixing.shard_counts(sources, seed=7, block=32, shard_blocks=512).collect()))
    deal = mixing.slots(sources, block=32, shard_blocks=512)
    held = {(r.source, r.shard): (r.n, r.least, r.most) for r in deal.groupBy("source", "shard").agg(F.count("*").alias("n"), F.min("slot").alias("least"), F.max("slot").alias("most")).collect()}
    assert held == {(r.source, r.shard): (r.n, 0, r.n - 1) for r in counts}
    assert deal.groupBy("source", "pass", "block").count().filter("count > 1").count() == 0


def test_mix_by_shard(corpus, monkeypatch):
    monkeypatch.setattr(mixing.slots, "__defaults__", (0, 16, 8))
    monkeypatch.setattr(mixing.segments, "__defaults__", (0, 16))
    rows = mixing.mix(corpus).collect()
    assert all(sum(s.words for s in r.shards) == r.taken for r in rows)
    words = Counter()
    for r in rows:
        for s in r.shards:
            words[s.shard] += s.words
    assert len(words) == -(-sum(r.taken for r in rows) // (16 * 8)) and min(words.values()) > 16


def test_mixed_documents(corpus, empty):
    out = mixing.mixed_documents(corpus)
    assert out.columns == corpus.columns
    taken = {r.id: r.taken for r in mixing.mix(corpus).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert mixing.mixed_documents(empty).count() == 0


def test_differencing():
    rng = random.Random(2)
    for k in (1, 2, 5):
        sizes = [rng.randint(1, 1000) for _ in range(60)]
        place, sums = sharding.difference([[s] + [0] * (k - 1) for s in sizes])
        held = [0] * k
        for s, p in zip(sizes, place):
            held[p[0]] += s
            assert sorted(p) == list(range(k))
        assert sorted(held) == sorted(sums) and [held[i] for i in range(k)] == sums
        assert max(held) - min(held) <= max(sizes) // 10


@pytest.mark.parametrize("bin_", [20_000, 8])
def test_shards(corpus, odd, empty, monkeypatch, bin_):
    monkeypatch.setattr(sharding, "BIN", bin_)
    monkeypatch.setattr(sharding, "FAN", 4)
    rows = sharding.assign(corpus, 6).collect()
    assert len(rows) == corpus.count()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    by, held, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        by[texts[r.doc_id]].add(r.shard)
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 8
    assert all(len(s) == 1 for s in by.values())
    assert max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(odd, 3).count() == odd.count()
    assert sharding.assign(empty, 3).count() == 0


def test_hot_group_is_split(spark):
    rows = [(i, "same text " * 5) for i in range(400)] + [(400 + i, f"text {i} " * 5) for i in range(300)]
    held = Counter()
    for r in sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 6).collect():
        held[r.shard] += r.size
    assert len(held) == 6 and max(held.values()) - min(held.values()) <= 0.05 * max(held.values())


@pytest.fixture(scope="module")
def pipeline_folder(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    junk = spark.createDataFrame([(1000, None, None, "s0", None), (1001, "12345 !!!", None, "s0", 9)], corpus.schema)
    corpus.unionByName(junk).write.parquet(f"{folder}/documents.parquet")
    corpus.select("doc_id", F.lit(1).alias("quality"), F.col("text").contains("idiot").cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline(spark, pipeline_folder, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{pipeline_folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language ID", "toxicity", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    kept = stages[0][1](spark, docs, pipeline_folder).cache()
    assert {r.doc_id for r in kept.collect()} == set(texts) - {1000, 1001} and kept.columns == docs.columns
    clean = stages[1][1](spark, kept, pipeline_folder).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i, t in texts.items() if i < 1000 and "idiot" not in t}
    single = stages[2][1](spark, clean, pipeline_folder).cache()
    want = brute([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    mixed = stages[3][1](spark, single, pipeline_folder).cache()
    assert mixed.columns == docs.columns
    last = stages[4][1](spark, mixed, pipeline_folder)
    assert last.count() == mixed.count()
    assert sorted(map(str, corpus_pipeline.run(spark, pipeline_folder).collect())) == sorted(map(str, last.collect()))


def test_pipeline_stages_take_odd_rows(spark, pipeline_folder, odd, empty):
    """Columns named like inner ones keep their values through every stage but the last."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clash = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, df, pipeline_folder)
            rows = found.collect()
            assert len(rows) <= 2 * df.count(), name
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert found.columns == df.columns and found.dtypes == df.dtypes, name
                assert all(r[c] == c for r in rows for c in clash), name
            if name in ("language ID", "toxicity", "n-gram Jaccard join"):
                assert {tuple(r) for r in rows} <= {tuple(r) for r in df.collect()}, name
    kept = corpus_pipeline.near_duplicates(spark, odd, pipeline_folder)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None, None]))


def test_repeated_ids_with_different_texts(spark):
    """Only copies go: a text that links with nothing stays, whatever other text has its id."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = [" ".join(words[i : i + 20]) for i in range(0, 100, 20)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (3, text[2]), (3, text[3]), (4, text[3]), (5, text[1]), (5, None), (None, text[0])]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    want = [(1, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (5, None), (None, text[0])]
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, want))
