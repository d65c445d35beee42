"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, and the
groups that such links form. Exact, as a join in the metric space of sets under Jaccard distance.

Let e = 1 - threshold. Most documents are at distance 1 from each other, where no pivot tells them apart, so the space is
first cut into projections in which pivots do:

1. Projections. A set is split by a hash into so many classes that a link, whose difference is a bounded share of its size,
   leaves a non-empty class untouched. In that class both documents lie at distance 0 from the same pivot, the class's
   content; the pivots' regions there are exactly the documents with that content. (Sizes are dealt into levels, and a document
   also takes part in the next one, because a link's sizes differ by at most the threshold.) N-grams that very many
   documents hold are left out first; a document whose other n-grams fill too few classes takes part with all its n-grams
   too, so that no link is lost. Inside a task and then over tasks every region ties its documents to its smallest
   one; what hangs together is a cluster, and no link leaves a cluster.
2. Rare n-grams. Of two linked documents' n-grams, each in the same order, at least one is common to the first ones of both, as many as may differ and
   one more. In clusters that are too large for a task the order is by the number of the cluster's documents that hold an n-gram: what
   only passages, chance or classes without n-grams tied comes apart, and n-grams that no other document holds tie nothing.
3. Voronoi regions. Clusters that are still too large are cut: pivots are drawn, every document's distance to them is measured,
   and those within the threshold of a pivot are linked to it. Of what is connected in that way the largest group is the
   cluster's main group; a link that still matters has an end outside of it. Each document goes to the region of its nearest pivot, and the
   documents outside the main group also to every region whose pivot is at most 2e farther than their nearest one: by the
   triangle inequality such a document then meets all documents it is linked to in their own regions. Pivots are done with.
   Regions without a document outside the main group hold no link that matters and go. Regions that are still too
   large are cut again. Where copies would outweigh the gain (distances that tell nothing apart) or after CUTS rounds, the documents outside the main
   group are dealt into blocks and meet blocks of all, which is exact too.
4. Inside a region each document is a pivot once: it is compared with those documents only which are not already
   connected to it, whose sizes allow a link, and whose distances to earlier pivots differ by no more than e.

Links are a spanning forest of every group (all links' groups, not all links). Words are runs without ASCII white space, A-Z
lower-cased; a text of fewer words than n is one n-gram; null and empty texts and texts without words have an empty set and
link with nothing. Rows of one id are one node: what links to one of its texts links to the id; their n_shingles are each row's own.
Rows without an id have no sets of their own and only find the group of an equal set. Equal sets are joined once. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .common import chunks, cleaned, sent, stored, tidy
from .graph import components

#: N-grams and documents (of all together) that one region may hold in a task.
REGION, MEMBERS = 50_000, 20_000
#: Pivots drawn in a region that is too large, rounds of that before blocks, and by how much copies may make a region grow in a round.
PIVOTS, CUTS, GROWTH = 8, 4, 1.5
#: Regions that a pair of blocks is as large as. Blocks copy a cluster of T n-grams, M of them outside the main group, 4 M T / (TILE * REGION)
#: times an n-gram, so they are larger than regions (3 MB of n-grams).
TILE = 8
#: An n-gram is common if tasks that met it in several different sets did so more than so often; so many are known as such at most.
OFTEN, COMMON = 1, 1 << 21
#: N-grams of all documents for each part of the projections' keys.
PART = 400_000
#: Rows of projections a task gathers before it ties them.
GATHER = 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(30))


@functools.cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its random value (A-Z that of a-z), and whether it is white space."""
    value = _mix(np.arange(1, 257, dtype=np.uint64) * _B)
    value[65:91] = value[97:123]
    white = np.zeros(256, dtype=bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return value, white


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    value, white = _bytes()
    space = white[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    summed = np.zeros(len(data) + 1, dtype=np.uint64)
    np.add.accumulate(value[data] * power[: len(data)], out=summed[1:])
    word = _mix((summed[end] - summed[start]) * inverse[start] + (end - start).astype(np.uint64) * _A)
    stops = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, stops)
    grams = word.copy()
    for j in range(1, n):
        grams[: len(word) - j] = _mix(grams[: len(word) - j] * _B + word[j:]) if len(word) > j else grams[:0]
    out, at = [], 0
    for stop in upto.tolist():
        words = stop - at
        if words >= n:
            out.append(np.unique(grams[at : stop - n + 1]))
        elif words:
            h = np.uint64(words)
            with np.errstate(over="ignore"):
                for w in word[at:stop]:
                    h = _mix(np.array([h * _A + w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at = stop
    return out


def _set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


@functools.lru_cache(maxsize=8)
def tiers(percent: int) -> tuple[tuple[int, float], ...]:
    """(least content of a class, classes for each element of a link's difference), strictest first: classes with more content tell
    documents apart better, but must outnumber the difference even if a tenth (in the last tier a half) of the n-grams are common."""
    each, out = percent / (100 - percent), []

    def enough(least: int, s: float, share: float) -> bool:
        mean = share * each / s
        below = sum(mean**k * math.exp(-mean) / math.factorial(k) for k in range(least))
        return s * (1 - below) >= 1.06

    for least, share, most in ((3, 0.9, 1.5), (2, 0.9, 2.05), (1, 0.5, 4.0)):
        s = next((x / 20 for x in range(21, int(most * 20) + 1) if enough(least, x / 20, share)), None)
        if s and (not out or least == 1):
            out.append((least, s))
    return tuple(out)


@functools.lru_cache(maxsize=8)
def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(least size of each level, most elements in the difference of a link there). A link's sizes lie in one level or in
    neighbours, and its difference is at most (100 - percent) / percent of the smaller size."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    most = np.array(low[1:], dtype=np.int64) - 1
    return np.array(low[:-1], dtype=np.int64), (100 - percent) * most // percent


def _contents(grams: np.ndarray, level: int, classes: int, kind: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the classes that hold ``least`` n-grams or more, a hash of the content of each)."""
    salt = _mix(np.array([8 * level + kind], dtype=np.uint64))
    place = ((grams >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)  # ascending, as the hashes are
    if not len(place):
        return place, place
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    content = np.add.reduceat(_mix(grams + salt), first)
    if least > 1:
        full = np.diff(np.append(first, len(place))) >= least
        first, content = first[full], content[full]
    return place[first], _mix(content ^ _mix(place[first] * _A + salt))


def projections(grams: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the contents of a set's classes in its level and the next one.

    Let d be the most elements that a link's difference has there. A document takes part with the classes of a tier; if these are no
    more than d, with those of the next tier too. Of two linked documents' classes at most d are touched by the difference, so if
    one document has more than d in a tier, an untouched one is common to both; and if neither has, both go on to the next
    tier. Behind the last tier come all n-grams, the common ones included, in d + 2 classes, of which at least two are untouched; empty
    ones then count only if there are two or more."""
    low, most = levels(percent)
    own = int(np.searchsorted(low, len(grams), side="right")) - 1
    rare = grams
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rare = grams[common[at] != grams]
    out = []
    for level in (own, own + 1):
        d = int(most[level])
        for kind, (least, s) in enumerate(tiers(percent)):
            place, keys = _contents(rare, level, int(s * d) + 2, kind + 1, least)
            out.append(keys)
            if len(place) > d:
                break
        else:
            place, keys = _contents(grams, level, d + 2, 0)
            out.append(keys)
            if d + 2 - len(place) >= 2:
                empty = np.setdiff1d(np.arange(d + 2, dtype=np.uint64), place)
                out.append(_mix(_mix(empty * _A + np.uint64(level)) ^ _B))
    return np.concatenate(out)


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*sets, np.zeros(0, np.uint64)])


def described(df: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_id binary, node long, gram long, seen long): a row for each document, equal sets having equal ids
    and ``node`` being the id's short form; and rows (gram, seen) of n-grams that a task met in several different sets."""
    reachable(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["id", "n_shingles", "set_id", "node", "gram", "seen"]
        known: set[int] = set()
        held, count = [], 0

        def often():
            grams, seen = np.unique(_flat(held), return_counts=True)
            grams, seen = grams[seen > 1].view(np.int64), seen[seen > 1]
            for a in range(0, len(grams), 200_000):
                g = grams[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.int64()), pa.nulls(len(g), pa.int64()), pa.nulls(len(g), pa.binary()), pa.nulls(len(g), pa.int64()), pa.array(g), pa.array(seen[a : a + 200_000])], names=names)

        for batch in chunks(batches, "text"):
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            ids = [_set_id(s) for s in sets]
            nodes = np.frombuffer(b"".join(i[:8] for i in ids), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(nodes), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
            for s, node in zip(sets, nodes.tolist()):
                if node not in known:
                    known.add(node)
                    held.append(s)
                    count += len(s)
            if count > GATHER * 2:
                yield from often()
                known.clear()
                held, count = [], 0
        if held:
            yield from often()

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id bigint, n_shingles bigint, set_id binary, node bigint, gram bigint, seen bigint")


def common_grams(info: DataFrame) -> np.ndarray:
    """The n-grams that many different sets hold, sorted: those met most often, COMMON at most. The choice decides how
    well the projections tell documents apart, not what is found."""
    counted = info.filter("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen")).filter(F.col("seen") > OFTEN)
    got = counted.orderBy(F.desc("seen"), "gram").limit(COMMON).select("gram").toArrow()
    return np.sort(got.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _tied(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys with their smallest node; edges from those to the other nodes)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    root = np.repeat(nodes[first], np.diff(np.append(first, len(keys))))
    other = root != nodes
    edges = np.unique(np.stack([root[other], nodes[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[first], nodes[first], edges


#: Rows as they are shuffled: of a key the low 40 bits, as its part holds high ones, and of a node the low 48 (_NODE); what meets by chance
#: (0.05 pairs expected in a part of 330,000 rows) only makes a cluster larger. Edges are between nodes.
_ROW = np.dtype([("key", "<u4"), ("key_high", "u1"), ("node", "<u4"), ("node_high", "<u2")])
_EDGE = np.dtype([("a", "<i8"), ("b", "<i8")])
_NODE = (1 << 48) - 1


def _packed(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    rows = np.empty(len(keys), dtype=_ROW)
    k, v = np.ascontiguousarray(keys).view(np.uint64), np.ascontiguousarray(nodes).view(np.uint64)
    low, bits = np.uint64(0xFFFFFFFF), np.uint64(32)
    rows["key"], rows["key_high"] = k & low, (k >> bits) & np.uint64(0xFF)
    rows["node"], rows["node_high"] = v & low, (v >> bits) & np.uint64(0xFFFF)
    return rows


def _unpacked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows["key"].astype(np.int64) | rows["key_high"].astype(np.int64) << 32, rows["node"].astype(np.int64) | rows["node_high"].astype(np.int64) << 32


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def candidate_edges(df: DataFrame, n: int, percent: int, common: np.ndarray, parts: int, text_col: str = "text") -> DataFrame:
    """(a, b): nodes (their _NODE bits) of different sets that share a region of a projection, tied to the region's smallest node.

    (key, node) pairs are shuffled packed, a row for each task and part of the keys, 11 bytes a pair."""
    given = sent(df, common)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, count = [], 0
        seen: set[int] = set()

        def flush():
            keys, nodes, edges = _tied(np.concatenate([k for k, _ in held]).view(np.int64), np.concatenate([v for _, v in held]))
            for kind, k, v in ((0, keys, nodes), (1, edges[:, 0], edges[:, 1])):
                # Edges are dealt out by their own hash.
                part = _dealt(_mix(k.view(np.uint64) + v.view(np.uint64) * _A) if kind else k, parts)
                order = np.argsort(part, kind="stable")
                if kind:
                    rows = np.empty(len(k), dtype=_EDGE)
                    rows["a"], rows["b"] = k[order], v[order]
                else:
                    rows = _packed(k[order], v[order])
                names, first = np.unique(part[order], return_index=True)
                ends = np.append(first[1:], len(rows))
                for a in range(0, len(names), 64):
                    some = slice(a, a + 64)
                    packed = [rows[x:y].tobytes() for x, y in zip(first[some], ends[some])]
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array([bool(kind)] * len(packed)), pa.array(packed, pa.binary())], names=["part", "edges", "packed"])

        for batch in chunks(batches, "text"):
            for grams in ngram_sets(batch.column("text").to_pylist(), n):
                if not len(grams):
                    continue
                node = int(np.frombuffer(_set_id(grams)[:8], dtype=np.int64)[0]) & _NODE
                if node in seen:
                    continue
                seen.add(node)
                found = projections(grams, given.value, percent)
                held.append((found, np.full(len(found), node, dtype=np.int64)))
                count += len(found)
                if count >= GATHER:
                    yield from flush()
                    held, count = [], 0
                    seen.clear()
        if held:
            yield from flush()

    def tie(batches: Iterator) -> Iterator:
        """Rows of a partition come sorted by part."""
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "edges", "packed")))

        for _, members in groupby(rows(), key=lambda r: r[0]):
            kinds: tuple[list, list] = ([], [])
            for _, kind, packed in members:
                kinds[kind].append(np.frombuffer(packed, dtype=_EDGE if kind else _ROW))
            found = [np.stack([x["a"], x["b"]], axis=1) for x in kinds[1]]
            if kinds[0]:
                found.append(_tied(*_unpacked(np.concatenate(kinds[0])))[2])
            edges = np.unique(np.concatenate(found), axis=0)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], names=["a", "b"])

    packed = df.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "part bigint, edges boolean, packed binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(tie), "a bigint, b bigint").distinct()


def linked(names: np.ndarray, sets: list[np.ndarray], percent: int, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (name, name) that connect the groups of a region, of which the documents marked in ``main`` are one already; see step 4 above."""
    count = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    names, sets = names[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    group = np.arange(count)
    if main is not None and main.any():
        same = np.flatnonzero(main[order])
        group[same] = same[0]
    links = []

    def tie(i: int, j: int) -> None:
        links.append((int(names[i]), int(names[j])))
        a, b = group[i], group[j]
        if a != b:
            group[group == max(a, b)] = min(a, b)

    if count <= 3:
        for i in range(count):
            for j in range(i + 1, count):
                if group[i] != group[j] and 100 * size[i] >= percent * size[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        tie(i, j)
        return links
    tokens = np.concatenate(sets)
    _, tokens = np.unique(tokens, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(tokens.max() + 1, dtype=bool)
    # Distances (as shares) of all to a few pivots: by the triangle inequality they bound other distances.
    reach = (100 - percent) / 100 + 1e-9
    known: list[np.ndarray] = []
    for i in range(count):
        could = (group != group[i]) & (100 * size >= percent * size[i]) & (100 * size[i] >= percent * size)
        could[: i + 1] = False  # those were pivots before
        for d in known:
            could &= np.abs(d - d[i]) <= reach
        others = np.flatnonzero(could)
        full = len(known) < 12 and len(others) > 64
        if full:
            others = np.arange(count)
        if not len(others):
            continue
        mark[tokens[first[i] : first[i + 1]]] = True
        if len(others) * 2 > count:
            both = np.add.reduceat(mark[tokens].view(np.uint8), first[:-1], dtype=np.int64)[others]
        else:
            both = np.array([np.count_nonzero(mark[tokens[first[j] : first[j + 1]]]) for j in others], dtype=np.int64)
        mark[tokens[first[i] : first[i + 1]]] = False
        union = size[i] + size[others] - both
        if full:
            known.append(1 - both / union)
            near = could & (100 * both >= percent * union)
            hits = np.flatnonzero(near)
        else:
            hits = others[100 * both >= percent * union]
        for j in hits.tolist():
            if group[i] != group[j]:
                tie(i, j)
    return links


def _joined(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of all regions (region, id, node, grams, main), each of bounded size."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        def rows():
            for pdf in frames:
                yield from zip(*(pdf[c].tolist() for c in ("region", "id", "node", "grams", "main")))

        for _, members in groupby(rows(), key=lambda r: r[0]):
            # A document that reached a region along several ways stands in it once.
            own = {node: (i, g, m) for _, i, node, g, m in members}
            ids, sets, main = zip(*own.values())
            found = linked(np.array(ids, dtype=np.int64), [np.asarray(g, dtype=np.int64) for g in sets], percent, np.array(main, dtype=bool))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return regions.repartition("region").sortWithinPartitions("region", "id").mapInPandas(tidy(run), "a bigint, b bigint")


def _measured(members: DataFrame, percent: int, round_: int) -> DataFrame:
    """``members`` (region, id, node, grams, main, total) with ``ds``, the distances to the pivots of their region (slot, id, d, linked), and
    ``done``, whether a document is itself a pivot. Pivots are drawn from the documents outside the main group. A large region's members
    are dealt over as many keys as it would fill regions, each with a copy of the pivots."""
    draw = F.xxhash64(F.lit(round_), "node")
    drawn = members.filter("not main").groupBy("region", F.pmod(draw, F.lit(PIVOTS)).cast("int").alias("slot")).agg(F.min_by("node", draw).alias("node"))
    pivots = members.select("region", "id", "node", "grams", "total").join(drawn, ["region", "node"])
    keys = F.greatest(F.ceil(F.col("total") / REGION), F.lit(1)).cast("int")
    listed = pivots.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "node", "grams"))).alias("pivots"), F.max(keys).alias("keys"))
    listed = listed.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))).drop("keys")
    dealt = members.withColumn("key", F.pmod(F.xxhash64("node"), keys).cast("int"))

    def distance(p):
        # The number of common n-grams is a lambda's argument, so that it is counted once.
        common = F.array(F.size(F.array_intersect("grams", p["grams"])))
        both = lambda x: F.struct(p["slot"].alias("slot"), p["id"].alias("id"), (1 - x / (F.size("grams") + F.size(p["grams"]) - x)).alias("d"), (100 * x >= percent * (F.size("grams") + F.size(p["grams"]) - x)).alias("linked"))
        return F.transform(common, both)[0]

    both = dealt.join(listed, ["region", "key"])
    done = F.exists("pivots", lambda p: p["node"] == F.col("node"))
    return both.select("region", "id", "node", "grams", "total", "main", F.transform("pivots", distance).alias("ds"), done.alias("done"))


def _mains(near: DataFrame) -> DataFrame:
    """(region, main_bits): of the groups that pivots (bits by slot) and the main group so far (one more bit) form by common members, the largest."""
    old = 1 << PIVOTS
    counts = near.groupBy("region", "bits").agg(F.count("*").alias("n")).filter("bits > 0")
    seen = counts.groupBy("region").agg(F.collect_list(F.struct("bits", "n")).alias("seen"))  # 2 ** (PIVOTS + 1) at most
    met = lambda a, m: F.when(a.bitwiseAND(m["bits"]) != 0, a.bitwiseOR(m["bits"])).otherwise(a)
    start = F.array(*(F.lit(1 << i) for i in range(PIVOTS)), F.lit(old))
    whole = F.transform(start, lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(PIVOTS)), b, lambda a, _: F.aggregate("seen", a, met)))
    sized = F.transform(whole, lambda g: F.struct(F.aggregate("seen", F.lit(0).cast("bigint"), lambda n, m: n + F.when(m["bits"].bitwiseAND(g) != 0, m["n"]).otherwise(0)).alias("n"), (-g).alias("g")))
    return seen.select("region", (-F.array_max(sized)["g"]).alias("main_bits"))


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions in which every document outside the main group meets every other one and every document of the main group."""
    blocks = lambda c: F.greatest(F.ceil(2 * F.col(c) / (TILE * REGION)), F.lit(1)).cast("int")
    rows = members.join(sizes.select("region", blocks("moving").alias("ours"), blocks("total").alias("all")), "region")
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    meets = F.transform(F.sequence(F.lit(0), F.col("ours") - 1), lambda i: pair(i, at("all")))
    meets = F.when(F.col("main"), meets).otherwise(F.concat(meets, F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: pair(at("ours"), j))))
    rows = rows.withColumn("pair", F.explode(meets))
    return rows.select(F.xxhash64("region", "pair.i", "pair.j").alias("region"), "id", "node", "grams", "main")


def _sizes(members: DataFrame) -> DataFrame:
    size = F.size("grams").cast("bigint")
    return members.groupBy("region").agg(F.sum(size).alias("total"), F.sum(F.when(~F.col("main"), size).otherwise(0)).alias("moving"), F.count("*").alias("members"))


def _large(sizes: DataFrame) -> DataFrame:
    return sizes.filter((F.col("total") > REGION) | (F.col("members") > MEMBERS))


def _apart(active: DataFrame, percent: int) -> DataFrame:
    """``active`` (region, id, node, grams, main) with the regions that are too large cut by rare n-grams, see step 2 above; documents that link with nothing go."""
    large = stored(_large(_sizes(active)).select("region"))
    if not large.count():
        return active
    some = active.join(large, "region", "left_semi")
    each = some.select("region", "node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    met = each.withColumn("seen", F.count("*").over(Window.partitionBy("region", "gram"))).filter("seen > 1")
    # A document's row can be there twice.
    met = met.groupBy("region", "node").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("seen", "gram"))).alias("met"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1 - (F.col("n") - F.size("met"))
    keys = met.withColumn("first", first).filter("first > 0").select("region", "node", F.explode(F.slice("met", F.lit(1), F.col("first"))).alias("m"))
    least = F.min("node").over(Window.partitionBy("region", "m.gram"))
    labels = stored(components(stored(keys.select(least.alias("a"), F.col("node").alias("b")).filter("a <> b").distinct())))
    cut = stored(some.join(labels, "node").select(F.col("label").alias("region"), "id", "node", "grams", "main"))
    cleaned(active.sparkSession)
    return active.join(large, "region", "left_anti").select(*cut.columns).union(cut)


def links(df: DataFrame, info: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): a spanning forest of the groups of linked documents, each set standing for its smallest id."""
    total = info.agg(F.sum("n_shingles")).first()[0] or 0
    edges = stored(candidate_edges(df, n, percent, common_grams(info), 1 + total // PART, text_col))
    cleaned(df.sparkSession)
    clusters = stored(components(edges)).withColumnRenamed("node", "short")
    cleaned(df.sparkSession)
    firsts = info.filter("gram is null and n_shingles > 0 and id is not null").groupBy("set_id", "node").agg(F.min("id").alias("id"))
    chosen = firsts.withColumn("short", F.col("node").bitwiseAND(F.lit(_NODE))).join(clusters, "short").select("id", "set_id", "node", F.col("label").alias("region"))
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("region", "id", "node", "set_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "text"):
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            same = [i for i, (s, x) in enumerate(zip(sets, batch.column("set_id").to_pylist())) if _set_id(s) == x]
            kept = batch.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("region", "id", "node")), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["region", "id", "node", "grams"])

    active = stored(texts.mapInArrow(tidy(run), "region bigint, id bigint, node bigint, grams array<bigint>")).withColumn("main", F.lit(False))
    cleaned(df.sparkSession)
    active = _apart(active, percent)
    window = F.lit(2 * (100 - percent) / 100 + 1e-9)
    out = []
    for round_ in range(CUTS + 1):
        sizes = stored(_sizes(active))
        large = _large(sizes)
        some = large.count()
        out.append(_joined(active.join(large, "region", "left_anti") if some else active, percent))
        if not some:
            break
        rest = active.join(large.select("region", "total"), "region")
        if round_ == CUTS:
            out.append(_joined(_blocks(rest, large), percent))
            break
        bits = F.aggregate(F.filter("ds", lambda p: p["linked"]), F.lit(0), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), p["slot"])))
        near = stored(_measured(rest, percent, round_).withColumn("bits", bits + F.when(F.col("main"), 1 << PIVOTS).otherwise(0)))
        out.append(near.select(F.col("id").alias("a"), F.explode(F.filter("ds", lambda p: p["linked"])).alias("p")).select("a", F.col("p.id").alias("b")).filter("a <> b"))
        left = near.filter("not done").join(_mains(near), "region", "left").withColumn("main", F.coalesce(F.col("bits").bitwiseAND(F.col("main_bits")) != 0, F.lit(False)))
        least = F.array_min(F.transform("ds", lambda p: F.struct(p["d"].alias("d"), p["slot"].alias("slot"))))
        left = left.withColumn("least", least)
        goes = F.when(F.col("main"), F.array("least.slot")).otherwise(F.transform(F.filter("ds", lambda p: p["d"] <= F.col("least.d") + window), lambda p: p["slot"]))
        left = left.withColumn("goes", goes)
        grown = left.groupBy("region").agg(F.sum(F.size("grams").cast("bigint") * F.size("goes")).alias("after"), F.max("total").alias("before"))
        dense = stored(grown.filter(F.col("after") > F.lit(GROWTH) * F.col("before")).select("region"))
        if dense.count():
            apart = left.join(dense, "region", "left_semi").select("region", "id", "node", "grams", "main")
            out.append(_joined(_blocks(apart, _sizes(apart)), percent))
            left = left.join(dense, "region", "left_anti")
        cut = left.withColumn("slot", F.explode("goes")).select(F.xxhash64("region", "slot", F.lit(round_)).alias("region"), "id", "node", "grams", "main")
        open_ = cut.filter("not main").select("region").distinct()
        active = stored(cut.join(open_, "region", "left_semi"))
        cleaned(df.sparkSession)
    return functools.reduce(DataFrame.union, out)


def groups(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: component_id is the smallest id that links reach, itself included."""
    reachable(df.sparkSession)
    info = stored(described(df, n, id_col, text_col))
    forest = stored(links(df, info, n, percent, id_col, text_col))
    cleaned(df.sparkSession)
    labels = stored(components(forest))
    info = info.filter("gram is null").select("id", "n_shingles", "set_id")
    firsts = info.filter("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("first"))
    named = firsts.join(labels, firsts["first"] == labels["node"], "left").select("set_id", F.coalesce("label", "first").alias("component"))
    full = info.filter("n_shingles > 0").join(named, "set_id").select("id", "n_shingles", "component")
    empty = info.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    return full.union(empty).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


__all__ = ["groups", "links", "ngram_sets", "linked"]
