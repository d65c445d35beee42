"""Sharding by Karmarkar-Karp differencing: groups of rows dealt to shards so that their bytes balance.

Items are groups of equal keys. Differencing keeps partial partitions (one sum for each shard) and combines, again
and again, the two of largest spread, the largest sum of one with the smallest of the other. It runs as a tree: items are dealt
into bins of bounded size, every bin is differenced in a task of its own, and the bins' partial partitions, again of
largest spread first, are combined level by level. Only the keys' sizes move, never the rows' payload.

A group that is larger than a whole shard cannot stay in one and is split into pieces by a hash of the row id; all
other groups stay together. Null keys count as their own kind of empty text: null and empty texts form one group.
Repeated rows are rows of one group; an empty table gives an empty result; ties are ordered by the group's hash.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Items differenced in one task, partial partitions combined in one task, rows numbered in one window.
BIN, FAN, RUN = 20_000, 512, 20_000


def difference(sums: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions (each a list of k sums) into one.

    Returns for each the shard that every place of it goes to, and the sums of the shards."""
    k = len(sums[0])
    order = [sorted(range(k), key=lambda j, s=s: (-s[j], j)) for s in sums]
    nodes = [([s[j] for j in o], i) for i, (s, o) in enumerate(zip(sums, order))]  # sums in falling order
    heap = [(v[-1] - v[0], i) for v, i in nodes]
    vectors = {i: v for v, i in nodes}
    heapq.heapify(heap)
    joins, new = [], len(sums)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        u, v = vectors.pop(a), vectors.pop(b)
        v.reverse()
        total = [x + y for x, y in zip(u, v)]
        ranked = sorted(range(k), key=total.__getitem__, reverse=True)
        vectors[new] = [total[j] for j in ranked]
        joins.append((new, a, b, ranked))
        heapq.heappush(heap, (vectors[new][-1] - vectors[new][0], new))
        new += 1
    root = heap[0][1]
    place = {root: list(range(k))}  # the shard of each rank of a node's vector
    for node, a, b, ranked in reversed(joins):
        own = place.pop(node)
        left = [0] * k
        for rank, j in enumerate(ranked):
            left[j] = own[rank]
        place[a], place[b] = left, left[::-1]
    out = []
    for i, o in enumerate(order):
        at, shard = place[i], [0] * k
        for rank, j in enumerate(o):
            shard[j] = at[rank]
        out.append(shard)
    return out, vectors[root]


def balance(items: DataFrame, shards: int, n_items: int) -> DataFrame:
    """(item, shard) from (item string, bytes long); items are distinct."""
    bins = max(1, math.ceil(n_items / BIN))
    dealt = items.withColumn("bin", F.pmod(F.xxhash64("item"), F.lit(bins)).cast("int"))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        place, _ = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]])
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "item": pdf["item"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "at": np.array([p[0] for p in place], dtype=np.int32)})

    found = stored(dealt.groupBy("bin").applyInPandas(leaf, "bin int, item string, bytes bigint, at int"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        place, _ = difference([[int(x) for x in s] for s in pdf["sums"]])
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "place": place})

    level = bins
    maps = found.select("bin", "at", F.col("at").alias("shard")).distinct()
    weights = found.groupBy("bin", "at").agg(F.sum("bytes").alias("bytes"))
    node = F.col("bin")
    while level > 1:
        # The partial partition of each node of this level, combined by FAN neighbours.
        spans = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0).cast("bigint")))
        sums = maps.join(weights, ["bin", "at"]).groupBy(node.alias("bin"), "shard").agg(F.sum("bytes").alias("b"))
        sums = sums.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m")).select("bin", spans.alias("sums"))
        placed = sums.withColumn("above", F.floor(F.col("bin") / FAN).cast("int")).groupBy("above").applyInPandas(join, "bin int, place array<int>").withColumnRenamed("bin", "node")
        maps = stored(maps.withColumn("node", node).join(placed, "node").select("bin", "at", F.element_at("place", F.col("shard") + 1).alias("shard")))
        node = F.floor(node / FAN).cast("int")
        level = math.ceil(level / FAN)
    return found.join(maps, ["bin", "at"]).select("item", "shard")


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot): rows of equal texts share a shard, bytes balance, slots are gapless."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).alias("_id"), (F.octet_length(raw) + overhead).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_h"))
    rows = stored(rows)
    groups = stored(rows.groupBy("_h", "text_crc32", "size").agg(F.count("*").alias("n")))
    total = groups.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    share = max(1, (total.bytes or 0) // shards)
    key = F.concat_ws(":", "_h", "text_crc32", "size", "piece")
    # Groups larger than a shard: at most ``shards`` of them.
    large = groups.filter(F.col("size") * F.col("n") > share).select("_h", "text_crc32", "size", (F.ceil(F.col("size") * F.col("n") / F.lit(share)) * 8).cast("int").alias("pieces"))
    cut = rows.join(F.broadcast(large), ["_h", "text_crc32", "size"], "left")
    cut = cut.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    items = cut.withColumn("item", key).groupBy("item").agg(F.sum("size").alias("bytes"))
    found = balance(items, shards, (total.groups or 0) + 16 * shards)
    runs = max(1, math.ceil((total.n or 0) / shards / RUN))
    placed = cut.withColumn("item", key).join(found, "item").withColumn("run", F.pmod(F.xxhash64("_id", "_h"), F.lit(runs)).cast("int"))
    placed = stored(placed.select("_id", "size", "text_crc32", "_h", "shard", "run"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "run").orderBy("_id", "_h", "text_crc32", "size"))
    out = placed.withColumn("number", number).join(starts, ["shard", "run"])
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("number") - 1).cast("bigint").alias("slot"))
