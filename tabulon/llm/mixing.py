"""Mixing sources to target weights, as DataFrame expressions only.

1. Sizes. A document's size is its number of words; a source's target is its share, by weight, of a multiple of all
   words, at most ``most`` times its own words (what is cut there is shared again by weight).
2. Blocks. The documents of a source stand in a pseudorandom order (a hash of the id), and their words are packed
   into blocks of BLOCK words; the last one may be short.
3. Slots. A source gets as many slots as its target needs: whole passes over its blocks, and a part of one more,
   whose last slot is cut so that the source's words meet the target to the word. Slot j of a pass holds block
   perm(j), a permutation of the source's block numbers that is computed for each j alone (swap-or-not rounds).
4. Shards. Of each source's slots, every output shard gets a number that is drawn: over the shards these numbers are one multinomial draw of
   the source's total, so the totals stay what the targets say. The numbers, summed up, are ranges of slots; a shard holds the
   slots of its range, and through the permutation pseudorandom blocks of the source.
5. Blocks join slots by (source, block), which is even however large a source is.

Nothing is windowed over a whole source: positions are sums over runs of bounded size and offsets of the runs. Null
and empty texts have size 0 and are never taken; null sources are one source, sorted last; repeated rows are
separate documents; an empty table gives an empty mix. Draws depend on ids and the seed only, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK, SHARD_BLOCKS, RUN, PART, ROUNDS = 256, 4096, 2000, 4096, 24


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) of each row."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): with a cap at ``most`` times the size, sharing the excess again by weight until none is above ends
    at min(cap, weight * level) for one level, found from running sums in the order of cap / weight.

    This works on one row for each source, the only thing here that a single task sees whole."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    t = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(all_rows) * F.lit(float(share))
    t = t.withColumns({"_whole": whole, "_weights": F.sum("weight").over(all_rows)})
    # The level if all sources before this one are capped and no other.
    t = t.withColumn("_level", (F.col("_whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("_free", F.col("_level") * F.col("weight") < F.col("cap"))
    # The first source that stays below its cap sets the level of all that follow.
    level = F.min(F.when(F.col("_free"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("_level").alias("level")))).over(all_rows)["level"]
    t = t.withColumn("_set", level)
    target = F.least(F.col("cap"), F.coalesce(F.col("_set") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Place of x in a pseudorandom permutation of 0 .. n - 1 chosen by ``key``: each round pairs x with its mirror about a
    drawn point and swaps the pair or not by a drawn bit, which any n allows without a table."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("bigint"), step)


def _goals(sources: DataFrame, block: int) -> DataFrame:
    """``sources`` that hold words, with the words and slots that the mix takes: whole passes, then a part of one more."""
    goal, size, b = F.least(F.round("target").cast("bigint"), F.col("source_size") * MOST), F.col("source_size"), F.lit(block)
    s = sources.filter("source_size > 0").withColumn("goal", goal).withColumns({"full": F.floor(size / b), "tail": size % b, "passes": F.floor(F.col("goal") / size), "rest": F.col("goal") % size})
    s = s.withColumns({"blocks": F.col("full") + (F.col("tail") > 0).cast("int"), "left": F.floor(F.col("rest") / b), "cut": F.col("rest") % b})
    return s.withColumn("n", F.col("passes") * F.col("blocks") + F.col("left") + (F.col("cut") > 0).cast("int")).filter("n > 0")


def shard_counts(sources: DataFrame, seed: int = 0, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source, shard, n, first): how many of a source's slots an output shard gets, and the first of its range of them.

    Every slot draws a shard from a hash, and only the counts are kept: a multinomial draw of the source's number of slots. Ranges are running sums
    over runs of shards and offsets of the runs."""
    s = _goals(sources, block)
    words = s.agg(F.sum("goal")).first()[0] or 0
    shards = max(1, math.ceil(words / (block * shard_blocks)))
    # A source of many slots is dealt out in parts before its slots are listed. The number of partitions is given, since by the
    # size of the parts' table all of them would be put into one task.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.select("source", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PART))).alias("part")).repartition(tasks, "source", "part")
    low = F.col("part") * PART
    drawn = s.select("source", F.explode(F.sequence(low, F.least(low + PART, F.col("n")) - 1)).alias("k"))
    drawn = drawn.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "source", "k"), F.lit(shards)))
    counts = stored(drawn.groupBy("source", "shard").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN)))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("source", "run").agg(F.sum("n").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("source", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c, o = counts.withColumn("inside", inside).alias("c"), starts.alias("o")
    both = c.join(o, F.col("c.source").eqNullSafe(F.col("o.source")) & (F.col("c.run") == F.col("o.run")))
    return both.select("c.source", "c.shard", "c.n", (F.col("offset") + F.col("inside")).alias("first"))


def slots(sources: DataFrame, seed: int = 0, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source, pass, block, taken, shard, slot): one row for each slot of the mix; slots of a shard are numbered by source."""
    s, b = _goals(sources, block).alias("s"), F.lit(block)
    c = shard_counts(sources, seed, block, shard_blocks).withColumnRenamed("n", "share").alias("c")
    # As in shard_counts, small tables that become large ones when listed are dealt out first.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).drop(F.col("c.source")).repartition(tasks, "source", "shard")
    s = s.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("share") - 1))).withColumn("k", F.col("first") + F.col("slot"))
    s = s.withColumns({"pass": F.floor(F.col("k") / F.col("blocks")), "j": F.col("k") % F.col("blocks")})
    key = F.xxhash64(F.lit(seed), "source", "pass")
    s = s.withColumn("block", F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), key)).otherwise(F.col("full")))
    last = (F.col("pass") == F.col("passes")) & (F.col("j") == F.col("left"))
    taken = F.when(last, F.col("cut")).when(F.col("j") < F.col("full"), b).otherwise(F.col("tail"))
    return s.select("source", F.col("pass").cast("int").alias("pass"), F.col("block").cast("bigint").alias("block"), taken.cast("bigint").alias("taken"), "shard", "slot")


def placed(rows: DataFrame, n_rows: int, seed: int = 0) -> DataFrame:
    """``rows`` (id, source, size) of positive size with the position ``start`` of their first word in their source."""
    runs = max(1, math.ceil(n_rows / RUN))
    rows = rows.filter("size > 0").withColumn("h", F.xxhash64(F.lit(seed + 2), "id"))
    rows = rows.withColumns({"run": F.pmod("h", F.lit(runs)).cast("int"), "null_source": F.col("source").isNull(), "key": F.coalesce(F.col("source"), F.lit(""))})
    by = ["key", "null_source", "run"]
    before = Window.partitionBy("key", "null_source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(rows.groupBy(*by).agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words"))
    inside = F.sum("size").over(Window.partitionBy(*by).orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, by)
    return rows.select("id", "source", "size", (F.col("offset") + F.col("inside")).alias("start"))


def segments(docs: DataFrame, sources: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(id, source, size, start, pass, shard, first, words): the words of a placed document that a slot takes, ``first`` counted
    from the document's start."""
    docs = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    deal = slots(sources, seed, block).withColumnRenamed("source", "_source")
    # Sizes are estimated from before the listing, so that a broadcast would look small when it isn't.
    both = docs.join(deal.hint("merge"), docs["source"].eqNullSafe(deal["_source"]) & (docs["block"] == deal["block"])).drop(deal["block"]).drop("_source")
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("taken"))
    both = both.withColumns({"first": low - F.col("start"), "words": high - low}).filter("words > 0")
    return both.select("id", "source", "size", "start", "pass", "shard", "first", "words")


def mix(df: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """(id, source, size, source_size, target, taken, shards) of each row of ``df``: taken counts words, repeats included; shards lists (shard, words)
    of the output shards that take them."""
    rows = stored(sized(df, **columns))
    n = rows.count()
    sources = stored(targets(rows))
    docs = stored(placed(rows, n, seed))
    same = ["id", "source", "size", "start"]
    parts = segments(docs, sources, seed).groupBy(*same, "shard").agg(F.sum("words").alias("words"))
    parts = parts.groupBy(*same).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    a, b = docs.alias("a"), parts.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    both = a.join(b, on, "left").select("a.id", "a.source", "a.size", F.coalesce("b.taken", F.lit(0)).alias("taken"), F.coalesce("b.shards", none).alias("shards"))
    both = both.unionByName(rows.filter("size = 0").withColumns({"taken": F.lit(0).cast("bigint"), "shards": none}))
    named = sources.withColumnRenamed("source", "_source")
    return both.join(named, both["source"].eqNullSafe(named["_source"])).select("id", "source", "size", "source_size", "target", "taken", "shards")


def mixed_documents(df: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as rows of ``df`` (doc_id, text, source, n_chars and any other columns): one row for each pass that takes words of a
    document. A document taken whole keeps its text; of others, the words taken are joined by spaces. What rows hold besides the text
    travels in one column, so that no name of theirs meets one used here, and the text once, beside it."""
    rows = stored(sized(df))
    sources = stored(targets(rows))
    parts = segments(stored(placed(rows, rows.count(), seed)), sources, seed)
    spans = parts.groupBy("id", "source", "size", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("taken"))
    # Rows of equal id, source and size take their passes in turn. Nulls become part of plain keys, and the texts are ranked
    # and joined by the same keys, so that they are shuffled once.
    nulls = F.col("id").isNull().cast("int") + 2 * F.col("source").isNull().cast("int")
    keys = {"k_id": F.coalesce(F.col("id").cast("string"), F.lit("")), "k_source": F.coalesce(F.col("source"), F.lit("")), "k_null": nulls, "k_size": F.col("size")}
    names = list(keys)
    each = spans.withColumns(keys).groupBy(*names, "start").agg(F.collect_list(F.struct("pass", "spans", "taken")).alias("passes"))
    turns = each.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("start", "passes"))).alias("turns"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rest = [c for c in df.columns if c not in ("text", "n_chars")]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("doc_id").alias("id"), "text", "source", words.alias("size")).withColumns(keys)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("text")))
    got = own.withColumn("rank", rank).join(turns.hint("merge"), names).withColumn("turn", F.get("turns", F.col("rank") - 1))
    got = got.withColumn("pass", F.explode("turn.passes")).withColumns({"spans": F.col("pass.spans"), "taken": F.col("pass.taken")})
    # The words are a lambda's argument, so that they are listed once and not for every span.
    listed = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    text = F.transform(listed, lambda ws: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(ws, (s["first"] + 1).cast("int"), s["words"].cast("int")))), " "))[0]
    got = got.withColumn("text", F.when(F.col("taken") == F.col("k_size"), F.col("text")).otherwise(text))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    of = lambda c: (new[c].cast(df.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c)
    return got.select(*(of(c) for c in df.columns))
