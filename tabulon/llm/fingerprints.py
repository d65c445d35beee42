"""Document fingerprints from closed syncmers, as DataFrame expressions only.

A text is read as units: runs of at most UNIT characters without white space, and of longer runs the UNIT characters at every
offset, so that units depend on nothing but their own run's characters nearby. Every unit has a 64-bit hash, and every
pair of neighbouring units one made from theirs. A k-mer of K units is an anchor if the smallest of its K - 1 pair hashes is
its first or its last: that depends on the k-mer alone, so an edit changes anchors only where it touches them. A text of
fewer than K units has one anchor, made from all of them.

Two texts are matched by all their anchors: their likeness is the Jaccard similarity of the sets of anchor hashes, exact and without a
cap, and ``placed`` counts the anchors that stand at the same place (unit number) in both. The fingerprint as text is a
short form, the MOST smallest anchor hashes; equal texts have equal ones.

Null and empty texts, and texts of white space, have no anchor, an empty fingerprint, and likeness 1 to one another and 0 to all else.
Repeated ids follow each other in an order by the text's hash; rows with a null id have no neighbour, so an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UNIT, K, MOST = 8, 4, 96
#: Documents whose neighbours are found in one task, and quantiles of the ids between which these are dealt evenly by value.
RUN, QUANTILES = 256, 256
#: Runs whose first ids are sent to all tasks; above, they are joined by a shuffle.
SMALL = 100_000


#: Matches each unit as group 1, and in all the unit if its run ends with it, else the unit's first character.
_STARTS = "(?=(\\S{1,%d}+))(?:\\1(?!\\S)|\\S)" % UNIT


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_STARTS), F.lit(1))


def _hashes(text: Column) -> Column:
    return F.transform(_units(text), lambda u: F.xxhash64(u))


def _pairs(h: Column) -> Column:
    return F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))


def _short(h: Column) -> Column:
    """The hash of the one anchor of a text of fewer than K units."""
    return F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))


def anchors(df: DataFrame, text: Column, into: str) -> DataFrame:
    """``df`` with the column ``into``: array of (at, hash) anchors of ``text`` in order."""
    h, p = f"_{into}_h", f"_{into}_p"
    df = df.withColumn(h, _hashes(text))
    df = df.withColumn(p, _pairs(F.col(h)))
    # From here a k-mer is K - 1 = 3 neighbouring pairs.
    found = F.transform(F.filter(F.sequence(F.lit(1), F.size(h) - 3), lambda i: _edge(p, i)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.get(p, i - 1), F.get(p, i + 1)).alias("hash")))
    short = F.array(F.struct(F.lit(1).alias("at"), _short(F.col(h)).alias("hash")))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return df.withColumn(into, F.when(F.size(h) >= K, found).when(F.size(h) > 0, short).otherwise(none)).drop(h, p)


def _met(df: DataFrame, h: str, before: Column, whole: Column, into: str) -> DataFrame:
    """``df`` with ``into`` and ``<into>_at``, arrays of the anchor hashes of the unit hashes ``h`` and of hashes of these with their places, counted from
    ``before``. ``whole``: whether ``h`` is a text's beginning, so that few units have one anchor."""
    p, c = f"_{into}_p", f"_{into}_c"
    df = df.withColumn(p, _pairs(F.col(h)))
    first = F.slice(p, F.lit(1), F.greatest(F.size(h) - F.lit(K - 1), F.lit(0)))

    def anchor(x: Column, i: Column) -> Column:
        inner, last = F.get(p, i + 1), F.get(p, i + 2)
        return F.when((inner >= x) | (inner >= last), F.xxhash64(x, last))

    few = whole & (F.size(h) < K) & (F.size(h) > 0)
    df = df.withColumn(c, F.when(few, F.array(_short(F.col(h)))).otherwise(F.transform(first, anchor)))
    at = F.transform(c, lambda x, i: F.when(x.isNotNull(), F.xxhash64(before + i, x)))
    return df.withColumns({into: F.array_compact(c), f"{into}_at": F.array_compact(at)}).drop(p, c)


def _edge(p: str, i: Column) -> Column:
    first, inner, last = F.get(p, i - 1), F.get(p, i), F.get(p, i + 1)
    return (inner >= first) | (inner >= last)


def sketch(hashes: Column) -> Column:
    """The short form of a text's distinct anchor hashes: sorted array of the MOST smallest."""
    return F.slice(F.sort_array(hashes), 1, MOST)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from the distinct anchor hashes of two texts."""
    # Without a condition or a lambda the intersection is compiled, and made once.
    common, none = F.size(F.array_intersect(a, b)), ((F.size(a) + F.size(b)) == 0).cast("int")
    return (common + none) / (F.size(a) + F.size(b) - common + none).cast("double")


def placed(a: Column, b: Column) -> Column:
    """The number of anchors that stand at the same place in two texts."""
    at = lambda x: F.transform(x, lambda p: F.xxhash64(p["at"], p["hash"]))
    return F.size(F.array_intersect(at(a), at(b)))


def written(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def ranges(df: DataFrame, id_col: str) -> Column | None:
    """The number of an id's range, in the order of ids, of which each holds about RUN rows; None without rows. Ids are cut at up to QUANTILES of their
    quantiles and evenly by value in between, so that outliers and gaps spoil one part of QUANTILES at most."""
    n, low, high = df.agg(F.count(id_col), F.min(id_col), F.max(id_col)).first()
    if not n:
        return None
    parts = min(QUANTILES, math.ceil(n / RUN))
    cuts = df.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    edges = sorted({low, *cuts}) + [high + 1]
    each = math.ceil(n / parts / RUN)
    width = [max(1, -(-(b - a) // each)) for a, b in zip(edges, edges[1:])]
    whole = lambda xs: F.from_json(F.lit(str(list(xs))), "array<bigint>")
    at = F.size(F.filter(whole(edges[:-1]), lambda e: e <= F.col(id_col)))
    return ((at - 1) * each + F.floor((F.col(id_col) - F.get(whole(edges), at - 1)) / F.get(whole(width), at - 1))).cast("bigint")


def with_next(df: DataFrame, id_col: str, payload: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``next_<column>`` for each payload column: the row of the next lower id, and for the lowest id
    that of the highest. Ids are dealt into :func:`ranges`; each range's highest row also goes to the range above, so that
    one window inside the ranges is enough. Repeated ids follow each other in an order by the payload's
    hash; rows with a null id have null neighbours. ``made`` adds columns, which the payload may name too, where the rows of a range are together, so that they
    aren't shuffled."""
    full = made(df) if made else df
    plain = full.withColumns({f"next_{c}": F.lit(None).cast(full.schema[c].dataType) for c in payload})
    run = ranges(df, id_col)
    if run is None:
        return plain
    tops = df.filter(F.col(id_col).isNotNull()).groupBy(run.alias("_run")).agg(F.max(id_col).alias("_top"))
    # The range above each range that has rows; the highest range's top goes below the lowest one.
    above = F.lead("_run").over(Window.orderBy("_run"))
    tops = tops.withColumn("_above", F.coalesce(above, F.lit(-1).cast("bigint"))).select("_top", "_above", F.col("_run").alias("_own"))
    tops = stored(tops)
    n_runs, lowest = tops.agg(F.count("*"), F.min("_own")).first()
    rows = df.filter(F.col(id_col).isNotNull()).withColumn("_run", run)
    rows = rows.join(F.broadcast(tops.drop("_own")) if n_runs <= SMALL else tops.drop("_own"), rows[id_col] == F.col("_top"), "left")
    targets = F.when(F.col("_top").isNull(), F.array(F.struct(F.col("_run").alias("r"), F.lit(False).alias("copy"))))
    goes = F.when(F.col("_above") >= 0, F.col("_above")).otherwise(F.lit(lowest))
    targets = targets.otherwise(F.array(F.struct(F.col("_run").alias("r"), F.lit(False).alias("copy")), F.struct(goes.alias("r"), F.lit(True).alias("copy"))))
    rows = rows.withColumn("_t", F.explode(targets)).withColumns({"_r": F.col("_t.r"), "_copy": F.col("_t.copy"), "_o": F.xxhash64(*(c for c in payload if c in df.columns))})
    if made:
        rows = made(rows.select(*df.columns, "_r", "_copy", "_o").repartition("_r").sortWithinPartitions("_r", "_copy", F.col(id_col).desc(), "_o"))
    # A copy stands behind all rows of its range.
    order = Window.partitionBy("_r").orderBy("_copy", F.col(id_col).desc(), "_o")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload}).filter(~F.col("_copy")).select(*full.columns, *(f"next_{c}" for c in payload))
    return rows.unionByName(plain.filter(F.col(id_col).isNull()))


def _parts(docs: DataFrame) -> DataFrame:
    """``docs`` (_text) with the anchors of the text (``own`` distinct, ``own_at`` with places) and what its edit keeps: ``_third``, the characters that go;
    ``_cut``, what is left of the run that the edit cuts; ``_units``, the number of units before that run, the last ones' hashes in ``_last``, and the
    numbers of anchors before it in ``own`` and ``own_at``, ``_kept`` and ``_kept_at``."""
    n = F.length("_text")
    docs = docs.withColumn("_third", F.floor(n / 3).cast("int")).withColumn("_left", F.substring(F.col("_text"), F.lit(1), n - F.col("_third")))
    docs = docs.withColumn("_head", F.regexp_extract("_left", "(?s)\\A.*\\s", 0))
    since = F.length("_head") + 1
    docs = docs.withColumns({"_cut": F.substring(F.col("_left"), since, n), "_h": _hashes(F.col("_head")), "_tail": _hashes(F.substring(F.col("_text"), since, n))}).drop("_left", "_head")
    docs = docs.withColumns({"_units": F.size("_h"), "_last": F.slice("_h", F.greatest(F.size("_h") - (K - 2), F.lit(1)), F.lit(K - 1))})
    docs = _met(docs, "_h", F.lit(0), F.lit(False), "kept").withColumn("_tail", F.concat("_last", "_tail")).drop("_h")
    docs = _met(docs, "_tail", _before(), F.col("_units") < K, "more").withColumn("kept", F.array_distinct("kept"))
    docs = docs.withColumns({"own": F.array_distinct(F.concat("kept", "more")), "own_at": F.concat("kept_at", "more_at"), "_kept": F.size("kept"), "_kept_at": F.size("kept_at")})
    return docs.drop("_tail", "kept", "kept_at", "more", "more_at")


def _before() -> Column:
    """The number of k-mers in the units before the cut run, which the last ones of these are anchors' places counted from."""
    return F.greatest(F.col("_units") - (K - 1), F.lit(0))


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, placed_edited, placed_next) of each row: the edited text has
    its last third of characters replaced by as many, or all, from the start of the next text in falling order of ids. Only texts are
    shuffled; anchors are found where they are compared, once for each text: the next row takes them over, and so does the edited text for the runs before the edit."""
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    docs = with_next(docs, "_id", ["_text", "own", "own_at"], _parts)
    none = F.array().cast("array<bigint>")
    docs = docs.withColumns({"other": F.coalesce("next_own", none), "other_at": F.coalesce("next_own_at", none), "_piece": F.substring(F.coalesce("next__text", F.lit("")), F.lit(1), F.col("_third"))})
    docs = docs.drop("next_own", "next_own_at", "next__text").withColumn("_new", F.concat("_last", _hashes(F.concat("_cut", "_piece"))))
    docs = _met(docs, "_new", _before(), F.col("_units") < K, "more")
    docs = docs.withColumns({"changed": F.array_distinct(F.concat(F.slice("own", F.lit(1), F.col("_kept")), "more")), "changed_at": F.concat(F.slice("own_at", F.lit(1), F.col("_kept_at")), "more_at")})
    n, (own, other, changed) = F.length("_text"), (F.col(c) for c in ("own", "other", "changed"))
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - F.col("_third")), F.col("_piece"))
    same = lambda a, b: F.size(F.array_intersect(a, b))
    return docs.select(
        F.col("_id").alias(id_col), n.cast("bigint").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        written(sketch(own)).alias("fingerprint"), written(sketch(changed)).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, other).alias("near_next"),
        same("own_at", "changed_at").alias("placed_edited"), same("own_at", "other_at").alias("placed_next"),
    )
