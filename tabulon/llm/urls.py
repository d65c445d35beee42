"""URL filters: allow and block rules, then gradient-boosted trees on lexical features.

Everything that touches rows is a DataFrame expression. Host and path are cut out by position; the longest
fitting rule decides; urls without one get the verdict of the trees. The features are lengths, depth, digit ratio, host
entropy, counts of labels, hyphens and parameters, and smoothed block rates of host suffixes and of file suffixes. These rates are counted
over all labelled urls, in BUCKETS hashed buckets, so that no suffix is left out; rows that train the trees get the
rates of the other hosts' urls (hosts are dealt into FOLDS by a hash), which keeps a row's own label out of its features. The trees are trained on a bounded sample of labelled urls by histogram splits (logistic loss) on the driver,
and become sums of CASE expressions, so that scoring stays inside generated code.

The tables hold no labels for urls, so :func:`seed_labels` labels them by a fixed list of words in their hosts; words
themselves are no feature. Null urls and urls without ``://`` have an empty host and path, fit no rule and are judged
by their features like the others. Rows are independent; repeated rows give repeated results and an empty table an
empty one; without labels of both kinds the trees allow everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of hosts that label a url as unwanted.
SEED_WORDS = [
    "ads", "adserver", "bet", "bets", "betting", "bingo", "casino", "cheap", "cialis", "click", "crypto", "farm", "free", "jackpot", "loan", "loans",
    "lottery", "malware", "phish", "pills", "poker", "porn", "replica", "spam", "track", "tracker", "viagra", "warez", "win", "xxx",
]
#: Labelled urls that train the trees at most: those of the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 30, 3, 0.3, 32, 5
#: Buckets of hashed suffixes, folds of hosts, and urls' worth of prior in a rate.
BUCKETS, FOLDS, PRIOR = 4096, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path, query


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, and the beginning of a path from its first slash on."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.text.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest if "/" in self.text else "")


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls. The list is part of the program: a CASE expression."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _entropy(x: Column) -> Column:
    """Bits a character of the string's own distribution."""
    letters = F.split(x, "")
    n = F.greatest(F.length(x), F.lit(1)).cast("double")
    share = lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy", "parameters", "host_rate", "file_rate"]


def lexical(df: DataFrame, url: Column) -> DataFrame:
    """``df`` with host, path, the suffixes, and the features that need no training."""
    host, path, query = parts(url)
    df = df.withColumns({"_url": F.coalesce(url, F.lit("")), "_host": host, "_path": path, "_query": query})
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    slashes = F.length("_path") - F.length(F.replace("_path", F.lit("/"), F.lit("")))
    return df.withColumns({
        "url_length": F.length("_url").cast("double"), "host_length": F.length("_host").cast("double"), "path_length": F.length("_path").cast("double"),
        "depth": slashes.cast("double"), "labels": F.size(F.split("_host", r"\.")).cast("double"), "hyphens": (F.length("_host") - F.length(F.replace("_host", F.lit("-"), F.lit("")))).cast("double"),
        "digit_ratio": digits(F.col("_url")) / F.greatest(F.length("_url"), F.lit(1)).cast("double"), "host_digits": digits(F.col("_host")).cast("double"), "entropy": _entropy(F.col("_host")),
        "parameters": F.when(F.col("_query") == "", 0.0).otherwise(F.size(F.split("_query", "&")).cast("double")),
        "_host_suffix": F.substring_index("_host", ".", -2), "_file_suffix": F.regexp_extract("_path", r"\.([A-Za-z0-9]{1,8})$", 1),
    })


def seed_labels(df: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label): 1 where a part of the host is one of SEED_WORDS."""
    host = parts(F.col(url_col))[0]
    bad = F.exists(F.split(host, "[.-]"), lambda w: w.isin(SEED_WORDS))
    return df.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), bad.cast("int").alias("label"))


@dataclass
class Trees:
    """(feature, threshold, left, right) nodes or leaf values; rates of the buckets of host and file suffixes."""

    trees: list
    base: float
    rates: dict[str, np.ndarray]

    def score(self) -> Column:
        """Log-odds of block from the columns FEATURES."""

        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, low, high = node
            return F.when(F.col(name) <= threshold, grow(low)).otherwise(grow(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + grow(tree)
        return total

    def looked_up(self) -> dict[str, Column]:
        """The rate features; a table is one literal, which the optimiser folds."""
        table = lambda kind: F.from_json(F.lit(str([float(x) for x in self.rates[kind]])), "array<double>")
        return {f"{kind}_rate": F.element_at(table(kind), bucket(kind) + 1) if kind in self.rates else F.lit(0.0) for kind in ("host", "file")}


def bucket(kind: str) -> Column:
    return F.pmod(F.xxhash64(f"_{kind}_suffix"), F.lit(BUCKETS)).cast("int")


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), host), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """For host and file suffixes an array (bucket, fold, urls and blocked ones), counted over all labelled urls of the table."""
    features = lexical(labelled, F.col("url")).withColumn("_fold", fold(F.col("_host")))
    out = {}
    for kind in ("host", "file"):
        counts = np.zeros((BUCKETS, FOLDS, 2))
        grouped = features.groupBy(bucket(kind).alias("b"), "_fold").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
        for r in grouped.collect():  # BUCKETS * FOLDS rows at most
            counts[r.b, r[1]] = r.n, r.y
        out[kind] = counts
    return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from (url, label) rows. The sample of distinct urls is bounded; it and the suffixes' counts are all that the driver sees."""
    labelled = labelled.filter(F.col("url").isNotNull() & F.col("label").isin(0, 1))
    rows = labelled.distinct().withColumn("h", F.xxhash64("url", "label")).orderBy("h", "url", "label").limit(sample)
    plain = FEATURES[:-2]
    got = lexical(rows, F.col("url")).select("label", fold(F.col("_host")), bucket("host"), bucket("file"), *plain).collect()
    y = np.array([r[0] for r in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Trees([], -1.0, {})
    prior = float(y.mean())
    rate = lambda c: np.round((c[..., 1] + PRIOR * prior) / (c[..., 0] + PRIOR), 6)
    counts = suffix_counts(labelled)
    folds = np.array([r[1] for r in got])
    apart = [rate((c.sum(axis=1, keepdims=True) - c)[[r[i] for r in got], folds]) for i, c in ((2, counts["host"]), (3, counts["file"]))]
    x = np.column_stack([np.array([r[4:] for r in got], dtype=np.float64), *apart])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    base = float(np.log(y.sum() / (len(y) - y.sum())))
    z, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, depth: int):
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        leaf = round(float(-RATE * total_g / (total_h + 1.0)), 6)
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            for f in range(x.shape[1]):
                b, m = binned[rows, f], len(cuts[f]) + 1
                gs, hs, n = (np.cumsum(np.bincount(b, weights=w, minlength=m))[:-1] for w in (g, h, np.ones(len(rows))))
                if not len(gs):
                    continue
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            z[rows] += leaf
            return leaf
        _, f, k = best
        low = binned[rows, f] <= k
        return FEATURES[f], float(cuts[f][k]), grow(rows[low], depth + 1), grow(rows[~low], depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        gradient, hessian = p - y, p * (1 - p)
        trees.append(grow(np.arange(len(y)), 0))
    return Trees(trees, base, {kind: rate(c.sum(axis=1)) for kind, c in counts.items()})


def judge(df: DataFrame, trees: Trees, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): ``score`` is the probability of block that the trees give."""
    df = lexical(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_given")), F.col("_given")).withColumns(trees.looked_up())
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    df = df.withColumns({"rule": rule, "_ruled": verdict, "score": F.round(1 / (1 + F.exp(-trees.score())), 6)})
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return df.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("_ruled", own).alias("verdict"), "score")
