"""Toxicity by weak supervision.

1. Voters. A fixed lexicon of insults, and pattern voters (whole words and beginnings of words) mined from labelled
   training rows by smoothed log-odds. A voter fires when its word or beginning occurs in a text, else it abstains.
2. A generative label model. The voters label a bounded sample of all training documents, with and without a label. Each voter
   has a firing rate under either label; the rates and the documents' posterior are fitted by expectation-maximisation,
   started from the labels where there are any and from their share elsewhere. Pairs of voters whose firings stay
   correlated given the posterior share their weight, so that ten voters that always fire together don't count ten times.
3. A linear classifier (logistic regression on the presence of words and beginnings) is trained on the posterior
   labels of that sample, and its score is calibrated by two numbers on the labelled rows.

Training takes at most ``sample`` labelled rows (the smallest hashes of id and label) and ``unlabelled`` other documents (the smallest hashes
of the id), of rows with one id one; mining, voting and the features run in the executors, and what reaches the driver is bounded by these
numbers and by the number of features. Scoring reads every text once, whole, without a shuffle.

Null and empty texts have no features and get the score of the intercept. Null labels are not learned from, nor are
labels without a document; a document labelled twice counts once for each label. Without labels of both kinds,
the lexicon alone scores. Rows are independent when scored; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import reachable
from .common import chunks, drop_stored, sent, stored, tidy, unused

#: Common insults of English, German, French and Spanish, the lexicon voters.
LEXICON = [
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "dumb", "dumbass", "fool", "loser", "losers", "pathetic",
    "worthless", "useless", "disgusting", "scum", "trash", "garbage", "filth", "vermin", "clown", "jerk", "bastard", "bitch", "asshole", "shit",
    "fuck", "fucking", "crap", "damn", "hate", "kill", "ugly", "retard", "whore", "slut", "pig", "coward",
    "dumm", "dummkopf", "arschloch", "scheisse", "scheiße", "trottel", "abschaum", "schlampe", "hurensohn", "wertlos", "ekelhaft",
    "idiote", "imbécile", "connard", "salaud", "merde", "ordure", "pourriture", "débile", "stupide", "dégoûtant", "minable",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "mierda", "puta", "cabrón", "asqueroso", "inútil", "escoria", "payaso",
]
#: Weight of a lexicon word before any row is seen.
LEXICON_WEIGHT = 3.0
#: Lengths of the beginnings of words that are patterns.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Labelled rows and other documents that are learned from at most.
SAMPLE, UNLABELLED = 20_000, 10_000
#: Most mined voters, most features of the classifier, and rows in which a mined voter fires at least.
VOTERS, FEATURES, SUPPORT = 300, 4000, 3
#: Rows that training on the driver computes with at once, so that its arrays stay small beside the driver's heap.
BLOCK = 2000
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Words of a text, and their beginnings (marked with a star)."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return out


@dataclass
class Scorer:
    """Weights of the classifier; ``score`` is its calibrated probability."""

    weights: dict[str, float]
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    voters: list[str] = field(default_factory=list)
    rates: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def score(self, text: str | None) -> float:
        z = self.intercept
        if text:
            words = set(WORD.findall(text.lower()))
            found = self.weights.keys() & words
            for n in BEGINNINGS:
                found |= self.weights.keys() & {w[:n] + "*" for w in words if len(w) >= n}
            w = self.weights
            for x in sorted(found):
                z += w[x]
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


@dataclass
class LabelModel:
    """Firing rates of voters under label 0 and 1, their correlations given the label, and the label's share."""

    rates: np.ndarray
    share: np.ndarray
    correlations: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 20, threshold: float = 0.2) -> LabelModel:
        """votes: rows x voters of 0 and 1; start: a first guess of the posterior. Silence of a voter is no
        evidence: most toxic texts hold few of the patterns, so only firing votes count."""
        post, n = start.astype(np.float64), len(votes)
        fired, both = _dot(votes, np.ones(n)), _together(votes)
        weight = np.ones(votes.shape[1])
        correlations = np.eye(votes.shape[1])
        model = None
        for k in range(rounds):
            one, zero = post.sum(), (1 - post).sum()
            fired_one = _dot(votes, post)
            rates = np.stack([(fired - fired_one + 0.1) / (zero + 1.0), (fired_one + 0.1) / (one + 1.0)])
            rates = np.clip(rates, 1e-5, 1 - 1e-5)
            if k % 5 == 0:
                correlations = cls._correlations(both, fired, fired_one, post, rates)
                weight = 1 / np.where(np.abs(correlations) > threshold, np.abs(correlations), 0).sum(axis=1)
            model = cls(rates, np.array([zero / n, one / n]), correlations, weight)
            new = model.posterior(votes)
            if np.abs(new - post).max() < 1e-4:
                break
            post = new
        return model

    @staticmethod
    def _correlations(both: np.ndarray, fired: np.ndarray, fired_one: np.ndarray, post: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Correlation of the firings that is left when the label is known: the products of votes - (1 - post) rates[0] - post rates[1],
        summed over the rows, from the sums of the parts' products."""
        parts = {0: fired - fired_one, 1: fired_one}
        sides = {0: 1 - post, 1: post}
        cov = both.copy()
        for i in (0, 1):
            cov -= np.outer(parts[i], rates[i]) + np.outer(rates[i], parts[i])
            for j in (0, 1):
                cov += (sides[i] @ sides[j]) * np.outer(rates[i], rates[j])
        cov /= len(post)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = cov / np.outer(scale, scale)
        np.fill_diagonal(out, 1.0)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        silent = 0.5  # the prior of a row without any vote
        odds = np.log(self.rates[1]) - np.log(self.rates[0])
        z = np.concatenate([votes[a : a + BLOCK] @ (odds * self.weight) for a in range(0, len(votes), BLOCK)] or [np.zeros(0)])
        z += silent * np.log(self.share[1] / self.share[0] + 1e-9)
        z = np.where(votes.any(axis=1), z, np.minimum(z, -3.0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dot(votes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sum of ``by`` over the rows in which a voter fires, block by block."""
    return sum((votes[a : a + BLOCK].T @ by[a : a + BLOCK] for a in range(0, len(votes), BLOCK)), np.zeros(votes.shape[1]))


def _together(votes: np.ndarray) -> np.ndarray:
    """In how many rows two voters fire together, block by block."""
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for a in range(0, len(votes), BLOCK):
        block = votes[a : a + BLOCK].astype(np.float32)
        out += block.T @ block
    return out


def _odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return float(np.log((pos + 0.3) / (n_pos + 0.6)) - np.log((neg + 0.3) / (n_neg + 0.6)))


def _logistic(index: list[np.ndarray], target: np.ndarray, n: int, centre: np.ndarray, ridge: np.ndarray, rounds: int = 50, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on binary features; ``ridge`` pulls the weights to ``centre``.

    Newton steps, each solved by conjugate gradients scaled by the curvature's diagonal and shortened until the loss falls, up to a largest
    gradient of ``close``: the loss has one minimum, so that neither the order of sums nor rounding decides where the weights end."""
    blocks = []
    for a in range(0, len(index), BLOCK):
        part = index[a : a + BLOCK]
        rows = np.repeat(np.arange(len(part), dtype=np.uint16), [len(x) for x in part])
        blocks.append((len(part), rows, np.concatenate(part)))

    def evidence(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, weights=w[col], minlength=size) for size, row, col in blocks]) + w[n]

    def summed(by: np.ndarray) -> np.ndarray:
        out, a = np.zeros(n + 1), 0
        for size, row, col in blocks:
            out[:n] += np.bincount(col, weights=by[a : a + size][row], minlength=n)
            a += size
        out[n] = by.sum()
        return out

    start = np.append(centre, np.log((target.sum() + 0.5) / ((1 - target).sum() + 0.5)))
    pull = np.append(ridge, 1e-6)

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (pull * (w - start) ** 2).sum())

    w = start.copy()
    z = evidence(w)
    value = loss(w, z)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = summed(p - target) + pull * (w - start)
        if np.abs(slope).max() < close:
            break
        bend = p * (1 - p)
        scale = summed(bend) + pull
        step, rest = np.zeros(n + 1), -slope
        way = rest / scale
        size = rest @ way
        enough = 0.01 * size
        for _ in range(200):
            bent = summed(bend * evidence(way)) + pull * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            before, size = size, rest @ (rest / scale)
            if size < enough:
                break
            way = rest / scale + size / before * way
        along, part = evidence(step), 1.0
        while part > 1e-6 and loss(w + part * step, z + part * along) > value + 1e-4 * part * (slope @ step):
            part /= 2
        if part <= 1e-6:
            break
        w, z = w + part * step, z + part * along
        value = loss(w, z)
    return w[:n], float(w[n])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED
) -> Scorer:
    """A scorer from the labelled rows and a sample of ``docs``. Both must hold training rows only."""
    reachable(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    chosen = stored(known.withColumn("h", F.xxhash64("id", "y")).orderBy("h", "id", "y").limit(sample).select("id", "y"))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    others = plain.select("id").filter("id is not null").join(F.broadcast(chosen.select("id").distinct()), "id", "left_anti")  # ``sample`` rows at most
    others = others.distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(unlabelled).select("id", F.lit(-1).alias("y"))
    picked = stored(chosen.union(others))
    # One text for each id, so that the bound holds whatever the ids.
    found = plain.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text"))
    every = stored(found)
    rows = every.filter("y >= 0")

    def mine(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fired: tuple[Counter, Counter] = (Counter(), Counter())
        count = [0, 0]
        for batch in chunks(batches, "text"):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                fired[y].update(tokens(text))
                count[y] += 1
        names = [*(fired[0].keys() | fired[1].keys()), ""]
        got = [[*(c[x] for x in names[:-1]), n] for c, n in zip(fired, count)]
        for a in range(0, len(names), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 20_000], pa.string()), *(pa.array(g[a : a + 20_000], pa.int64()) for g in got)], names=["token", "neg", "pos"])

    summed = stored(rows.select("text", "y").mapInArrow(tidy(mine), "token string, neg bigint, pos bigint").groupBy("token").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    # The candidates for voters and features: those of the largest absolute log-odds in units of their error.
    total = summed.filter("token = ''")
    edge = summed.filter((F.col("token") == "") | F.col("token").isin(LEXICON) | (F.col("pos") + F.col("neg") >= SUPPORT))
    strength = F.abs(F.log((F.col("pos") + 0.3) / (F.col("neg") + 0.3)) - F.log((F.col("p") + 0.6) / (F.col("n") + 0.6))) * F.sqrt(F.least("pos", "neg") + 1) * F.log1p(F.greatest("pos", "neg"))
    share = total.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).first()
    n_neg, n_pos = (share.neg or 0, share.pos or 0) if share else (0, 0)
    if not n_neg or not n_pos:
        return Scorer(dict.fromkeys(LEXICON, LEXICON_WEIGHT), -3.0, voters=list(LEXICON))
    strength = edge.withColumn("p", F.lit(float(n_pos))).withColumn("n", F.lit(float(n_neg))).withColumn("s", strength).filter("token <> ''")
    top = strength.orderBy(F.desc("s"), "token").limit(FEATURES).select("token", "neg", "pos").collect()
    mined = [(r.token, _odds(r.pos, r.neg, n_pos, n_neg), r.pos, r.neg) for r in top]
    sure = sorted((m for m in mined if m[2] >= SUPPORT and m[1] > 2.0 and m[3] <= 0.02 * m[2] + 0.5), key=lambda m: (-m[2] + 20 * m[3], m[0]))
    voters = list(dict.fromkeys([*LEXICON, *(m[0] for m in sure[:VOTERS])]))
    features = list(dict.fromkeys([*voters, *(m[0] for m in mined)]))
    place = {x: i for i, x in enumerate(features)}

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "text"):
            found = [np.array(sorted(place[x] for x in place.keys() & tokens(t)), dtype=np.uint16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], names=["id", "y", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    got = every.mapInArrow(tidy(index), f"id {kind}, y int, found binary").collect()
    got.sort(key=lambda r: (r.id, r.y))
    for table in (summed, every, picked, chosen):
        drop_stored(table)
    y = np.array([r.y for r in got], dtype=np.float64)
    gold = y >= 0
    found = [np.frombuffer(r.found, dtype=np.uint16) for r in got]
    del got
    votes = np.zeros((len(found), len(voters)), dtype=np.uint8)
    for i, f in enumerate(found):
        votes[i, f[f < len(voters)]] = 1
    model = LabelModel.fit(votes, np.where(gold, np.clip(y, 0.05, 0.95), y[gold].mean()))
    post = model.posterior(votes)
    centre, ridge = np.zeros(len(features)), np.full(len(features), 3.0)
    centre[: len(LEXICON)], ridge[: len(voters)] = LEXICON_WEIGHT, 0.3
    w, b = _logistic(found, post, len(features), centre, ridge)
    weights = {x: round(float(w[i]), 5) for i, x in enumerate(features) if abs(w[i]) > 1e-3}
    scorer = Scorer(weights, b, voters=voters, rates=model.rates, correlations=model.correlations)
    z = np.array([b + w[f].sum() for f in found])
    scorer.slope, scorer.shift = _calibrate(z[gold], y[gold])
    return scorer


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from evidence to the labelled share, the slope kept positive."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z = np.clip(z, -15, 15)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = p * (1 - p) + 1e-6
        g = np.array([((p - target) * z).sum() + 1e-2 * (a - 1), (p - target).sum()])
        h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.1, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@functools.lru_cache(maxsize=1)
def _loaded(raw: bytes) -> Scorer:
    import pickle

    return pickle.loads(raw)


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score) of each row, or the columns ``keep`` instead of the id; a column of ``keep`` named ``score`` gives way."""
    import pickle

    names = [c for c in (keep or [id_col]) if c != "score"]
    own_text = unused("text", [*names, "score"])
    given = sent(df, pickle.dumps(scorer))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _loaded(given.value)
        for batch in chunks(batches, own_text):
            values = [own.score(t) for t in batch.column(own_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.float64())], names=[*names, "score"])

    run.clear = _loaded.cache_clear
    schema = StructType([*(df.schema[c] for c in names), StructField("score", DoubleType())])
    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias(own_text)).mapInArrow(tidy(run), schema)
