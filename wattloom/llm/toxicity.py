"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labelled; everything else is unlabelled and may be toxic too. With the
class prior pi the risk of a classifier g is pi R_p(+) + max(0, R_u(-) - pi R_p(-)): the part of the
unlabelled risk that toxic texts cause is taken out, and where that would drive the rest
below zero, the gradient step goes against it. Small numpy classifiers over hashed features of words
are trained this way on a bounded sample and their mean scores every text inside Spark tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_texts
from wattloom.session import materialize

#: The classifiers and their features are fitted on a sample of about so many texts at most; scoring covers everything.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 12_000
MAX_FEATURES = 20_000
#: Least gain of a feature, in nats of evidence; rarer coincidences than that are left to chance.
MIN_GAIN = 9.0
PREFIXES = range(3, 9)
EXTRA_WORDS = 30
WORD = re.compile(r"\w+")
CACHED_WORDS = 400_000


def word_features(word: str) -> list[str]:
    """The whole word and its beginnings: inflected and compound forms share the latter."""
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) >= k]]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(positive, feature, docs): in how many texts of the batch each feature stands."""
    for batch in batches:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for positive, text in zip(batch["positive"], batch["text"], strict=True):
            seen: set[str] = set()
            for w in set(WORD.findall((text or "").lower())):
                seen.update(word_features(w))
            counts[bool(positive)].update(seen)
        for positive, c in counts.items():
            if c:
                yield pd.DataFrame({"positive": positive, "feature": list(c), "docs": list(c.values())})


class _Lookup(dict):
    """Numbers of the chosen features of a word, remembered for a bounded number of words."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        got = tuple(self.number[f] for f in word_features(word) if f in self.number)
        self[word] = got
        return got


def _active(text: str | None, lookup: _Lookup) -> tuple[list[int], list[float]]:
    """Chosen features of the whole text and their density, in per cent of its words (and of some words more).

    A random composition looks like a toxic word now and then in any long text, so density counts, not presence.
    """
    words = WORD.findall((text or "").lower())
    found: Counter = Counter()
    for got in map(lookup.__getitem__, words):
        if got:
            found.update(got)
    unit = 100 / (len(words) + EXTRA_WORDS)
    return list(found), [c * unit for c in found.values()]


def _rows(number: dict[str, int]):
    def make():
        lookup = _Lookup(number)

        def work(texts):
            pairs = [_active(t, lookup) for t in texts]
            return {"active": [a for a, _ in pairs], "value": [v for _, v in pairs]}

        return work

    return make


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Rows of active feature numbers and their values, for weighted sums and gradients."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], n: int):
        self.n = n
        self.rows = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        self.cols = np.fromiter((c for a, _ in rows for c in a), np.int64, len(self.rows))
        self.values = np.fromiter((x for _, v in rows for x in v), np.float64, len(self.rows))
        self.size = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols] * self.values, self.size)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows] * self.values, self.n)


def nn_pu_fit(
    positive: Sparse, unlabelled: Sparse, prior: float, seed: int, steps: int = 300, rate: float = 0.1, decay: float = 2e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam on random rows' weights.

    ``seed`` draws a bootstrap weight for every row, so that classifiers of one ensemble differ.
    """
    rng = np.random.default_rng(seed)
    wp, wu = rng.exponential(size=positive.size), rng.exponential(size=unlabelled.size)
    wp, wu = wp / max(wp.sum(), 1e-12), wu / max(wu.sum(), 1e-12)
    w, b = np.zeros(positive.n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(positive.n + 1), np.zeros(positive.n + 1)
    for step in range(1, steps + 1):
        sp, su = _sigmoid(positive.dot(w) + b), _sigmoid(unlabelled.dot(w) + b)
        rest = wu @ -np.log1p(-np.clip(su, 0, 1 - 1e-12)) - prior * (wp @ -np.log1p(-np.clip(sp, 0, 1 - 1e-12)))
        gp_plus, gp_minus, gu_minus = -prior * wp * (1 - sp), prior * wp * sp, wu * su
        if rest >= 0:
            gp, gu = gp_plus - gp_minus, gu_minus
        else:  # overfitted: only raise the risk that fell below zero
            gp, gu = gp_minus, -gu_minus
        grad = np.append(positive.back(gp) + unlabelled.back(gu) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def _scored(number: dict[str, int], weights: np.ndarray, bias: np.ndarray, column: str):
    def make():
        lookup = _Lookup(number)

        def work(texts):
            rows = Sparse([_active(t, lookup) for t in texts], weights.shape[1])
            return {column: np.mean([_sigmoid(rows.dot(w) + b) for w, b in zip(weights, bias, strict=True)], axis=0)}

        return work

    return make


class Model:
    """Chosen features with the weights of all classifiers; its size is bounded by ``MAX_FEATURES``."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, bias: np.ndarray, prior: float):
        self.number, self.weights, self.bias, self.prior = number, weights, bias, prior

    def with_score(self, docs: DataFrame, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
        """Rows of ``docs`` with the score of the whole text; null and empty texts get that of a text without features."""
        return map_texts(docs, text, _scored(self.number, self.weights, self.bias, column), f"`{column}` double", keep)


def _share(most: int, count: int) -> float:
    return min(1.0, most / max(count, 1))


def _sampled(doc: str, share: float) -> Column:
    return F.pmod(F.xxhash64(F.col(doc), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def fit(
    docs: DataFrame, positives: DataFrame, prior: float, doc_id: str = "doc_id", text: str = "text",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, classifiers: int = 3,
) -> Model:
    """Train on the texts of ``docs``; ``positives`` lists the ids of the confirmed toxic ones, ``prior`` the toxic share of all.

    About ``max_positive`` toxic texts and, from all texts, toxic ones among them, ``max_unlabelled`` others for the unlabelled
    pool are drawn by a hash of the id: the risk takes the pool for a sample of everybody, as ``prior`` does.
    Features must stand in a few toxic texts and be more frequent there than elsewhere. Without any toxic
    text the model gives every text the prior.
    """
    body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    ids = positives.select(F.col(doc_id).alias("doc"), F.lit(True).alias("positive")).where("doc is not null").distinct()
    p_share, u_share = _share(max_positive, ids.count()), _share(max_unlabelled, body.count())
    # as many ids as texts are drawn at most, so they can be broadcast and no text is shuffled to find its label
    few = F.broadcast(ids.where(_sampled("doc", max(p_share, u_share))))
    drawn = body.where(_sampled("doc", max(p_share, u_share))).join(few, "doc", "left")
    marked = drawn.withColumn("positive", F.coalesce("positive", F.lit(False)))
    sample = materialize(
        marked.withColumns({"pool": F.coalesce(_sampled("doc", u_share), F.lit(False)), "positive": F.col("positive") & _sampled("doc", p_share)})
        .where(F.col("positive") | F.col("pool")).select("positive", "pool", "text"),
        "toxicity-sample",
    )
    counts = sample.groupBy("positive").count().collect()
    p = sum(r["count"] for r in counts if r["positive"])
    u = sum(r["count"] for r in counts if not r["positive"])
    if not p or not u:
        return Model({}, np.zeros((1, 0)), np.array([np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))]), prior)
    per_feature = (
        sample.mapInPandas(_features, "positive boolean, feature string, docs long").groupBy("feature").agg(
            F.sum(F.when(F.col("positive"), F.col("docs")).otherwise(0)).alias("p"),
            F.sum(F.when(F.col("positive"), 0).otherwise(F.col("docs"))).alias("u"),
        )
    )
    least = max(3, int(0.003 * p))
    lift = (F.col("p") / p) / ((F.col("u") + 1) / u)
    # the gain of a feature is how many more toxic texts it marks than its frequency elsewhere explains
    gain = F.col("p") * F.log(lift)
    chosen = per_feature.where((F.col("p") >= least) & (lift >= 2) & (gain >= MIN_GAIN)).orderBy(gain.desc(), "feature").limit(max_features)
    number = {r["feature"]: k for k, r in enumerate(chosen.select("feature").collect())}
    rows = map_texts(sample, "text", _rows(number), "active array<int>, value array<double>", ["positive", "pool"]).collect()
    positive = Sparse([(r["active"], r["value"]) for r in rows if r["positive"]], len(number))
    unlabelled = Sparse([(r["active"], r["value"]) for r in rows if r["pool"]], len(number))
    fits = [nn_pu_fit(positive, unlabelled, prior, seed) for seed in range(classifiers)]
    return Model(number, np.array([w for w, _ in fits]), np.array([b for _, b in fits]), prior)


def prior_of(labels: DataFrame, toxic: str = "toxic") -> float:
    """Share of toxic rows among the labelled ones, kept off 0 and 1; 0.1 if there are none."""
    row = labels.agg(F.count(toxic).alias("n"), F.sum(F.col(toxic).cast("long")).alias("t")).first()
    return min(max((row["t"] or 0) / row["n"], 0.001), 0.9) if row["n"] else 0.1
