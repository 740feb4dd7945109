"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; a sample of all learnable texts, labelled or not, is the unlabelled set. A
linear model over the presence of words and word beginnings is fitted in numpy by Adam on the estimate pi*R_p(+) + max(0, R_u(-) - pi*R_p(-)) with
the logistic loss; where the corrected part turns negative its gradient is reversed. The class prior pi is the share of
toxic rows among labelled, learnable rows.

The fit uses at most ``max_positive`` positives and ``max_unlabelled`` texts, the first by a hash of their ids, and
``max_features`` features chosen by a G-test. Scoring covers every whole text and uses the text alone. Null and empty text
have no words and get the model's base rate. Repeated rows get equal scores; labels of a repeated id count as toxic if
any is. Without a positive or an unlabelled text the model scores 0 everywhere. Extra columns, whatever their names, are
ignored by the query and kept by the stage; an empty table gives no rows.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """Words; beginnings of four and five letters of longer ones (inflected and compound insults), also by how many words share them."""
    words = set(WORD.findall(text.lower())) if text else set()
    begun = Counter(w[:4] for w in words if len(w) > 4)
    begun.update(w[:5] for w in words if len(w) > 5)
    for w, n in begun.items():
        words.add(f"^{w}")
        if n > 1:
            words.add(f"^{w}+")
        if n > 3:
            words.add(f"^{w}++")
    return words


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0

    def score(self, text: str | None) -> float:
        x = self.bias + math.fsum(self.weights[w] for w in features(text) & self.weights.keys())
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))


def choose(in_positive: dict[str, int], in_unlabelled: dict[str, int], n_positive: int, n_unlabelled: int, most: int) -> list[str]:
    """Features that positives have more often, best first, by the G statistic of their document counts."""

    def gain(w: str) -> float:
        a, b = in_positive[w], in_unlabelled.get(w, 0)
        p, q, m = (a + 0.5) / (n_positive + 1), (b + 0.5) / (n_unlabelled + 1), (a + b + 1) / (n_positive + n_unlabelled + 2)
        return 2 * (a * math.log(p / m) + b * math.log(q / m)) if p > q else 0.0

    # 24 is the one in a million point of the statistic: among some 100,000 words, few pass it by chance.
    scored = {w: g for w in in_positive if (g := gain(w)) >= 24}
    return sorted(scored, key=lambda w: (-scored[w], w))[:most]


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """R_u(-) - prior * R_p(-), and the gradients of prior * R_p(+) and of that difference, under the logistic loss."""
    sp, su = 1 / (1 + np.exp(-(xp @ theta))), 1 / (1 + np.exp(-(xu @ theta)))
    # Calling a text clean costs -log(1 - s), with slope s; calling it toxic has slope s - 1.
    negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
    positive = prior * (xp.T @ (sp - 1)) / len(xp)
    cost = prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean() - np.log1p(-np.minimum(su, 1 - 1e-6)).mean()
    return cost, positive, negative


def direction(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """The gradient that a step goes against; reversed, for the corrected part alone, where that part is negative."""
    cost, positive, negative = risk(theta, xp, xu, prior)
    return positive + negative if cost >= 0 else -negative


def fit(positive: list[list[str]], unlabelled: list[list[str]], prior: float, chosen: list[str], steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Rows are lists of the features that each text has, all of them among ``chosen``."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model()
    place = {w: i for i, w in enumerate(chosen)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for i, row in enumerate(rows):
            x[i, [place[w] for w in row]] = 1
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    theta = np.zeros(len(chosen) + 1, np.float32)
    theta[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = direction(theta, xp, xu, prior)
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({w: float(theta[i]) for w, i in place.items()}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, max_positive: int = 3000, max_unlabelled: int = 6000, max_features: int = 1024) -> Model:
    """Fit on rows whose crc32 fold (of 5) isn't ``held_out``; None learns from all."""
    learn = F.lit(True) if held_out is None else fold("doc_id", 5) != held_out
    label = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = label.agg(F.avg("toxic")).first()[0] or 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    positive = label.where("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id", F.lit(1).alias("p"))
    unlabelled = docs.where(F.col("doc_id").isNotNull() & learn).select("doc_id").orderBy(*order).limit(max_unlabelled).select("doc_id", F.lit(0).alias("p"))
    ids = positive.unionByName(unlabelled)  # at most max_positive + max_unlabelled rows

    @F.pandas_udf("array<string>")
    def listed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: sorted(features(x)))

    # Rows of one id may repeat without bound, so one text is kept for each id.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
    sample = staged(sample.select("doc_id", "p", listed("text").alias("w")), "toxic-sample")
    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    if len(sizes) < 2:
        return Model()
    least = max(3, sizes[1] // 500)
    counts = sample.select(F.explode("w").alias("w"), "p").groupBy("w").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
    table = counts.where(f"a >= {least} and a * {sizes[0]} > b * {sizes[1]}").toLocalIterator()
    seen = [(r["w"], r["a"], r["b"]) for r in table]
    chosen = choose({w: a for w, a, _ in seen}, {w: b for w, _, b in seen}, sizes[1], sizes[0], max_features)
    known = F.array(*[F.lit(w) for w in chosen]) if chosen else F.expr("cast(array() as array<string>)")
    rows = sample.select("doc_id", "p", F.array_intersect("w", known).alias("w")).orderBy("doc_id", "p").collect()
    return fit([list(r["w"]) for r in rows if r["p"]], [list(r["w"]) for r in rows if not r["p"]], float(share), chosen)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(model.score, na_action=None).astype("float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: id, fold, score and prediction of every row."""
    model = train(docs, labels)
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stage: the rows of ``docs`` that the model doesn't reject, with their columns."""
    model = train(docs, labels, held_out=None)
    return docs.where(score_column(model, F.col("text")) < 0.5)
