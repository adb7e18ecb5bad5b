"""Quality classifier from trusted positives and unlabelled text (non-negative risk)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.llm.common import table

#: Bounds of the sample that the classifier is fitted on.
POSITIVES, UNLABELLED = 6_000, 12_000
THRESHOLD = 0.7
_SYMBOLS = "!|%$&*#@=<>_~^+\\/"


def features(text: str) -> np.ndarray:
    """Style of a whole text: kinds of characters, words, lines, repetition."""
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(data), 1)
    counts = np.bincount(np.minimum(data, 128), minlength=129)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    letters = max(upper + lower + counts[128], 1)
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    signed = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'»")
    capital = sum(1 for w in words if len(w) > 1 and w.isupper())
    bad = [sum(1 for w in words[i : i + 50] if w.isupper() or not w[-1].isalnum() and w[-1] not in ".,;:?)\"'»") for i in range(0, len(words), 50)]
    return np.array([
        upper / letters, digit / n, counts[32] / n, counts[10] / n, counts[128] / letters,
        (counts[46] + counts[44]) / m, *[counts[ord(c)] / m for c in _SYMBOLS],
        lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100,
        distinct / m, distinct / np.sqrt(m) / 30, again / m, len(lines) / m, len(set(lines)) / len(lines),
        signed / m, capital / m, max(bad, default=0) / 50, np.log1p(m) / 10, np.log1p(n) / 12, float(not words),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logit(self.inner, self.outer, self.shaped(x))[0], -30, 30)))

    def shaped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))])


def _logit(inner, outer, z):
    hidden = np.tanh(z @ inner)
    return hidden @ outer[:-1] + outer[-1], hidden


def _train(z: np.ndarray, positive: np.ndarray, prior: float, hidden: int, steps: int, seed: int):
    """Minimises prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)) with the logistic loss.

    Where the part in max() is below zero, the step goes up its gradient, as for risk estimates of
    this kind.
    """
    rng = np.random.default_rng(seed)
    inner, outer = rng.normal(0, 0.3, (z.shape[1], hidden)), rng.normal(0, 0.3, hidden + 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (inner, outer)]
    at_p, at_u = np.flatnonzero(positive), np.flatnonzero(~positive)
    for step in range(1, steps + 1):
        p, u = rng.choice(at_p, min(512, len(at_p))), rng.choice(at_u, min(1024, len(at_u)))
        rows = np.concatenate([p, u])
        g, h = _logit(inner, outer, z[rows])
        g = np.clip(g, -30, 30)
        sig = 1 / (1 + np.exp(-g))
        k = len(p)
        negative = np.log1p(np.exp(g))  # loss of calling a row bad
        rest = negative[k:].mean() - prior * negative[:k].mean()
        d = np.zeros(len(rows))
        slope = np.concatenate([-prior * sig[:k] / k, sig[k:] / len(u)])
        if rest >= 0:
            d[:k] = prior * (sig[:k] - 1) / k
            d += slope
        else:
            d -= slope
        grad_outer = np.concatenate([h.T @ d, [d.sum()]]) + 1e-4 * outer
        grad_inner = z[rows].T @ (np.outer(d, outer[:-1]) * (1 - h * h)) + 1e-4 * inner
        for w, grad, (first, second) in zip((inner, outer), (grad_inner, grad_outer), moments):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            w -= 0.01 * (1 - 0.9 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return inner, outer


def estimate_prior(z: np.ndarray, positive: np.ndarray) -> float:
    """Share of good rows among the unlabelled, from the two score distributions.

    A plain positive-against-unlabelled score orders the rows; where only good rows lie, the
    unlabelled have `prior` times the share of the positives. Averaged over the upper cuts, as the
    least ratio alone would lean on noise.
    """
    inner, outer = _train(z, positive, 0.5, 8, 400, 1)
    g = _logit(inner, outer, z)[0]
    p, u = np.sort(g[positive]), np.sort(g[~positive])
    cuts = np.quantile(p, np.linspace(0.1, 0.5, 30))
    ratio = (1 - np.searchsorted(u, cuts) / len(u)) / (1 - np.searchsorted(p, cuts) / len(p))
    return float(np.clip(ratio.mean(), 0.05, 0.98))


def fit(x: np.ndarray, positive: np.ndarray, hidden: int = 16, steps: int = 3000, seed: int = 7) -> Model:
    """Rows of features; `positive` marks the trusted ones, the others are unlabelled."""
    if positive.sum() < 2 or (~positive).sum() < 2:
        raise ValueError("a fit needs trusted positives and unlabelled rows")
    mean, scale = x[~positive].mean(axis=0), x[~positive].std(axis=0) + 1e-6
    shaped = Model(mean, scale, None, None, 0).shaped(x)
    prior = estimate_prior(shaped, positive)
    inner, outer = _train(shaped, positive, prior, hidden, steps, seed)
    return Model(mean, scale, inner, outer, prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt; a null doc_id is held out, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [features(t or "") for t in batch["text"]]
        yield pd.DataFrame({"positive": batch["positive"], "draw": batch["draw"], "x": rows})


def _draw(rows: DataFrame, most: int) -> DataFrame:
    """A few more than `most` rows, with `draw`, a hash of the row that they are chosen by."""
    n = rows.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *rows.columns), 1)
    share = (most + 6 * most**0.5 + 10) / max(n, 1)
    return rows.withColumn("draw", draw).where(F.col("draw") < int(2**63 * share) if share < 1 else F.lit(True))


def _least(texts: DataFrame, most: int) -> DataFrame:
    """Features of the `most` rows with the least draw; texts are described where they are."""
    described = texts.select("text", "positive", "draw").mapInPandas(_described, "positive boolean, draw long, x array<double>")
    return described.orderBy("draw", "x").limit(most)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fits on at most `positives` rows that are labelled good and `unlabelled` rows of text alone.

    Labels of held-out rows are left out before anything else. The rows are those with the least
    hashes of all, so reruns agree at every size. Fewer than two rows of either kind give no model.
    """
    trusted = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    trusted = _draw(trusted, positives).orderBy("draw", "doc_id").limit(positives).select("doc_id")
    texts = docs.select("doc_id", "text")
    good = _draw(texts.join(F.broadcast(trusted), "doc_id", "left_semi"), 2 * positives).withColumn("positive", F.lit(True))
    web = _draw(texts, unlabelled).withColumn("positive", F.lit(False))
    rows = _least(good, 2 * positives).unionByName(_least(web, unlabelled)).toPandas()
    positive = rows["positive"].to_numpy(bool)
    if positive.sum() < 2 or (~positive).sum() < 2:
        return None
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T, positive))  # the order of collected rows is not fixed
    return fit(x[order], positive[order])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` but those named so before, with held_out, score and predicted.

    Null texts are empty texts. An empty table gives an empty table. Without a model nothing speaks
    against a document: all get the score of the threshold.
    """
    def scored(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=float)
        if model is None:
            return pd.Series(THRESHOLD, index=text.index)
        return pd.Series(model.score(np.array([features(t or "") for t in text])))

    call = F.pandas_udf(scored, "double")
    kept = docs.drop("held_out", "score", "predicted")
    rows = kept.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", call(F.col("text")))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
