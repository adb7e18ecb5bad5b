"""Full-catalog softmax gradients in tiles: no queries x items table is ever written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.vectors import TILE, matrix, sum_vectors, tiled
from kindred.session import pin


def log_normalizers(queries: DataFrame, items: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(qid, lse): log of the summed exponentials of a query's inner products with all items."""

    def local(q: pd.DataFrame, i: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        logits = matrix(q) @ matrix(i).T
        top = logits.max(axis=1)
        return pd.DataFrame(
            {"qid": q["qid"], "top": top, "rest": np.exp(logits - top[:, None]).sum(axis=1)}
        )

    parts = tiled(queries, items, local, "qid bigint, top double, rest double", sizes=sizes)
    # One entry per item tile: items / tile size of them.
    merged = parts.groupBy("qid").agg(
        F.max("top").alias("top"), F.collect_list(F.struct("top", "rest")).alias("parts")
    )
    total = F.aggregate(
        "parts", F.lit(0.0), lambda a, x: a + x["rest"] * F.exp(x["top"] - F.col("top"))
    )
    return merged.select("qid", (F.col("top") + F.log(total)).alias("lse"))


def softmax_rows(queries: DataFrame, items: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(side, id, g), still to be summed: side 0 are gradients of queries, side 1 of items.

    ``sizes`` are the numbers of queries and items where the caller knows them. Where these say that one
    tile holds all items it sees whole rows, so logarithms of sums need no pass of their own.
    """
    schema = "side int, id bigint, g array<double>"

    def rows(q: pd.DataFrame, i: pd.DataFrame, p: np.ndarray, h: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "side": np.repeat([0, 1], [len(q), len(i)]),
            "id": np.concatenate([q["qid"], i["item"]]),
            "g": [*(p @ w), *(p.T @ h)],
        })

    def whole(q: pd.DataFrame, i: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        h, w = matrix(q), matrix(i)
        p = h @ w.T
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (q["t"].to_numpy() / p.sum(axis=1))[:, None]
        return rows(q, i, p, h, w)

    def local(q: pd.DataFrame, i: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        h, w = matrix(q), matrix(i)
        norm = matrix(q, "norm")
        return rows(q, i, np.exp(h @ w.T - norm[:, :1]) * norm[:, 1:], h, w)

    if sizes is not None and sizes[1] <= TILE:
        return tiled(queries, items, whole, schema, carry="t", sizes=sizes)
    lse = pin(log_normalizers(queries.select("qid", "vec"), items, sizes))
    carried = queries.join(lse, "qid").select("qid", "vec", F.array("lse", "t").alias("norm"))
    return tiled(carried, items, local, schema, carry="norm", sizes=sizes)


def softmax_gradient(queries: DataFrame, items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Gradients of sum_q t_q * logsumexp_i(h_q . w_i): (qid, g) and (item, g).

    ``queries`` is (qid, vec, t), ``items`` is (item, vec), ids are bigint.
    """
    summed = pin(sum_vectors(softmax_rows(queries, items).groupBy("side", "id"), "g", dim))
    return (
        summed.where(F.col("side") == 0).select(F.col("id").alias("qid"), "g"),
        summed.where(F.col("side") == 1).select(F.col("id").alias("item"), "g"),
    )
