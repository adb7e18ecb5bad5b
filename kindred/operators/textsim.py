"""Text similarity of item documents: tf-idf and hashed features.

Equal documents are collapsed to one row first (``doc_key``), so a text shared by many items is
tokenized, weighted and compared once; items come back by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ids import plain_ids, restore_ids
from kindred.functions.numbers import quantize
from kindred.functions.text import tokens
from kindred.operators.pairs import gram, mirror
from kindred.operators.positions import group_positions
from kindred.operators.vectors import TILE, inner_product_topk
from kindred.session import pin


def distinct_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item_id, doc_key), (doc_key, doc, items)) from (item_id, doc)."""
    keyed = docs.withColumn("doc_key", F.sha2("doc", 256))
    texts = keyed.groupBy("doc_key").agg(
        F.first("doc").alias("doc"), F.count(F.lit(1)).alias("items")
    )
    return keyed.select("item_id", "doc_key"), texts


def term_frequencies(texts: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, items, token, tf). Explode feeds a partial count, so repeats merge early."""
    return (
        texts.select(key, "items", F.explode(tokens(F.col("doc"))).alias("token"))
        .groupBy(key, "items", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def tfidf(texts: DataFrame, n_items: int) -> DataFrame:
    """(doc_key, token, weight): tf * (ln((1+N)/(1+df)) + 1), rows scaled to unit length.

    ``texts`` is (doc_key, doc, items); a document counts once per item that carries it.
    """
    tf = term_frequencies(texts)
    df = tf.groupBy("token").agg(F.sum("items").alias("df"))
    idf = F.log((F.lit(1.0) + F.lit(n_items)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    raw = tf.join(df, "token").select("doc_key", "token", (F.col("tf") * idf).alias("raw"))
    norms = raw.groupBy("doc_key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "doc_key").select(
        "doc_key", "token", (F.col("raw") / F.col("norm")).alias("weight")
    )


def tfidf_similarity(weights: DataFrame) -> DataFrame:
    """(item, other, weight) over distinct documents; equal documents have similarity 1."""
    return mirror(gram(weights, "token", "doc_key", "weight"))


def hashed_features(texts: DataFrame, dimension: int = 128) -> DataFrame:
    """(doc_key, col, weight): signed token counts per hash column, unit length."""
    if dimension < 2:
        raise ValueError("the hashed dimension must be at least two")
    hashed = _hashed_row(dimension)(tokens(F.col("doc")))
    return texts.select("doc_key", F.explode(hashed).alias("entry")).select("doc_key", "entry.col", "entry.weight")


def _hashed_row(dimension: int) -> Callable[[Column], Column]:
    """Tokens of a text -> array of (col, weight): the text is summed where it stands, token by token."""

    def hashed(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()  # a token is hashed once in a batch
        digests = [hashlib.sha256(t).digest() for t in coded.dictionary.cast(pa.binary()).to_pylist()]
        cols = np.array([int.from_bytes(d[:4], "big") % dimension for d in digests], dtype=np.int64)
        signs = np.array([1.0 if d[4] & 1 else -1.0 for d in digests])
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells, cell = np.unique(np.repeat(np.arange(len(words)), sizes) * dimension + cols[at], return_inverse=True)
        sums = np.bincount(cell, weights=signs[at], minlength=len(cells))
        cells, sums = cells[sums != 0], sums[sums != 0]
        rows = cells // dimension
        norms = np.sqrt(np.bincount(rows, weights=sums * sums, minlength=len(words)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(words)))]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(cells % dimension), pa.array(sums / norms[rows])], ["col", "weight"])
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return F.arrow_udf(hashed, "array<struct<col:bigint,weight:double>>")


#: Dimension up to which a vector is put together from plain sums, which need no sorting.
WIDE = 256


def feature_vectors(features: DataFrame, dimension: int) -> DataFrame:
    """(doc_key, vec): dense rows; ``dimension`` bounds the collected map."""
    if dimension <= WIDE:
        grouped = features.groupBy("doc_key").agg(*[F.sum(F.when(F.col("col") == d, F.col("weight"))).alias(f"_d{d}") for d in range(dimension)])
        return grouped.select("doc_key", F.array(*[F.coalesce(f"_d{d}", F.lit(0.0)) for d in range(dimension)]).alias("vec"))
    entries = F.map_from_entries(F.collect_list(F.struct("col", "weight")))
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dimension - 1).cast("bigint")),
        lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)),
    )
    return features.groupBy("doc_key").agg(entries.alias("m")).select(
        "doc_key", dense.alias("vec")
    )


#: Times that tiles of documents may grow, and tile pairs that are left for tasks to share.
DOC_WIDER, DOC_MANY = 16, 64


def document_neighbours(
    item_docs: DataFrame, vectors: DataFrame, n: int = 100, tile: int = TILE
) -> DataFrame:
    """(item, other, weight, rank): top-n positive items by document vectors.

    A document contributes its first n + 1 items only, which is exact: further items with the
    same document rank behind these. Of equally similar documents the n + 1 with the lowest
    first item suffice for the same reason, so documents are keyed by that item.
    """
    item_docs = pin(item_docs)
    first = item_docs.groupBy("doc_key").agg(F.min("item_id").alias("head"))
    keyed = pin(vectors.join(first, "doc_key").select(F.col("head").alias("item"), "vec"))
    docs = inner_product_topk(
        keyed.select(F.col("item").alias("qid"), "vec"), keyed, n + 1, positive_only=True, tile=tile,
        wider=DOC_WIDER, many=DOC_MANY,
    ).select("qid", F.col("item").alias("near"), F.col("score").alias("weight"))
    members = pin(item_docs.join(first, "doc_key").select("item_id", "head"))
    by_id = Window.partitionBy("head").orderBy("item_id")
    leading = (
        members.withColumn("_r", F.row_number().over(by_id))
        .where(F.col("_r") <= n + 1)
        .select(F.col("head").alias("near"), F.col("item_id").alias("other"))
    )
    spread = docs.join(leading, "near").select("qid", "other", "weight")
    by_weight = Window.partitionBy("qid").orderBy(F.col("weight").desc(), F.col("other"))
    best = pin(spread.withColumn("_r", F.row_number().over(by_weight)).where(F.col("_r") <= n + 1))
    # The list of a document serves all its items, each without itself, so that single rows are not ranked again.
    listed = F.array_sort(F.collect_list(F.struct("_r", "other", "weight"))).alias("_near")
    lists = best.groupBy(F.col("qid").alias("head")).agg(listed)
    repeated = members.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("item_id")
    others = F.slice(F.filter("_near", lambda x: x["other"] != F.col("item_id")), 1, n)
    once = members.join(repeated, "item_id", "left_anti").join(lists, "head").select("item_id", F.posexplode(others).alias("_at", "_x")).select(
        F.col("item_id").alias("item"), F.col("_x.other").alias("other"), F.col("_x.weight").alias("weight"),
        (F.col("_at") + 1).cast("bigint").alias("rank"),
    )
    # Items that repeat take from the lists of all their rows.
    several = members.join(repeated, "item_id", "left_semi")
    per_item = several.join(best, several["head"] == best["qid"]).where(F.col("item_id") != F.col("other"))
    by_item = Window.partitionBy("item_id").orderBy(F.col("weight").desc(), F.col("other"))
    return once.unionByName(
        per_item.withColumn("rank", F.row_number().over(by_item).cast("bigint"))
        .where(F.col("rank") <= n)
        .select(F.col("item_id").alias("item"), "other", "weight", "rank")
    )


def _by_document(history: DataFrame, item_docs: DataFrame) -> DataFrame:
    return (
        history.join(item_docs.select("item_id", "doc_key"), "item_id")
        .groupBy("request_id", "doc_key")
        .agg(F.sum("value").alias("value"))
    )


def _profile(per_doc: DataFrame, weights: DataFrame) -> DataFrame:
    """(request_id, token, p): sum(v_i * T_i) over the documents of a request."""
    return (
        per_doc.join(weights, "doc_key")
        .groupBy("request_id", "token")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("p"))
    )


def near_documents(history: DataFrame, item_docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(request_id, doc_key, s): the profile sum(v_i * T_i) of a request against all documents."""
    profile = _profile(_by_document(history, item_docs), weights)
    return (
        profile.join(weights, "token")
        .groupBy("request_id", "doc_key")
        .agg(quantize(F.sum(F.col("p") * F.col("weight"))).alias("s"))
        .where(F.col("s") != 0)
    )


#: Documents per wanted one that the rarest tokens of a request may bring in for a first bound.
PROBE = 8
#: Twice the grid of scores.
GRAIN = 2e-9


#: Entries of documents, and of requests, that one task holds; entries of requests that are worth a task.
ENTRIES, WORTH = 1 << 22, 1 << 16


def best_documents(
    history: DataFrame, item_docs: DataFrame, weights: DataFrame, reach: DataFrame, probe: int = PROBE, entries: int = ENTRIES
) -> DataFrame:
    """(request_id, doc_key, s): exact scores of at least the ``reach`` best documents of every request.

    ``reach`` is (request_id, reach). A request travels as one row to each tile of documents, of ``entries``
    weights at most, and only what can be among its best there, ties included, and the documents of its
    history leave the tile; so neither pairs nor products travel.
    """
    terms = pin(weights.select("token").distinct().withColumn("term", F.monotonically_increasing_id()))
    listed = F.collect_list(F.struct("term", "weight"))
    docs = pin(weights.join(terms, "token").groupBy("doc_key").agg(listed.alias("entries")).withColumn("doc", F.monotonically_increasing_id()))
    per_doc = pin(_by_document(history, item_docs).join(docs.select("doc_key", "doc"), "doc_key").select("request_id", "doc", "value"))
    products = per_doc.join(docs.select("doc", "entries"), "doc").select("request_id", "value", F.explode("entries").alias("e"))
    profile = products.groupBy("request_id", "e.term").agg(F.sum(F.col("value") * F.col("e.weight")).alias("p"))
    own = per_doc.groupBy("request_id").agg(F.collect_list("doc").alias("own"))
    asked = pin(
        profile.groupBy("request_id").agg(F.collect_list(F.struct("term", "p")).alias("entries"))
        .join(own, "request_id").join(reach, "request_id", "left")
        .select("request_id", F.coalesce("reach", F.lit(0)).alias("reach"), "entries", "own")
    )
    wanted = asked.agg(F.sum(F.size("entries") + F.size("own"))).first()[0] or 0
    postings = docs.agg(F.sum(F.size("entries"))).first()[0] or 0
    parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tq, td = max(1, ceil(wanted / entries), min(4 * parts, ceil(wanted / WORTH))), max(1, ceil(postings / entries))
    kind = asked.schema["request_id"].dataType
    requests = plain_ids(asked, "request_id")

    def tiles(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = requests.select(
        F.pmod(F.xxhash64("request_id"), F.lit(tq)).cast("int").alias("tq"), tiles(td).alias("td"), "request_id", "reach",
        F.col("entries.term").alias("terms"), F.col("entries.p").alias("ps"), "own",
    )
    right = docs.select(
        tiles(tq).alias("tq"), F.pmod(F.xxhash64("doc"), F.lit(td)).cast("int").alias("td"), "doc", "doc_key",
        F.col("entries.term").alias("terms"), F.col("entries.weight").alias("ws"),
    )
    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, doc_key string, s double"

    def search(some: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        ids, keys, scores = [], [], []
        if len(some) and len(here):
            tile = _Tile(here)
            for row in some.itertuples(index=False):
                at, s = tile.best(row.terms, row.ps, row.own, row.reach, probe)
                ids.append(np.full(len(at), row.request_id, dtype=object))
                keys.append(tile.keys[at])
                scores.append(s)
        if not ids:
            return pd.DataFrame({"request_id": [], "doc_key": [], "s": []})
        return pd.DataFrame({"request_id": np.concatenate(ids), "doc_key": np.concatenate(keys), "s": np.concatenate(scores)})

    found = left.groupBy("tq", "td").cogroup(right.groupBy("tq", "td")).applyInPandas(search, schema)
    return restore_ids(found, {"request_id": kind}).withColumn("s", quantize(F.col("s"))).where(F.col("s") != 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Tile:
    """Documents of one task: weights by document and places by token."""

    def __init__(self, docs: pd.DataFrame):
        docs = docs.sort_values("doc", ignore_index=True)
        self.ids, self.keys = docs["doc"].to_numpy(), docs["doc_key"].to_numpy()
        self.sizes = docs["terms"].map(len).to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms, self.term = np.unique(np.concatenate(docs["terms"].to_numpy()), return_inverse=True)
        self.weights = np.concatenate(docs["ws"].to_numpy())
        self.df = np.bincount(self.term)
        self.places = np.cumsum(self.df) - self.df
        self.holders = np.repeat(np.arange(len(docs)), self.sizes)[np.argsort(self.term, kind="stable")]
        self.p = np.zeros(len(self.terms))

    def _holding(self, at: np.ndarray) -> np.ndarray:
        return self.holders[_ranges(self.places[at], self.df[at])]

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        if not len(docs):
            return np.zeros(0)
        sizes = self.sizes[docs]
        every = _ranges(self.starts[docs], sizes)
        return np.add.reduceat(self.p[self.term[every]] * self.weights[every], np.cumsum(sizes) - sizes)

    @staticmethod
    def _floor(scores: np.ndarray, reach: int) -> float | None:
        positive = scores[scores > 0]
        if reach <= 0:
            return np.inf
        return np.partition(positive, len(positive) - reach)[len(positive) - reach] if len(positive) >= reach else None

    def best(self, terms, ps, own, reach: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the ``reach`` best documents, ties included, and of those in ``own``.

        The rarest tokens bring in first documents, whose scores bound the last wanted one from below.
        Documents without the tokens before some token cannot reach that bound once the length of the rest
        of the profile falls under it, so frequent tokens, which come last, bring in documents only where
        the bound leaves them open.
        """
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        at, ps = at[held], ps[held]
        order = np.lexsort((at, self.df[at]))
        at, ps = at[order], ps[order]
        early = np.cumsum(self.df[at]) <= probe * reach
        self.p[at] = ps
        mine = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        mine = mine[self.ids[mine] == own]
        first = np.unique(np.concatenate([self._holding(at[early]), mine]))
        scores = self._scores(first)
        floor = self._floor(scores, reach)
        late = ~early
        if floor is not None:
            late &= np.sqrt(np.cumsum((ps * ps)[::-1])[::-1]) * (1 + 1e-12) + GRAIN >= floor
        second = np.setdiff1d(self._holding(at[late]), first)
        docs, scores = np.concatenate([first, second]), np.concatenate([scores, self._scores(second)])
        self.p[at] = 0.0
        floor = self._floor(scores, reach)
        if floor is not None:
            keep = scores >= floor - GRAIN  # scores this close can become equal
            keep[np.searchsorted(first, mine)] = True  # documents of the history are among the first
            docs, scores = docs[keep], scores[keep]
        return docs, scores


def own_scores(near: DataFrame, history: DataFrame, item_docs: DataFrame) -> DataFrame:
    """(request_id, item_id, score) of the history items: their own unit similarity is taken off."""
    placed = history.join(item_docs.select("item_id", "doc_key"), "item_id")
    return placed.join(near, ["request_id", "doc_key"], "left").select(
        "request_id", "item_id",
        quantize(F.coalesce("s", F.lit(0.0)) - F.col("value")).alias("score"),
    )


def factored_scores(near: DataFrame, history: DataFrame, item_docs: DataFrame) -> DataFrame:
    """(request_id, item_id, score): every non-zero score, one row per item."""
    others = near.join(item_docs.select("item_id", "doc_key"), "doc_key").join(
        history.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti"
    ).select("request_id", "item_id", F.col("s").alias("score"))
    own = own_scores(near, history, item_docs)
    return others.unionByName(own).where(F.col("score") != 0)


def factored_candidates(
    near: DataFrame, history: DataFrame, item_docs: DataFrame, k: int
) -> DataFrame:
    """(request_id, item_id, score): enough positive scores for an exact top k.

    An item in place j of the i-th best document has at least i + j - 2 better ones, and j - 1 more than all
    documents with a greater score have. Of these at most as many are in the history as it has rows, h. So
    only places up to k + h less the greater of both can matter, and exactly these pairs are looked up;
    ``item_docs`` is (item_id, doc_key, place).
    """
    rows = item_docs.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows"))
    reach = history.join(rows, "item_id", "left").groupBy("request_id").agg(
        (F.sum(F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1))) + k).alias("reach")
    )
    heads = item_docs.groupBy("doc_key").agg(
        F.min(F.when(F.col("place") == 1, F.col("item_id"))).alias("head"), F.count(F.lit(1)).alias("size")
    )
    best = Window.partitionBy("request_id").orderBy(F.col("s").desc(), F.col("head"))
    # Scores that differ by dust only count as equal, which leaves more items in.
    ahead = F.expr("sum(size) over (partition by request_id order by -s range between unbounded preceding and 1e-12D preceding)")
    docs = (
        near.where(F.col("s") > 0)
        .join(heads, "doc_key")
        .withColumns({"i": F.row_number().over(best), "ahead": F.coalesce(ahead, F.lit(0))})
        .join(reach, "request_id")
        .withColumn("open", F.least("size", F.col("reach") - F.greatest(F.col("i") - 1, F.col("ahead"))))
        .where(F.col("open") >= 1)
    )
    places = F.sequence(F.lit(1).cast("bigint"), F.col("open"))
    others = (
        docs.select("request_id", "doc_key", "s", F.explode(places).alias("place"))
        .join(item_docs, ["doc_key", "place"])
        .join(history.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
        .select("request_id", "item_id", F.col("s").alias("score"))
    )
    return others.unionByName(own_scores(near, history, item_docs))


def with_places(item_docs: DataFrame) -> DataFrame:
    """Add ``place``: the item's position among the items of its document, by id."""
    return group_positions(item_docs, ["doc_key"], [F.col("item_id")], "place")
