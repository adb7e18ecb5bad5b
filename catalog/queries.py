"""Queries with an exact SQL counterpart in oracles.py, and iterative ones without."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from kindred.functions.ids import decode_identifier, encode_identifier
from kindred.functions.numbers import clean_metadata, quantize
from kindred.functions.text import document, hash_column, hash_sign, tokens
from kindred.functions.times import micros
from kindred.operators import evaluate, fusion, pairs, recommend, scoring, sequences, split, textsim
from kindred.operators import contract, factor, graph, ranker, training
from kindred.operators.retrievers import item_space
from kindred.operators.vectors import embedding_neighbours, inner_product_topk, l2_normalize
from kindred.plans import hybrid
from kindred.plans.fitted import HISTORY, FittedModel, QueryBatch
from kindred.session import pin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 10


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: str):
    return quantize(F.col(column), 6).alias(column)


def big(column: str):
    return F.col(column).cast("bigint").alias(column)


# --------------------------------------------------------------------------- contract


@query
def normalize_purchases(spark, sf):
    return views.purchases(spark, sf, validate=True).select(
        "user_id", "item_id", "value", micros(F.col("timestamp")).alias("ts_us"), "l_orderkey"
    )


@query
def normalize_clicks(spark, sf):
    return views.clicks(spark, sf, validate=True).select(
        "user_id", "item_id", "value", micros(F.col("timestamp")).alias("ts_us"), "event_type",
        "event_id",
    )


@query
def violation_counts(spark, sf):
    """Users without a key, non-finite values and unreadable times, planted by expressions."""
    e = views.table(spark, sf, "events")
    dirty = e.select(
        F.when(F.col("user_id") % 50 == 0, F.lit("")).otherwise(
            F.col("user_id").cast("string")).alias("account"),
        F.when(F.col("event_id") % 97 != 0, F.col("event_type")).alias("thing"),
        F.when(F.col("value") > 40, F.lit("NaN")).when(F.col("value") > 30, F.lit("many"))
        .otherwise(F.col("value").cast("string")).alias("strength"),
        F.when(F.col("event_id") % 11 == 0, F.lit("not-a-time")).when(
            F.col("event_id") % 13 == 0, F.lit(None)
        ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("occurred"),
    )
    columns = contract.Columns("account", "thing", "strength", "occurred")
    return contract.violations(dirty, columns)


@query
def catalog_last_row(spark, sf):
    return contract.item_catalog(views.clicks(spark, sf), views.CLICK_ORDER)


@query
def dense_index_items(spark, sf):
    return split.dense_index(views.purchases(spark, sf), "item_id")


@query
def dataset_profile(spark, sf):
    return split.profile(views.purchases(spark, sf))


@query
def typed_identifiers(spark, sf):
    """Typed JSON forms of integer and string ids, decoded again and put in mixed order."""
    c = views.table(spark, sf, "customer")
    ids = c.select("c_custkey", encode_identifier(c, "c_custkey").alias("encoded")).unionByName(
        c.select("c_custkey", encode_identifier(c, "c_name").alias("encoded"))
    )
    back = ids.withColumn("id", decode_identifier(F.col("encoded")))
    index = split.dense_index(back, "id")
    return back.join(index, "id").select(
        "encoded", F.coalesce("id.i", F.lit(-1)).alias("int_id"),
        F.coalesce("id.s", F.lit("")).alias("text_id"), "pos",
    )


@query
def metadata_cleanup(spark, sf):
    p = views.table(spark, sf, "part")
    odd = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).when(
        F.col("p_size") % 5 == 0, F.lit(float("inf"))
    ).otherwise(F.col("p_retailprice"))
    return clean_metadata(p.select("p_partkey", "p_name", odd.alias("p_retailprice")))


@query
def item_documents(spark, sf):
    p = views.table(spark, sf, "part")
    blanked = p.select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).alias("brand"),
    )
    return blanked.select("p_partkey", document(["name", "brand"], F.col("p_partkey")).alias("doc"))


@query
def document_tokens(spark, sf):
    """Distinct tokens of all documents with their frequency over the whole texts."""
    d = views.table(spark, sf, "documents")
    return d.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def token_hash_features(spark, sf):
    """Hash column and sign of every distinct token."""
    d = views.table(spark, sf, "documents")
    words = d.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return words.select(
        "token", hash_column(F.col("token"), 128).alias("col"),
        hash_sign(F.col("token")).alias("sign"),
    )


@query
def normalized_vectors(spark, sf):
    v = views.vectors(spark, sf).select("item", l2_normalize(F.col("vec")).alias("vec"))
    return v.select("item", F.posexplode("vec").alias("dim", "x")).select(
        "item", F.col("dim").cast("bigint").alias("dim"), r6("x")
    )


# --------------------------------------------------------------------------- split


@query
def holdout_counts(spark, sf):
    """Extreme ratios, so that small users need the counts reduced."""
    s = split.Split("user_holdout", 0.49, 0.5)
    return split.holdout_table(views.purchases(spark, sf), s)


@query
def split_temporal(spark, sf):
    s = split.split_events(views.clicks(spark, sf), views.CLICK_ORDER, views.TEMPORAL)
    return s.select("event_id", "user_id", "split")


@query
def split_seeded(spark, sf):
    s = split.split_events(views.clicks(spark, sf), views.CLICK_ORDER, views.SEEDED)
    return s.select("event_id", "user_id", "split")


@query
def split_integrity(spark, sf):
    events = views.clicks(spark, sf)
    labelled = split.split_events(events, views.CLICK_ORDER, views.SEEDED)
    return split.split_integrity(labelled, events, views.CLICK_ORDER)


@query
def ratings_train(spark, sf):
    return views.prepared_purchases(spark, sf).ratings("train").select(
        "user_id", "item_id", r6("value")
    )


# --------------------------------------------------------------------------- sequences


def _ordered(spark, sf):
    data = views.prepared_clicks(spark, sf)
    return sequences.ordered_events(data.part("train"), data.order, data.hot_users)


@query
def ordered_events(spark, sf):
    return _ordered(spark, sf).select("user_id", "pos", "event_id", "item_id")


@query
def item_sequences(spark, sf):
    """The user's item sequence in long form."""
    return _ordered(spark, sf).select("user_id", "pos", "item_id")


@query
def recent_items(spark, sf):
    """The last 20 items of each user, padded on the left, in long form."""
    recent = sequences.recent_items(_ordered(spark, sf), 20)
    padded = sequences.pad_left(F.col("items"), 20, F.lit(-1).cast("bigint"))
    return recent.select("user_id", F.posexplode(padded).alias("slot", "item_id")).select(
        "user_id", big("slot"), "item_id"
    )


@query
def transition_pairs(spark, sf):
    return sequences.transitions(_ordered(spark, sf))


@query
def last_item(spark, sf):
    data = views.prepared_clicks(spark, sf)
    return sequences.last_items(data.part("train"), data.order)


@query
def prefix_examples(spark, sf):
    """Next-item examples with prefixes of at most 8 items, written as text."""
    ex = sequences.prefix_examples(_ordered(spark, sf), 8)
    padded = sequences.pad_left(F.col("prefix"), 8, F.lit(-1).cast("bigint"))
    return ex.select("user_id", "pos", F.array_join(padded, ",").alias("prefix"), "target")


@query
def request_order(spark, sf):
    return sequences.request_order(views.sessions(spark, sf)).select(
        "request_id", "pos", "item_id", "rank"
    )


# --------------------------------------------------------------------------- retrievers


@query
def popularity(spark, sf):
    base = views.model(spark, sf, "purchases", "popularity").tables["scores"]
    return base.select("item_id", r6("score"), "pos")


@query
def item_norms(spark, sf):
    norms = pairs.item_norms(views.prepared_purchases(spark, sf).ratings("train"))
    return norms.select("item_id", r6("norm"))


@query
def itemknn_topn(spark, sf):
    edges = pairs.cosine_neighbours(views.prepared_purchases(spark, sf).ratings("train"), 20)
    return edges.select("item", "other", r6("weight"), "rank")


@query
def cooccurrence_min2(spark, sf):
    edges = pairs.cooccurrence(views.prepared_purchases(spark, sf).ratings("train"), 2)
    return edges.select("item", "other", r6("weight"))


@query
def markov_transitions(spark, sf):
    edges = sequences.transition_probabilities(sequences.transitions(_ordered(spark, sf)))
    return edges.select("item_id", "other", r6("weight"))


@query
def tfidf_weights(spark, sf):
    item_docs, texts = textsim.distinct_documents(views.part_documents(spark, sf))
    weights = textsim.tfidf(texts, item_docs.count())
    return weights.select("doc_key", "token", r6("weight"))


@query
def tfidf_similarity(spark, sf):
    """Cosine of distinct part documents; equal documents are one row."""
    item_docs, texts = textsim.distinct_documents(views.part_documents(spark, sf))
    weights = textsim.tfidf(texts, item_docs.count())
    return textsim.tfidf_similarity(weights).select("item", "other", r6("weight"))


@query
def hashed_features(spark, sf):
    _, texts = textsim.distinct_documents(views.doc_texts(spark, sf))
    return textsim.hashed_features(texts, 128).select("doc_key", "col", r6("weight"))


@query
def semantic_topn(spark, sf):
    """Hashed-feature neighbours of all parts; many parts share a document."""
    item_docs, texts = textsim.distinct_documents(views.part_documents(spark, sf))
    vecs = textsim.feature_vectors(textsim.hashed_features(texts, 128), 128)
    edges = textsim.document_neighbours(item_docs, vecs, 10)
    return edges.select("item", "other", r6("weight"), "rank")


@query
def semantic_topn_documents(spark, sf):
    """Hashed-feature neighbours over the whole document texts."""
    item_docs, texts = textsim.distinct_documents(views.doc_texts(spark, sf))
    vecs = textsim.feature_vectors(textsim.hashed_features(texts, 128), 128)
    edges = textsim.document_neighbours(item_docs, vecs, 10)
    return edges.select("item", "other", r6("weight"), "rank")


@query
def embedding_topn(spark, sf):
    return embedding_neighbours(views.vectors(spark, sf), 10).select(
        "item", "other", r6("weight"), "rank"
    )


@query
def graph_embeddings(spark, sf):
    m = views.model(spark, sf, "clicks", "graph_embeddings", embedding_dim=8, neighbours=10)
    return m.tables["similarity"].select("item", "other", r6("weight"))


# --------------------------------------------------------------------------- scoring


def _user_batch(data, mode: str | None = None) -> QueryBatch:
    """Training rows of every user; as histories they are in the order of time."""
    return hybrid.training_batch(data, mode) if mode else recommend.user_batch(data)


def _topk(df: DataFrame, key: str = "user_id") -> DataFrame:
    return df.select(F.col("request_id").alias(key), "item_id", r6("score"), "rank")


def _recommend(spark, sf, view: str, model: FittedModel, mode: str | None, **kw) -> DataFrame:
    data = (views.prepared_clicks if view == "clicks" else views.prepared_purchases)(spark, sf)
    return recommend.recommend(model, _user_batch(data, mode), item_space(data), K, **kw)


@query
def score_popularity(spark, sf):
    """Top 10 unseen items by popularity for every customer."""
    return _topk(_recommend(spark, sf, "purchases",
                            views.model(spark, sf, "purchases", "popularity"), None))


@query
def score_itemknn(spark, sf):
    """Weighted-history scores of every customer, before ranking."""
    m = views.model(spark, sf, "purchases", "itemknn", neighbours=20)
    data = views.prepared_purchases(spark, sf)
    batch = _user_batch(data)
    scores = scoring.weighted_history(batch.vector, m.tables["similarity"], batch.hot)
    return scores.select(F.col("request_id").alias("user_id"), "item_id", r6("score"))


@query
def score_last_item(spark, sf):
    """Scores from the last item alone; the rest of the catalog is zero."""
    m = views.model(spark, sf, "clicks", "itemknn", neighbours=10)
    last = FittedModel("itemknn", "sparse", m.modes, m.tables, {"aggregation": "last_item"})
    batch = recommend.session_batch(views.sessions(spark, sf))
    space = item_space(views.prepared_clicks(spark, sf))
    return _topk(recommend.recommend(last, batch, space, K), "request_id")


@query
def score_markov_fallback(spark, sf):
    m = views.model(spark, sf, "clicks", "markov")
    return _topk(_recommend(spark, sf, "clicks", m, None))


@query
def score_embedding_profile(spark, sf):
    """Users' weighted mean of item vectors against all items."""
    data = views.prepared_clicks(spark, sf)
    vecs = views.vectors(spark, sf)
    profile = scoring.history_profile(_user_batch(data).vector, vecs, 64)
    best = inner_product_topk(profile, vecs, K)
    return best.select(
        F.col("qid").alias("user_id"), F.col("item").alias("item_id"), r6("score"), "rank"
    )


@query
def score_tfidf_factored(spark, sf):
    """tf-idf scores of all that each customer bought, for the whole catalog."""
    data = views.prepared_purchases(spark, sf)
    key = ("part_texts", sf, spark.sparkContext.applicationId)
    if key not in views._MODELS:
        item_docs, texts = textsim.distinct_documents(views.part_documents(spark, sf))
        item_docs = pin(textsim.with_places(item_docs))
        views._MODELS[key] = (item_docs, pin(textsim.tfidf(texts, item_docs.count())))
    item_docs, weights = views._MODELS[key]
    history = _user_batch(data).vector.where("value <> 0")
    reach = history.groupBy("request_id").agg((F.count(F.lit(1)) + K).alias("reach"))
    near = pin(textsim.best_documents(history, item_docs, weights, reach))
    return _topk(scoring.top_k(textsim.factored_candidates(near, history, item_docs, K), K))


# --------------------------------------------------------------------------- fusion


def _hybrid(spark, sf, names, **params) -> FittedModel:
    parts = tuple(
        views.model(spark, sf, "clicks", n, **({"neighbours": 10} if n == "itemknn" else {}))
        for n in names
    )
    return FittedModel("hybrid", "hybrid", (HISTORY,), {}, params, parts)


def _views(spark, sf, names, batch):
    return [scoring.score_view(c, batch) for c in _hybrid(spark, sf, names).components]


NAMES = ("popularity", "itemknn", "markov")


@query
def component_ranks(spark, sf):
    """Exact catalog ranks of each component for all test pairs."""
    data = views.prepared_clicks(spark, sf)
    batch = _user_batch(data, HISTORY)
    pool = data.ratings("test").select(F.col("user_id").alias("request_id"), "item_id")
    ranks = fusion.component_ranks(_views(spark, sf, NAMES, batch), batch, item_space(data), pool)
    return ranks.select(
        F.col("request_id").alias("user_id"), "item_id", "component", r6("score"), "rank"
    )


@query
def rrf(spark, sf):
    return _topk(_recommend(spark, sf, "clicks", _hybrid(spark, sf, NAMES, fusion="rrf"), HISTORY))


@query
def rrf_constant_5(spark, sf):
    """A hybrid as it is fitted by name, with its own rank constant."""
    key = ("rrf_constant_5", sf, spark.sparkContext.applicationId)
    if key not in views._MODELS:
        views._MODELS[key] = hybrid.fit_hybrid(
            views.prepared_clicks(spark, sf), ["popularity", "itemknn"], "RRF",
            {"itemknn": {"neighbours": 10}}, fusion_params={"rank_constant": 5},
        )
    return _topk(_recommend(spark, sf, "clicks", views._MODELS[key], HISTORY))


@query
def rrf_purchases(spark, sf):
    """Sparse case: nearly all item-neighbour scores are implied zeros."""
    m = FittedModel("hybrid", "hybrid", (HISTORY,), {}, {"fusion": "rrf"}, (
        views.model(spark, sf, "purchases", "popularity"),
        views.model(spark, sf, "purchases", "itemknn", neighbours=20),
    ))
    return _topk(_recommend(spark, sf, "purchases", m, HISTORY))


@query
def weighted_zscore(spark, sf):
    weights = {"popularity": 0.5, "itemknn": 2.0}
    m = _hybrid(spark, sf, NAMES, fusion="weighted", weights=weights)
    return _topk(_recommend(spark, sf, "clicks", m, HISTORY))


@query
def weighted_purchases(spark, sf):
    m = FittedModel("hybrid", "hybrid", (HISTORY,), {}, {"fusion": "weighted"}, (
        views.model(spark, sf, "purchases", "popularity"),
        views.model(spark, sf, "purchases", "itemknn", neighbours=20),
    ))
    return _topk(_recommend(spark, sf, "purchases", m, HISTORY))


@query
def hybrid_top10(spark, sf):
    """popularity + itemknn, reciprocal ranks, for every user of the click view."""
    m = _hybrid(spark, sf, ("popularity", "itemknn"), fusion="rrf")
    return _topk(_recommend(spark, sf, "clicks", m, HISTORY))


@query
def candidate_pool(spark, sf):
    """Union of each component's ten best unseen items."""
    data = views.prepared_clicks(spark, sf)
    batch = _user_batch(data, HISTORY)
    seen = scoring.seen_pairs(batch)
    found = [
        scoring.view_topk(v, batch, item_space(data), K, seen).select("request_id", "item_id")
        for v in _views(spark, sf, NAMES, batch)
    ]
    return scoring.union_all(found).distinct().withColumnRenamed("request_id", "user_id")


# --------------------------------------------------------------------------- recommend


@query
def recommend_users(spark, sf):
    """Known users, markov with popularity fallback, catalog record attached."""
    data = views.prepared_clicks(spark, sf)
    found = recommend.recommend_users(views.model(spark, sf, "clicks", "markov"), data, k=K)
    return recommend.attach_metadata(found, data.catalog).select(
        "user_id", "item_id", r6("score"), "rank", F.col("metadata.event_type").alias("event_type")
    )


@query
def recommend_sessions(spark, sf):
    """Sessions with their own depth and their own wish to see known items."""
    data = views.prepared_clicks(spark, sf)
    interactions = views.sessions(spark, sf)
    requests = interactions.select("request_id").distinct().select(
        "request_id", (F.col("request_id") % 10 + 1).cast("int").alias("top_k"),
        (F.col("request_id") % 2 == 0).alias("exclude_seen"),
    )
    m = views.model(spark, sf, "clicks", "itemknn", neighbours=10)
    found = recommend.recommend_sessions(m, item_space(data), interactions, requests, K)
    return _topk(found, "request_id")


@query
def recommend_include_seen(spark, sf):
    m = views.model(spark, sf, "clicks", "itemknn", neighbours=10)
    return _topk(_recommend(spark, sf, "clicks", m, HISTORY, exclude_seen=False))


@query
def request_status(spark, sf):
    data = views.prepared_clicks(spark, sf)
    s = views.sessions(spark, sf)
    odd = F.when(F.col("request_id") % 7 == 0, F.lit(-5)).otherwise(F.col("item_id"))
    interactions = s.where(F.col("request_id") % 5 != 0).withColumn("item_id", odd)
    requests = s.select("request_id").distinct().select(
        "request_id",
        F.when(F.col("request_id") % 10 == 0, F.col("request_id"))
        .when(F.col("request_id") % 15 == 0, F.lit(999_999))
        .when(F.col("request_id") % 11 == 0, F.col("request_id")).alias("user_id"),
        F.when(F.col("request_id") % 13 == 0, F.lit(1001)).otherwise(F.lit(10)).alias("top_k"),
    )
    return recommend.request_status(requests, interactions, data.users, data.items)


@query
def rerank_external(spark, sf):
    """Candidates re-scored by an outside table (here: a hash of both ids)."""
    base = views.model(spark, sf, "purchases", "popularity")
    found = _recommend(spark, sf, "purchases", base, None)
    outside = found.select(
        "request_id", "item_id",
        (F.pmod(F.col("request_id") * 31 + F.col("item_id") * 17, F.lit(101)) / 100).alias("score"),
    )
    return _topk(recommend.rerank(found, outside, 5))


@query
def prompt_table(spark, sf):
    """Prompts for an outside scorer: history and candidate as JSON in a template."""
    data = views.prepared_clicks(spark, sf)
    interactions = sequences.request_order(views.sessions(spark, sf)).select(
        "request_id", F.col("rank").alias("pos"), "item_id", "value"
    )
    found = recommend.recommend_sessions(
        views.model(spark, sf, "clicks", "itemknn", neighbours=10), item_space(data),
        views.sessions(spark, sf), k=3,
    )
    return recommend.prompts(
        found, interactions, data.catalog, template="H:{history} C:{candidate}"
    )


# --------------------------------------------------------------------------- evaluate


def _metrics(recommended: DataFrame, data) -> DataFrame:
    users = recommended.withColumnRenamed("request_id", "user_id")
    m = evaluate.ranking_metrics(users, data.ratings("test"), K)
    return m.select(r6("recall"), r6("ndcg"), "evaluated_users")


@query
def metrics_popularity(spark, sf):
    m = views.model(spark, sf, "purchases", "popularity")
    return _metrics(_recommend(spark, sf, "purchases", m, None),
                    views.prepared_purchases(spark, sf))


@query
def metrics_itemknn(spark, sf):
    m = views.model(spark, sf, "clicks", "itemknn", neighbours=10)
    return _metrics(_recommend(spark, sf, "clicks", m, HISTORY), views.prepared_clicks(spark, sf))


@query
def metrics_hybrid(spark, sf):
    m = _hybrid(spark, sf, ("popularity", "itemknn"), fusion="rrf")
    return _metrics(_recommend(spark, sf, "clicks", m, HISTORY), views.prepared_clicks(spark, sf))


# --------------------------------------------------------------------------- graph training parts


@query
def normalized_edges(spark, sf):
    edges = graph.normalized_edges(views.prepared_purchases(spark, sf).ratings("train"))
    return edges.select("user_id", "item_id", r6("weight"))


@query
def propagate_2_layers(spark, sf):
    """Two layers over the click graph from fixed start vectors."""
    data = views.prepared_clicks(spark, sf)
    edges = graph.normalized_edges(data.ratings("train"))

    def start(ids: DataFrame, key: str) -> DataFrame:
        cells = [(F.pmod(F.col(key) * (d + 3), F.lit(17)) / 17).alias(f"d{d}") for d in range(4)]
        return ids.select(key, F.array(*cells).alias("vec"))

    users, items = graph.propagate(
        edges, start(data.users, "user_id"), start(data.items, "item_id"), 2, 4
    )

    def long(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select(
            F.lit(side).alias("side"), F.col(key).alias("id"), F.posexplode("vec").alias("dim", "x")
        ).select("side", "id", F.col("dim").cast("bigint").alias("dim"), r6("x"))

    return long(users, "user_id", "user").unionByName(long(items, "item_id", "item"))


# --------------------------------------------------------------------------- training


def _training_rows(spark, sf) -> DataFrame:
    data = views.prepared_clicks(spark, sf)
    truth = data.ratings("validation").select(F.col("user_id").alias("request_id"), "item_id")
    batch = recommend.restrict(_user_batch(data, HISTORY), truth.select("request_id").distinct())
    parts = _views(spark, sf, ("popularity", "itemknn"), batch)
    return ranker.fusion_training_set(parts, batch, item_space(data), truth, 20)


@query
def fusion_training_set(spark, sf):
    """Ranking features of each component's 20 best unseen items, labelled by validation items."""
    return _training_rows(spark, sf).select(
        F.col("request_id").alias("user_id"), "item_id", r6("popularity_score"),
        quantize(F.col("popularity_rr"), 9).alias("popularity_rr"), r6("itemknn_score"),
        quantize(F.col("itemknn_rr"), 9).alias("itemknn_rr"), big("label"),
    )


@query
def lambda_gradients(spark, sf):
    """Gradients and hessians that the first tree of the learned fusion is grown on."""
    rows = _training_rows(spark, sf).withColumn("score", F.lit(0.0))
    return ranker.gradients(rows).select(F.col("request_id").alias("user_id"), "item_id", r6("g"), r6("h"))


#: A given ensemble over the fusion features, itemknn before popularity, score before reciprocal rank.
ENSEMBLE = {
    "features": ["itemknn_score", "itemknn_rr", "popularity_score", "popularity_rr"], "rate": 0.25,
    "trees": [
        {"feature": 1, "threshold": 0.0148, "right": {"value": 0.75}, "left": {
            "feature": 2, "threshold": 33.33333, "left": {"value": -1.0}, "right": {"value": 0.125}}},
        {"feature": 3, "threshold": 0.0142, "left": {"value": -0.5}, "right": {
            "feature": 0, "threshold": 5.12345, "left": {"value": 0.25}, "right": {"value": 1.5}}},
    ],
}


@query
def tree_scores(spark, sf):
    """Scores of the training rows under a given ensemble."""
    rows = _training_rows(spark, sf)
    return rows.select(F.col("request_id").alias("user_id"), "item_id", ranker.ensemble_scores(ENSEMBLE).alias("score"))


@query
def lambdamart_top10(spark, sf):
    """Learned fusion trained on validation rows, served over the whole catalog."""
    key = ("learned", sf, spark.sparkContext.applicationId)
    if key not in views._MODELS:
        data = views.prepared_clicks(spark, sf)
        parts = _hybrid(spark, sf, ("popularity", "itemknn")).components
        trees = hybrid.fit_learned_fusion(data, list(parts), HISTORY, {}, 42)
        views._MODELS[key] = FittedModel(
            "hybrid", "hybrid", (HISTORY,), {}, {"fusion": "learned", "trees": trees}, parts
        )
    return _topk(_recommend(spark, sf, "clicks", views._MODELS[key], HISTORY))


def _trained(spark, sf, name: str, **params) -> DataFrame:
    m = views.model(spark, sf, "clicks", name, learning_rate=0.05, epochs=1, **params)
    return _topk(_recommend(spark, sf, "clicks", m, "known_user"))


@query
def pair_samples(spark, sf):
    """Pairwise draws for every stored click entry, checked against the stored entries."""
    data = views.prepared_clicks(spark, sf)
    space = training.NodeSpace.of(data)
    size = data.ratings("train").count()
    drawn = training.sample_pairs(space, size, 1, 7)
    held = space.entries.select("user", "item", F.lit(1).alias("held"))
    marked = drawn.join(
        held.withColumnsRenamed({"item": "positive", "held": "p"}), ["user", "positive"], "left"
    ).join(held.withColumnsRenamed({"item": "negative", "held": "n"}), ["user", "negative"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("draws"), F.count("p").alias("stored_positives"),
        F.count("n").alias("stored_negatives"), F.count_distinct("user").alias("users"),
    )


@query
def bpr_top10(spark, sf):
    return _trained(spark, sf, "bpr", embedding_dim=16, batch_size=8192)


@query
def lightgcn_top10(spark, sf):
    return _trained(spark, sf, "lightgcn", embedding_dim=16, batch_size=8192)


@query
def two_tower_top10(spark, sf):
    return _trained(spark, sf, "two_tower", embedding_dim=8, batch_size=8192)


@query
def multivae_top10(spark, sf):
    return _trained(spark, sf, "multivae", hidden_dim=32, latent_dim=16, batch_size=1024)


@query
def sasrec_top10(spark, sf):
    return _trained(
        spark, sf, "sasrec", embedding_dim=16, max_length=10, layers=1, batch_size=1 << 17
    )


def _given_table(space, dim: int = 4) -> DataFrame:
    """Start vectors that follow from the node numbers."""
    cells = [F.pmod(F.col("node") * (d + 3), F.lit(17)) / 17 - 0.3 for d in range(dim)]
    return pin(training.with_moments(training.all_nodes(space).select("node", F.array(*cells).alias("vec")), dim))


def _one_step(spark, sf, step) -> DataFrame:
    data = views.prepared_clicks(spark, sf)
    space = training.NodeSpace.of(data)
    size = data.ratings("train").count()
    table = step(space, _given_table(space), training.sample_pairs(space, size, 1, 7), size)
    return table.select("node", F.posexplode("vec").alias("dim", "x")).select("node", big("dim"), r6("x"))


@query
def pair_draws(spark, sf):
    """Every draw of a user, a stored and an unseen item, as node numbers."""
    data = views.prepared_clicks(spark, sf)
    space = training.NodeSpace.of(data)
    drawn = training.sample_pairs(space, data.ratings("train").count(), 1, 7)
    return drawn.select(*[big(c) for c in ("step", "user", "positive", "negative")])


@query
def bpr_one_step(spark, sf):
    """Factors after one step of matrix factorization on all draws, from given factors."""
    return _one_step(spark, sf, lambda space, table, pairs, size: factor.bpr_step(table, pairs, size, 4, 1, 0.05))


@query
def lightgcn_one_step(spark, sf):
    """Layer-0 vectors after one step through two layers of the click graph."""
    def step(space, table, pairs, size):
        return factor.lightgcn_step(table, pin(factor.node_arcs(space)), pin(pairs), size, 4, 2, 0.01, 1, 0.05)

    return _one_step(spark, sf, step)
