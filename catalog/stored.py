"""Queries over what the library writes and reads back: files, datasets, models, runs, requests, streams."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.queries import K, _topk, _user_batch, big, query, r6
from kindred.functions.numbers import quantize
from kindred.operators import neural, recommend, scoring
from kindred.operators.retrievers import item_space
from kindred.plans.fitted import KNOWN_USER, FittedModel
from kindred.plans.serving import Server
from kindred.plans.workflow import evaluate, run
from kindred.session import shared_folder
from kindred.sources import store, tables
from kindred.sources.digests import digest_token
from kindred.streaming.sessions import recommend_stream


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/kindred-catalog/{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- files


@query
def scan_csv(spark, sf):
    """Events written as CSV, with JSON in quoted fields, and scanned again."""
    path = f"{folder(spark)}/events.csv"
    events = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", "props", "value")
    events.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, path, "csv", events.schema).select("event_id", "user_id", "event_type", "props", r6("value"))


def _exported(spark, sf) -> DataFrame:
    return views.clicks(spark, sf).select("user_id", "item_id", "value", F.unix_seconds("timestamp").alias("t"))


@query
def scan_movielens_csv(spark, sf):
    """Clicks as a ratings.csv, found in its folder and read with canonical names and times."""
    path = folder(spark)
    named = _exported(spark, sf).toDF("userId", "movieId", "rating", "timestamp")
    named.write.option("header", True).csv(f"{path}/ratings.csv")
    read = tables.read_movielens(spark, path)
    return read.select(big("user_id"), big("item_id"), r6("value"), F.unix_seconds("timestamp").alias("t"))


@query
def scan_movielens_dat(spark, sf):
    """The same as a ratings.dat with its long separator."""
    path = folder(spark)
    line = F.concat_ws("::", "user_id", "item_id", F.col("value").cast("string"), "t").alias("value")
    _exported(spark, sf).select(line).write.text(f"{path}/ratings.dat")
    read = tables.read_movielens(spark, path)
    return read.select(big("user_id"), big("item_id"), r6("value"), F.unix_seconds("timestamp").alias("t"))


@query
def scan_yelp_json(spark, sf):
    """Clicks as lines of JSON."""
    path = folder(spark)
    named = _exported(spark, sf).select(
        F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("business_id"),
        F.col("value").alias("stars"), F.timestamp_seconds("t").cast("string").alias("date"),
    )
    named.write.json(f"{path}/review.json")
    read = tables.read_yelp(spark, path)
    return read.select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"), r6("value"),
        F.unix_seconds("timestamp").alias("t"),
    )


@query
def adapter_row_order(spark, sf):
    """A table without order columns: rows are numbered as they stand in its file."""
    config = {"name": "tabular", "path": f"{sf}/events.parquet", "columns": {"item_id": "event_id"}}
    frame, _, order = tables.load_interactions(spark, config)
    return frame.select("event_id", F.col(order[0]).cast("bigint").alias("place"))


# --------------------------------------------------------------------------- stores


@query
def prepared_round_trip(spark, sf):
    """A prepared dataset, written under its digest and loaded with all checks."""
    parent = folder(spark)
    saved = store.save_prepared(views.prepared_clicks(spark, sf), parent)
    loaded = store.load_prepared(spark, f"{parent}/{digest_token(saved.digest)}")
    return loaded.events.select("event_id", "user_id", "split")


def _stored(spark, sf, name: str, **params):
    """A stored model, written once per session and folder."""
    key = ("stored", sf, spark.sparkContext.applicationId, name)
    if key not in views._MODELS:
        data = views.prepared_clicks(spark, sf)
        views._MODELS[key] = store.save_model(views.model(spark, sf, "clicks", name, **params), data, folder(spark)).path
    return views._MODELS[key]


@query
def model_round_trip(spark, sf):
    """A stored model's payload after loading it with all checks."""
    loaded = store.load_model(spark, _stored(spark, sf, "itemknn", neighbours=10)).model
    return loaded.tables["similarity"].select("item", "other", r6("weight"))


@query
def model_description(spark, sf):
    loaded = store.load_model(spark, _stored(spark, sf, "itemknn", neighbours=10), verify=False)
    told = store.describe(loaded)
    return told.select("plugin", "runtime", F.array_join("capabilities", ",").alias("capabilities"), "catalog_size")


@query
def payload_violations(spark, sf):
    """A model with broken weights and unknown items: what the check counts."""
    model = views.model(spark, sf, "clicks", "itemknn", neighbours=10)
    broken = model.tables["similarity"].withColumns({
        "weight": F.when(F.col("item") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("weight")),
        "other": F.when(F.col("other") % 11 == 0, -F.col("other") - 1).otherwise(F.col("other")),
    })
    copy = FittedModel("itemknn", "sparse", model.modes, {"similarity": broken}, model.params)
    found = store.payload_violations(copy, views.prepared_clicks(spark, sf).items)
    return spark.createDataFrame(sorted(found.items()), "name string, n bigint")


# --------------------------------------------------------------------------- runs


@query
def evaluate_hybrid(spark, sf):
    """A fitted model against the test items of the dataset, in one plan."""
    key = ("rrf_constant_60", sf, spark.sparkContext.applicationId)
    if key not in views._MODELS:
        from kindred.plans.hybrid import fit_hybrid

        views._MODELS[key] = fit_hybrid(
            views.prepared_clicks(spark, sf), ["popularity", "itemknn"], "rrf", {"itemknn": {"neighbours": 10}}
        )
    found = evaluate(views._MODELS[key], views.prepared_clicks(spark, sf), K)
    return found.select(r6("recall"), r6("ndcg"), "evaluated_users")


@query
def run_metrics(spark, sf):
    """Prepare, train and evaluate from a table of clicks; the metrics as the run has written them."""
    path = folder(spark)
    views.clicks(spark, sf).write.parquet(f"{path}/clicks.parquet")
    done = run(spark, {
        "dataset": {
            "name": "tabular", "path": f"{path}/clicks.parquet", "columns": {"value": "value", "timestamp": "timestamp"},
            "order": ["event_id"], "split": {"strategy": "temporal", "validation_ratio": 0.1, "test_ratio": 0.2},
        },
        "model": {"name": "hybrid"},
        "retrieval": {"components": ["popularity", "itemknn"], "parameters": {"itemknn": {"neighbours": 10}}},
        "evaluation": {"top_k": K},
    }, f"{path}/run")
    lines = spark.read.json(f"{path}/run/metrics")
    assert json.loads(lines.first()["metrics"]) == done["metrics"]
    schema = f"struct<`recall@{K}`:double,`ndcg@{K}`:double,evaluated_users:bigint>"
    m = lines.select(F.from_json("metrics", schema).alias("m"))
    return m.select(
        quantize(F.col(f"m.recall@{K}"), 6).alias("recall"), quantize(F.col(f"m.ndcg@{K}"), 6).alias("ndcg"),
        F.col("m.evaluated_users").alias("evaluated_users"),
    )


# --------------------------------------------------------------------------- requests


def _requests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every third user asks as a user, some unknown; the others send their training events."""
    sessions = views.sessions(spark, sf)
    ids = sessions.select("request_id").distinct()
    n = F.col("request_id")
    user = F.when(n % 17 == 0, F.lit(999_999)).when(n % 3 == 0, n)
    requests = ids.select(
        n.cast("string").alias("request_id"), user.cast("bigint").alias("user_id"), (n % 10 + 1).cast("int").alias("top_k"),
        (n % 2 == 0).alias("exclude_seen"),
    )
    asks = requests.where("user_id is null").select("request_id")
    return requests, sessions.withColumn("request_id", n.cast("string")).join(asks, "request_id", "left_semi")


def _answers(found: DataFrame, status: DataFrame) -> DataFrame:
    rows = status.join(found.drop("metadata"), "request_id", "left")
    rows = rows.withColumns({"item_id": F.coalesce("item_id", F.lit(-1)), "score": F.coalesce("score", F.lit(-1.0)), "rank": F.coalesce("rank", F.lit(0))})
    return rows.select("request_id", "mode", "status", big("item_id"), r6("score"), big("rank"))


@query
def recommend_requests(spark, sf):
    """Users and sessions in one table, answered from a stored model alone."""
    server = Server.of(store.load_model(spark, _stored(spark, sf, "markov")))
    return _answers(*server.answer(*_requests(spark, sf)))


@query
def stream_requests(spark, sf):
    """The same requests as a stream; what its sink holds at the end."""
    server = Server.of(store.load_model(spark, _stored(spark, sf, "markov"), verify=False))
    path = folder(spark)
    requests, interactions = _requests(spark, sf)
    event = F.struct("pos", "item_id", "value", "timestamp")
    sent = F.transform(F.array_sort(F.collect_list(event)), lambda e: F.struct(
        e["item_id"].alias("item_id"), e["value"].alias("value"), e["timestamp"].alias("timestamp")))
    nested = interactions.groupBy("request_id").agg(sent.alias("interactions"))
    requests.join(nested, "request_id", "left").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(server.request_schema()).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    recommend_stream(server, stream, f"{path}/out", f"{path}/progress").awaitTermination()
    return _answers(*(spark.read.parquet(f"{path}/out/{part}").drop("batch") for part in ("recommendations", "status")))


@query
def score_embedding_user(spark, sf):
    """Known users' vectors against all items, both given."""
    data = views.prepared_clicks(spark, sf)

    def given(ids: DataFrame, key: str, name: str) -> DataFrame:
        cells = [(F.pmod(F.col(key) * (d + 3), F.lit(17)) / 17 - 0.4).alias(f"d{d}") for d in range(4)]
        return ids.select(F.col(key).alias(name), F.array(*cells).alias("vec"))

    model = FittedModel("given", "embedding", (KNOWN_USER,), {
        "users": given(data.users, "user_id", "user_id"), "items": given(data.items, "item_id", "item"),
    }, {"dim": 4})
    batch = _user_batch(data)
    return _topk(scoring.view_topk(scoring.score_view(model, batch), batch, item_space(data), K, scoring.seen_pairs(batch)))


@query
def user_requests(spark, sf):
    """Requests that name the same user more than once, with other depths and wishes."""
    data = views.prepared_clicks(spark, sf)
    n = F.col("user_id")
    twice = data.users.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (n * 2 + F.col("turn")).alias("request_id"), "user_id", (n % 5 + 1).cast("int").alias("top_k"), (F.col("turn") == 0).alias("exclude_seen"),
    )
    batch = recommend.known_user_batch(twice, data.ratings("train"))
    hide = twice.where("exclude_seen").select("request_id")
    found = recommend.recommend(views.model(spark, sf, "clicks", "markov"), batch, item_space(data), K, hide)
    return _topk(recommend.within_depth(found, twice), "request_id")


#: A given autoencoder of two hidden and two latent cells.
AUTOENCODER = {
    "enc_b": [0.1, -0.2], "mu_W": [[0.5, -0.25], [0.25, 0.75]], "mu_b": [0.1, -0.1],
    "lv_W": [[0.0, 0.0], [0.0, 0.0]], "lv_b": [0.0, 0.0], "dec_W": [[1.0, 0.5], [-0.5, 0.25]], "dec_b": [0.05, 0.0],
}


@query
def score_autoencoder(spark, sf):
    """Users' training rows through a given encoder and decoder."""
    data = views.prepared_clicks(spark, sf)

    def cells(n: int) -> DataFrame:
        parts = [(F.pmod(F.col("item_id") * (d + 3), F.lit(17)) / 17 - 0.4).alias(f"d{d}") for d in range(n)]
        return data.items.select(F.col("item_id").alias("item"), F.array(*parts).alias("vec"))

    weights = neural.weights_to_lists({k: np.array(v) for k, v in AUTOENCODER.items()})
    model = FittedModel("given", "autoencoder", (KNOWN_USER,), {"encoder": cells(2), "items": cells(3)}, {"hidden": 2, "weights": weights})
    batch = _user_batch(data)
    return _topk(scoring.view_topk(scoring.score_view(model, batch), batch, item_space(data), K, scoring.seen_pairs(batch)))
