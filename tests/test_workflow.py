import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kindred.operators.contract import ContractError, catalog_documents, normalize
from kindred.operators.recommend import recommend_users
from kindred.operators.retrievers import item_space
from kindred.operators.split import Split, prepare
from kindred.plans.hybrid import fit_hybrid
from kindred.plans.registry import fit_component
from kindred.plans.serving import Server
from kindred.session import pin, pin_scope, release, shared_folder
from kindred.plans.workflow import evaluate, run
from kindred.sources.digests import canonical_json, digest_token, table_digest, value_digest
from kindred.sources.store import (
    IntegrityError, describe, load_model, load_prepared, save_model, save_prepared,
)
from kindred.sources.tables import load_interactions, read_movielens, read_table, read_yelp, synthetic
from kindred.streaming.sessions import recommend_stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


# ------------------------------------------------------------------ sources


def generic_rows():
    return [(u, (u + o) % 8, o + 1.0, f"2024-01-{o + 1:02d}") for u in range(3) for o in range(5)]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_generic_tables(spark, tmp_path, kind):
    rows = generic_rows()
    if kind == "csv":
        path = write(tmp_path / "t.csv", "account,product,strength,occurred\n" + "\n".join(
            ",".join(map(str, r)) for r in rows))
    else:
        path = str(tmp_path / "t.parquet")
        spark.createDataFrame(rows, "account long, product long, strength double, occurred string"
                              ).write.parquet(path)
    config = {"name": "tabular", "path": path, "columns": {
        "user_id": "account", "item_id": "product", "value": "strength", "timestamp": "occurred"}}
    frame, columns, order = load_interactions(spark, config)
    p = prepare(normalize(frame, columns), order, Split("temporal", 0.2, 0.2))
    assert (p.n_users, p.n_items) == (3, 7)
    assert p.ratings("validation").count() == 3 and p.ratings("test").count() == 3


def test_other_formats_are_errors(spark, tmp_path):
    with pytest.raises(ContractError, match="unsupported"):
        read_table(spark, str(tmp_path / "x.orc"))
    for config in ({"name": "nope"}, {"name": "tabular"}, {"name": "yelp"}):
        with pytest.raises(ContractError):
            load_interactions(spark, config)


def test_movielens_csv_is_split(spark, tmp_path):
    rows = "".join(f"{i},{i % 9},3.5,{1000 + i}\n" for i in range(2000))
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_movielens(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_movielens(spark, tmp_path):
    csv = write(tmp_path / "a/ratings.csv", "userId,movieId,rating,timestamp\n1,2,3.5,1700000000\n")
    row = read_movielens(spark, csv.rsplit("/", 1)[0]).first()
    assert (row.user_id, row.item_id, row.value) == (1, 2, 3.5)
    write(tmp_path / "b/ratings.dat", "1::2::4::1700000000\n3::4::5::1700000001\n")
    rows = read_movielens(spark, str(tmp_path / "b")).orderBy("user_id").select(
        "user_id", "item_id", "value", F.unix_seconds("timestamp").alias("t")).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 4.0, 1700000000), (3, 4, 5.0, 1700000001)]
    bad = write(tmp_path / "c/ratings.csv", "userId,movieId,timestamp\n1,2,soon\n")
    with pytest.raises(ContractError):
        read_movielens(spark, bad)
    plain = write(tmp_path / "d/ratings.csv", "userId,movieId\n1,2\n")
    assert read_movielens(spark, plain).first().value == 1.0


def test_yelp(spark, tmp_path):
    write(tmp_path / "a/reviews.csv", "user_id,business_id,stars,date\nu,b,4,2024-01-02 03:04:05\n")
    row = read_yelp(spark, str(tmp_path / "a")).first()
    assert (row.user_id, row.item_id, row.value) == ("u", "b", 4)
    line = {"user_id": "u", "business_id": "b", "stars": 4, "date": "2024-01-02 03:04:05"}
    write(tmp_path / "b/review.json", json.dumps(line) + "\n")
    row = read_yelp(spark, str(tmp_path / "b")).select(F.unix_seconds("timestamp").alias("t"), "item_id").first()
    assert row.t == int(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).timestamp())
    line["date"] = "whenever"
    write(tmp_path / "c/review.json", json.dumps(line) + "\n")
    with pytest.raises(ContractError):
        read_yelp(spark, str(tmp_path / "c"))


def test_synthetic(spark):
    df = synthetic(spark, 4, 9, 5, seed=1)
    rows = df.orderBy("event_order").collect()
    assert len(rows) == 20 and len({r.event_order for r in rows}) == 20
    for u in range(4):
        mine = [int(r.item_id[-5:]) for r in rows[u * 5:(u + 1) * 5]]
        assert sorted(mine) == sorted((i * 5 + u * 7) % 9 for i in range(5))
    assert df.exceptAll(synthetic(spark, 4, 9, 5, seed=1).repartition(3)).isEmpty()
    for bad in ((0, 9, 5), (4, 2, 3), (4, 9, 10), (4, 9, 2)):
        with pytest.raises(ContractError):
            synthetic(spark, *bad)


# ------------------------------------------------------------------ digests and stores


def test_canonical_hashing():
    assert canonical_json({"b": 1, "a": {2, 1}}) == '{"a":[1,2],"b":1}'
    assert value_digest({"a": 1, "b": 2}) == value_digest({"b": 2, "a": 1})
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            value_digest(bad)
    with pytest.raises(TypeError):
        value_digest(object())
    with pytest.raises(ValueError):
        digest_token("md5:abc")


def test_table_digest_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    assert table_digest(df) == table_digest(df.repartition(7).select("x", "id"))
    assert table_digest(df) != table_digest(df.withColumn("x", F.col("x") + 1))
    assert table_digest(df) != table_digest(df.union(df.limit(1)))


def test_prepared_round_trip_and_corruption(spark, small_prepared, ring_prepared, tmp_path):
    saved = save_prepared(small_prepared, str(tmp_path / "data"))
    again = save_prepared(small_prepared, str(tmp_path / "data"))
    assert saved.digest == again.digest
    path = f"{tmp_path}/data/{digest_token(saved.digest)}"
    loaded = load_prepared(spark, path)
    columns = small_prepared.events.columns
    assert loaded.events.select(columns).exceptAll(small_prepared.events).isEmpty()
    mixed = save_prepared(ring_prepared, str(tmp_path / "ring"))
    assert load_prepared(spark, f"{tmp_path}/ring/{digest_token(mixed.digest)}").n_items == 10
    extra = loaded.events.where("split = 'train'").limit(1).drop("split")
    extra.write.mode("append").parquet(f"{path}/events/split=test")
    with pytest.raises(IntegrityError):
        load_prepared(spark, path)
    with pytest.raises(IntegrityError):
        load_prepared(spark, str(tmp_path / "nothing"))


def test_model_round_trip_identity_and_corruption(spark, small_prepared, tmp_path):
    model = fit_hybrid(small_prepared, ["popularity", "itemknn"])
    stored = save_model(model, small_prepared, str(tmp_path), {"note": 1})
    same = save_model(model, small_prepared, str(tmp_path), {"note": 1})
    other = save_model(model, small_prepared, str(tmp_path), {"note": 2})
    assert stored.manifest["artifact_id"] == same.manifest["artifact_id"]
    assert stored.manifest["artifact_id"] != other.manifest["artifact_id"]
    loaded = load_model(spark, stored.path)
    a = evaluate(model, small_prepared, 3).first()
    assert a == evaluate(loaded.model, small_prepared, 3).first()
    info = describe(loaded).first()
    assert info.plugin == "hybrid" and info.catalog_size == 18 and info.capabilities == ["history"]
    table = f"{stored.path}/model_component0_scores"
    spark.read.parquet(table).limit(1).write.mode("append").parquet(table)
    with pytest.raises(IntegrityError, match="digest"):
        load_model(spark, stored.path)


def test_bad_payloads_are_rejected(spark, small_prepared, tmp_path):
    model = fit_component("itemknn", small_prepared)
    nan = model.tables["similarity"].withColumn("weight", F.lit(float("nan")))
    model.tables["similarity"] = nan
    with pytest.raises(IntegrityError, match="non_finite"):
        save_model(model, small_prepared, str(tmp_path))
    model = fit_component("itemknn", small_prepared)
    model.tables["similarity"] = model.tables["similarity"].withColumn("other", F.lit(999).cast("bigint"))
    with pytest.raises(IntegrityError, match="unknown_other"):
        save_model(model, small_prepared, str(tmp_path))


# ------------------------------------------------------------------ runs and streams


def test_run_resumes_and_guards_its_folder(spark, tmp_path, monkeypatch):
    config = {
        "dataset": {"name": "synthetic", "parameters": {"users": 6, "items": 18,
                                                        "interactions_per_user": 6},
                    "split": {"strategy": "temporal", "validation_ratio": 0.2, "test_ratio": 0.2}},
        "model": {"name": "hybrid"}, "retrieval": {"components": ["popularity", "itemknn"]},
        "evaluation": {"top_k": 5},
    }
    folder = str(tmp_path / "run")
    first = run(spark, config, folder)
    assert first["metrics"]["evaluated_users"] == 6 and "recall@5" in first["metrics"]
    import kindred.plans.workflow as workflow

    def never(*_):
        raise AssertionError("a completed stage ran again")

    for name in ("prepare_dataset", "train_model", "evaluate"):
        monkeypatch.setattr(workflow, name, never)
    assert run(spark, config, folder) == first
    with pytest.raises(ValueError, match="another configuration"):
        run(spark, {**config, "evaluation": {"top_k": 6}}, folder)


def test_evaluation_checks_the_dataset(small_prepared):
    model = fit_component("popularity", small_prepared)
    with pytest.raises(ValueError, match="another dataset"):
        evaluate(model, small_prepared, 3, trained_on="sha256:other")


def pins(spark):
    folder = Path(shared_folder(spark).removeprefix("file://")) / "kindred-pins"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


REQUESTS = [
    ("good", None, 3, True, [(0, 1.0, None), (5, 2.0, None)]),
    ("seen", None, 18, False, [(0, 1.0, None)]),
    ("odd", None, 3, True, [(999, 1.0, None)]),
    ("empty", None, 3, True, []),
    ("user", 2, 4, True, None),
    ("user again", 2, 18, False, None),
    ("nobody", 77, 3, True, None),
    ("both", 2, 3, True, [(0, 1.0, None)]),
    ("deep", 1, 2000, True, None),
    ("plain", 3, None, None, None),
]
WANT = {
    "good": "ok", "seen": "ok", "odd": "unknown_identifier", "empty": "invalid_request", "user": "ok", "user again": "ok",
    "nobody": "unknown_identifier", "both": "invalid_request", "deep": "invalid_request", "plain": "ok",
}


def test_stream_of_users_and_sessions(spark, small_prepared, tmp_path):
    """From a stored model alone; every micro-batch frees its copies."""
    stored = save_model(fit_component("popularity", small_prepared), small_prepared, str(tmp_path / "models"))
    server = Server.of(load_model(spark, stored.path))
    schema = server.request_schema()
    for n in range(2):
        part = [(f"{r[0]}{n}", *r[1:]) for r in REQUESTS]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    server.space.items.count()
    before = pins(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    recommend_stream(server, stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert pins(spark) == before
    status = {r.request_id: r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert status == {f"{name}{n}": want for name, want in WANT.items() for n in range(2)}
    out = spark.read.parquet(str(tmp_path / "out/recommendations"))
    counts = {r.request_id: r["count"] for r in out.groupBy("request_id").count().collect()}
    deep = {"good": 3, "seen": 18, "user": 4, "user again": 18, "plain": 10}
    assert counts == {f"{name}{n}": k for name, k in deep.items() for n in range(2)}
    direct = recommend_users(stored.model, small_prepared, k=4).where("user_id = 2").orderBy("rank").collect()
    got = out.where("request_id = 'user0'").orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in got] == [(r.item_id, r.score) for r in direct]


@pytest.mark.parametrize("name", ["markov", "bpr", "sasrec"])
def test_requests_of_one_user_may_differ(spark, small_prepared, name):
    """Runtimes with tables by user find them through the request."""
    params = {"embedding_dim": 4, "epochs": 1, "steps": 1, "max_length": 4, "hidden": 4}
    model = fit_component(name, small_prepared, params)
    server = Server.prepared(model, small_prepared)
    rows = [("a", 0, 2, True), ("b", 0, 18, False), ("c", 1, 3, True)]
    requests = spark.createDataFrame(rows, "request_id string, user_id long, top_k int, exclude_seen boolean")
    none = spark.createDataFrame([], "request_id string, pos long, item_id long, value double")
    found, status = server.answer(requests, none)
    got = {}
    for r in found.collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.item_id, r.score)
    assert {r.status for r in status.collect()} == {"ok"}
    assert {k: len(v) for k, v in got.items()} == {"a": 2, "b": 18, "c": 3}
    direct = recommend_users(model, small_prepared, k=3).collect()
    for r in direct:
        if r.user_id == 1:
            assert got["c"][r["rank"]][0] == r.item_id


def test_pin_scope_frees_copies_when_work_fails(spark):
    before = pins(spark)
    with pytest.raises(ValueError):
        with pin_scope():
            pin(spark.range(3))
            with pin_scope():
                pin(spark.range(4))
            raise ValueError
    assert pins(spark) == before
    kept = pin(spark.range(2))
    assert len(pins(spark) - before) == 1
    release(kept)


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    """Whatever the sizes of the files and the packing into tasks."""
    big = "".join(f"u{i},b{i}\n" for i in range(3000))
    write(tmp_path / "t/b.csv", "user_id,item_id\n" + big)
    write(tmp_path / "t/a.csv", "user_id,item_id\nu1,a0\nu2,a1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    numbers = []
    for most in ("8192", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            frame, _, order = load_interactions(spark, {"name": "tabular", "path": str(tmp_path / "t"), "format": "csv"})
            assert order == ["event_order"]
            numbers.append({r.item_id: r.event_order for r in frame.collect()})
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert numbers[0] == numbers[1] == {"a0": 1, "a1": 2, **{f"b{i}": i + 3 for i in range(3000)}}


def test_ties_of_the_order_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 1)], "user_id long, item_id long, o long")
    with pytest.raises(ContractError, match="1 ties"):
        prepare(normalize(df), ["o"])


def test_nested_metadata_is_part_of_the_document(spark):
    catalog = spark.createDataFrame(
        [(1, ["rock", "jazz"], ("x", 2), {"k": "v"}, "t"), (2, None, None, None, None)],
        "item_id long, tags array<string>, pair struct<a:string,b:int>, more map<string,string>, title string",
    )
    docs = {r.item_id: r.doc for r in catalog_documents(catalog).collect()}
    assert docs == {1: '["rock","jazz"] {"a":"x","b":2} {"k":"v"} t', 2: "2"}


def test_digests_are_taken_while_writing(spark, tmp_path, small_prepared):
    """The same digest as one of its own job; a save is one write for each table."""
    from kindred.sources.digests import digest_while

    for n, df in enumerate([spark.range(1000).withColumn("x", F.col("id") % 7), spark.range(0), small_prepared.events]):
        got = digest_while(df.repartition(5), lambda seen: seen.write.parquet(str(tmp_path / f"t{n}")))
        assert got == (table_digest(df), df.count())
    small_prepared.n_users, small_prepared.n_items
    group, tracker = "one save", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    saved = save_prepared(small_prepared, str(tmp_path / "data"))
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 9
    assert [p.name for p in (tmp_path / "data").iterdir()] == [digest_token(saved.digest)]


def test_integrity_holds_null_places_equal(spark):
    from kindred.operators.split import split_integrity

    rows = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a long, b long")
    assert tuple(split_integrity(rows, rows, ["a", "b"]).first()) == (0, 0, 0)
    assert tuple(split_integrity(rows.limit(2), rows, ["a", "b"]).first())[1:] == (0, 0)
    assert tuple(split_integrity(rows.union(rows), rows, ["a", "b"]).first()) == (0, 0, 3)
