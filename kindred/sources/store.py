"""Content-addressed storage of prepared datasets and fitted models as Parquet tables.

Tables are written first and the manifest last, so a folder with a manifest is complete.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.numbers import clean_metadata, is_finite
from kindred.operators.positions import hot_groups
from kindred.operators.split import Prepared, Split
from kindred.plans.fitted import FittedModel
from kindred.session import hadoop_path
from kindred.sources.digests import (
    canonical_json,
    digest_aggregates,
    digest_of,
    digest_token,
    digest_while,
    plain,
    table_digest,
    value_digest,
)
from kindred.sources.tables import path_exists

SCHEMA_VERSION = 1
CONTRACT = {
    "interaction": {"required": ["user_id", "item_id"], "optional": ["value", "timestamp"]},
    "recommendation": ["item_id", "score", "metadata"],
}


class IntegrityError(ValueError):
    """A stored dataset or model is missing parts, altered or incompatible."""


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_manifest(spark: SparkSession, path: str, manifest: dict[str, Any]) -> None:
    text = canonical_json(manifest)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/manifest"
    )


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise IntegrityError(f"no complete manifest in {path}")
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
        manifest = json.loads(rows[0]["value"])
    except (IndexError, ValueError) as exc:
        raise IntegrityError("the manifest is not readable") from exc
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise IntegrityError("unsupported schema version")
    return manifest


def _check_name(path: str, digest: str) -> None:
    try:
        token = digest_token(digest)
    except ValueError as exc:
        raise IntegrityError("the recorded digest is invalid") from exc
    if path.rstrip("/").rsplit("/", 1)[-1] != token:
        raise IntegrityError("the folder name does not match the digest")


# --------------------------------------------------------------------------- prepared datasets


def dataset_digest(prepared: Prepared) -> str:
    basis = {"settings": prepared.settings, "events": table_digest(prepared.events),
             "catalog": table_digest(prepared.catalog)}
    return value_digest(basis)


LABELS = ("train", "validation", "test")


def _staging(parent: str) -> str:
    return f"{parent}/.staging-{uuid.uuid4().hex}"


def _settle(spark: SparkSession, staging: str, path: str) -> None:
    """Give a complete folder its name; one that is already there and complete is kept instead."""
    file_system, source = hadoop_path(spark, staging)
    _, target = hadoop_path(spark, path)
    if path_exists(spark, f"{path}/manifest/_SUCCESS"):
        file_system.delete(source, True)
        return
    file_system.delete(target, True)  # what an ended run has left
    file_system.mkdirs(target.getParent())
    if not file_system.rename(source, target):
        raise OSError(f"{staging} could not be renamed to {path}")


def save_prepared(prepared: Prepared, parent: str) -> Prepared:
    """Write under the digest; an existing complete folder is reused.

    Every table is written once, its digest and number of rows taken on the way, and the folder gets
    its name when all is there.
    """
    spark, staging = prepared.events.sparkSession, _staging(parent)
    events, rows = digest_while(
        prepared.events, lambda df: df.write.partitionBy("split").parquet(f"{staging}/events")
    )
    catalog, _ = digest_while(prepared.catalog, lambda df: df.write.parquet(f"{staging}/catalog"))
    digest = value_digest({"settings": prepared.settings, "events": events, "catalog": catalog})
    path = f"{parent}/{digest_token(digest)}"
    write_manifest(spark, staging, {
        "schema_version": SCHEMA_VERSION,
        "dataset_digest": digest,
        "settings": prepared.settings,
        "shape": [prepared.n_users, prepared.n_items],
        "event_count": rows,
        "payloads": {"events": events, "catalog": catalog},
    })
    _settle(spark, staging, path)
    return load_prepared(spark, path, verify=False)


def load_prepared(spark: SparkSession, path: str, verify: bool = True) -> Prepared:
    manifest = read_manifest(spark, path)
    _check_name(path, str(manifest.get("dataset_digest", "")))
    try:
        events = spark.read.parquet(f"{path}/events")
        catalog = spark.read.parquet(f"{path}/catalog")
    except Exception as exc:
        raise IntegrityError("a dataset table is missing or unreadable") from exc
    settings = manifest["settings"]
    prepared = Prepared(
        events=events, order=tuple(settings["order"]), split=Split(**settings["split"]),
        catalog=catalog, adapter=settings["adapter"], digest=manifest["dataset_digest"],
        hot_users=hot_groups(events, ["user_id"]),
    )
    if verify:
        _verify_prepared(prepared, manifest)
    return prepared


def _verify_prepared(prepared: Prepared, manifest: dict[str, Any]) -> None:
    """Digest, shape, labels and order of the events from one aggregate over them."""
    events = prepared.events
    row = events.agg(
        *digest_aggregates(events),
        F.count_if(~F.coalesce(F.col("split").isin(*LABELS), F.lit(False))).alias("unlabelled"),
        F.count_distinct(F.struct(*prepared.order)).alias("places"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"),
    ).first().asDict()
    found = {"events": digest_of(events, row), "catalog": table_digest(prepared.catalog)}
    if found != manifest["payloads"]:
        raise IntegrityError("table digests differ from the manifest")
    if value_digest({"settings": prepared.settings, **found}) != manifest["dataset_digest"]:
        raise IntegrityError("the dataset digest does not follow from its content")
    if [row["users"], row["items"]] != manifest["shape"]:
        raise IntegrityError("the shape does not match the manifest")
    if row["unlabelled"] or row["places"] != row["rows"] or row["rows"] != manifest["event_count"]:
        raise IntegrityError("split rows are incomplete or overlapping")


# --------------------------------------------------------------------------- models


@dataclass
class StoredModel:
    path: str
    manifest: dict[str, Any]
    model: FittedModel
    train: DataFrame
    users: DataFrame
    catalog: DataFrame


def _payloads(model: FittedModel, prefix: str = "model") -> dict[str, DataFrame]:
    out = {f"{prefix}_{name}": df for name, df in model.tables.items()}
    for n, part in enumerate(model.components):
        out |= _payloads(part, f"{prefix}_component{n}")
    return out


def _shape(model: FittedModel) -> dict[str, Any]:
    return {
        "plugin": model.plugin, "runtime": model.runtime, "modes": list(model.modes),
        "params": plain(model.params), "tables": sorted(model.tables),
        "components": [_shape(c) for c in model.components],
    }


def _identity(manifest: dict[str, Any]) -> dict[str, Any]:
    keys = ("schema_version", "model", "dataset_digest", "config", "payloads", "catalog_size")
    return {k: manifest[k] for k in keys}


def payload_violations(model: FittedModel, items: DataFrame) -> dict[str, int]:
    """Counts of non-finite values, unknown items and odd dimensions; empty when all is well.

    One aggregate for each payload table.
    """
    found: dict[str, int] = {}

    def count(df: DataFrame, **bad) -> None:
        row = df.agg(*[F.count_if(c).alias(n) for n, c in bad.items()]).first()
        found.update({f"{model.plugin}.{n}": row[n] for n in bad if row[n]})

    tables = model.tables
    known = items.select(F.col("item_id").alias("_id"), F.lit(True).alias("_known")).distinct()
    if "similarity" in tables:
        s = tables["similarity"]
        for side in ("item", "other"):
            s = s.join(known.toDF(f"_{side}", f"_{side}_known"), F.col(side) == F.col(f"_{side}"), "left")
        count(
            s, non_finite=~is_finite(F.col("weight")), unknown_item=F.col("_item_known").isNull(),
            unknown_other=F.col("_other_known").isNull(),
        )
    if "scores" in tables:
        both = known.join(tables["scores"], F.col("_id") == F.col("item_id"), "full")
        count(
            both, bad_scores=F.col("item_id").isNotNull() & ~F.coalesce(is_finite(F.col("score")), F.lit(False)),
            unscored_items=F.col("item_id").isNull(),
        )
    dims = set()
    for name in ("users", "items"):
        if name in tables:
            df = tables[name]
            odd = F.exists("vec", lambda x: ~is_finite(x))
            row = df.agg(F.count_if(odd).alias("odd"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
            if row["odd"]:
                found[f"{model.plugin}.{name}_non_finite"] = row["odd"]
            dims |= {row["lo"], row["hi"]} - {None}
    if model.runtime == "embedding" and len(dims) > 1:
        found[f"{model.plugin}.dimensions"] = len(dims)
    for part in model.components:
        found |= payload_violations(part, items)
    return found


def save_model(
    model: FittedModel, prepared: Prepared, parent: str, config: dict[str, Any] | None = None
) -> StoredModel:
    """Write payload tables, training rows, users and catalog, addressed by their content."""
    spark = prepared.events.sparkSession
    wrong = payload_violations(model, prepared.items)
    if wrong:
        raise IntegrityError(f"invalid model payload: {wrong}")
    catalog = prepared.items.join(clean_metadata(prepared.catalog), "item_id", "left")
    tables = {
        **_payloads(model), "train": prepared.ratings("train"),
        "users": prepared.users, "catalog": catalog,
    }
    staging, payloads = _staging(f"{parent}/{model.plugin}"), {}
    for name, df in sorted(tables.items()):
        payloads[name], _ = digest_while(df, lambda seen, name=name: seen.write.parquet(f"{staging}/{name}"))
    manifest: dict[str, Any] = {
        "schema_version": SCHEMA_VERSION,
        "model": _shape(model),
        "dataset_digest": prepared.digest or dataset_digest(prepared),
        "config": plain(config or {}),
        "payloads": payloads,
        "catalog_size": prepared.n_items,
    }
    manifest["artifact_id"] = value_digest(_identity(manifest))
    path = f"{parent}/{model.plugin}/{digest_token(manifest['artifact_id'])}"
    manifest |= {"contract": CONTRACT, "created_at": datetime.now(UTC).isoformat()}
    write_manifest(spark, staging, manifest)
    _settle(spark, staging, path)
    return load_model(spark, path, verify=False)


def _rebuild(spark: SparkSession, path: str, shape: dict[str, Any], prefix: str) -> FittedModel:
    return FittedModel(
        shape["plugin"], shape["runtime"], tuple(shape["modes"]),
        {t: spark.read.parquet(f"{path}/{prefix}_{t}") for t in shape["tables"]},
        shape["params"],
        tuple(
            _rebuild(spark, path, c, f"{prefix}_component{n}")
            for n, c in enumerate(shape["components"])
        ),
    )


def load_model(spark: SparkSession, path: str, verify: bool = True) -> StoredModel:
    manifest = read_manifest(spark, path)
    _check_name(path, str(manifest.get("artifact_id", "")))
    names = list(manifest["payloads"])
    if any("/" in n or n.startswith(".") for n in names):
        raise IntegrityError("unsafe payload name")
    try:
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
        model = _rebuild(spark, path, manifest["model"], "model")
    except Exception as exc:
        raise IntegrityError("a model table is missing or unreadable") from exc
    if verify:
        for name, df in tables.items():
            if table_digest(df) != manifest["payloads"][name]:
                raise IntegrityError(f"payload differs from its digest: {name}")
        if value_digest(_identity(manifest)) != manifest["artifact_id"]:
            raise IntegrityError("the model identity does not follow from its content")
        if tables["catalog"].count() != manifest["catalog_size"]:
            raise IntegrityError("the catalog size does not match the manifest")
        wrong = payload_violations(model, tables["catalog"])
        if wrong:
            raise IntegrityError(f"invalid model payload: {wrong}")
    return StoredModel(path, manifest, model, tables["train"], tables["users"], tables["catalog"])


def describe(stored: StoredModel) -> DataFrame:
    """One row: contract, id, plugin, modes, runtime, catalog size."""
    m = stored.manifest
    spark = stored.train.sparkSession
    row = (canonical_json(m["contract"]), m["artifact_id"], m["model"]["plugin"],
           m["model"]["modes"], m["model"]["runtime"], m["catalog_size"])
    return spark.createDataFrame(
        [row], "contract string, artifact_id string, plugin string, capabilities array<string>, "
        "runtime string, catalog_size bigint",
    )
