"""Answering request tables: users and sessions mixed, from a stored model alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.recommend import (
    MAX_TOP_K,
    attach_metadata,
    known_user_batch,
    recommend,
    request_status,
    session_batch,
    with_exhaustion,
    within_depth,
)
from kindred.operators.split import Prepared, dense_index
from kindred.plans.fitted import KNOWN_USER, FittedModel, ItemSpace
from kindred.session import pin
from kindred.sources.store import StoredModel

DEFAULT_TOP_K = 10


@dataclass
class Server:
    """A model with what serving needs: items, training rows (user_id, item_id, value), users, catalog."""

    model: FittedModel
    space: ItemSpace
    train: DataFrame
    users: DataFrame
    catalog: DataFrame

    @staticmethod
    def of(stored: StoredModel) -> "Server":
        """From a stored model and nothing else: the dataset need not be at hand."""
        items = pin(dense_index(stored.catalog.select("item_id"), "item_id"))
        space = ItemSpace(items, int(stored.manifest["catalog_size"]))
        return Server(stored.model, space, stored.train, stored.users, stored.catalog)

    @staticmethod
    def prepared(model: FittedModel, data: Prepared) -> "Server":
        space = ItemSpace(data.indexed_items, data.n_items)
        return Server(model, space, data.ratings("train"), data.users, data.catalog)

    def request_schema(self) -> str:
        """DDL of one request a row, with ids of the types that the model was trained on."""
        user = self.users.schema["user_id"].dataType.simpleString()
        item = self.space.items.schema["item_id"].dataType.simpleString()
        return (
            f"request_id string, user_id {user}, top_k int, exclude_seen boolean, "
            f"interactions array<struct<item_id:{item},value:double,timestamp:timestamp>>"
        )

    def answer(self, requests: DataFrame, interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(recommendations with metadata, status) of a table of requests.

        ``requests`` is (request_id, user_id, top_k, exclude_seen) with unique request ids; those
        without a user are sessions, whose rows are in ``interactions`` (request_id, pos, item_id,
        value[, timestamp]). A null top_k is 10, a null exclude_seen hides what was seen. Every
        request gets one status row; a request that is not ``ok`` gets nothing else. Users and
        sessions take one plan each, whatever they ask for.
        """
        requests = requests.withColumns({
            "top_k": F.coalesce("top_k", F.lit(DEFAULT_TOP_K)),
            "exclude_seen": F.coalesce("exclude_seen", F.lit(True)),
        })
        status = pin(request_status(requests, interactions, self.users, self.space.items, self.model.modes))
        good = pin(requests.join(status.where(F.col("status") == "ok").select("request_id", "mode"), "request_id"))
        deepest = {r["mode"]: r["k"] for r in good.groupBy("mode").agg(F.max("top_k").alias("k")).collect()}
        parts = []
        for mode, k in sorted(deepest.items()):
            mine = good.where(F.col("mode") == mode)
            if mode == KNOWN_USER:
                batch = known_user_batch(mine, self.train)
            else:
                batch = session_batch(interactions.join(mine.select("request_id"), "request_id", "left_semi"))
            hide = mine.where("exclude_seen").select("request_id")
            found = recommend(self.model, batch, self.space, min(int(k), MAX_TOP_K), hide)
            parts.append(within_depth(found, mine))
        if parts:
            found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        else:
            kind = requests.schema["request_id"].dataType.simpleString()
            item = self.space.items.schema["item_id"].dataType.simpleString()
            found = requests.sparkSession.createDataFrame([], f"request_id {kind}, item_id {item}, score double, rank bigint")
        found = pin(found)
        return attach_metadata(found, self.catalog), with_exhaustion(status, found)
