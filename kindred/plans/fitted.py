"""What a fit returns and what a batch of queries looks like."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

KNOWN_USER = "known_user"
HISTORY = "history"


@dataclass
class FittedModel:
    """Payload tables and parameters of a fitted retriever, model or hybrid."""

    plugin: str
    runtime: str
    modes: tuple[str, ...]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    components: tuple["FittedModel", ...] = ()


@dataclass
class QueryBatch:
    """Many queries at once.

    ``requests`` is (request_id), ``vector`` is (request_id, item_id, value) with repeats summed,
    ``last`` is (request_id, item_id), ``recent`` is (request_id, item_id, pos). For known users
    the request id is the user id, unless ``user_of`` (request_id, user_id) says whose request it is.
    ``hot`` lists requests too large for one task.
    """

    mode: str
    requests: DataFrame
    vector: DataFrame
    last: DataFrame | None = None
    recent: DataFrame | None = None
    hot: DataFrame | None = None
    user_of: DataFrame | None = None

    def of_users(self, table: DataFrame) -> DataFrame:
        """A table by user_id as one by request_id, for the requests of the batch."""
        if self.user_of is not None:
            return table.join(self.user_of, "user_id").drop("user_id")
        mine = table.withColumnRenamed("user_id", "request_id")
        return mine.join(self.requests.select("request_id"), "request_id", "left_semi")


@dataclass
class ItemSpace:
    """All items: (item_id, pos) with the 1-based position in id order, and their number."""

    items: DataFrame
    n: int
