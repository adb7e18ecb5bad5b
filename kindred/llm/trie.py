"""Prefix trie of conversations: ternary search trees per range shard, merged where shards meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.llm.common import table
from kindred.operators.positions import group_positions
from kindred.session import pin, release

#: A conversation starts with up to STEP - 1 turns of the conversation that its block of BLOCK ids begins with.
BLOCK, STEP = 5, 9
#: Bytes of a turn's id, and of the id of a prefix or of an end.
WIDTH = 16
#: Most turns in a shard on average, and fewest, when there are more tasks than such shards.
TURNS, FEW_TURNS = 200_000, 4_000

NODE = (
    "shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, gross long, once long, ends binary"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_id, bytes) of the rebuilt conversations, and (conv_id, length) of all of them."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = pin(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.sha2(same.cast("binary"), 256), 1, 2 * WIDTH).alias("turn_id"),
        F.octet_length(text).cast("long").alias("bytes"),
    ))
    # Turns with equal place and content are alike, so it does not matter which of them comes first.
    placed = group_positions(turns, ["conv_id"], [F.col("turn"), F.col("turn_id")])
    placed = pin(placed.withColumn("pos", F.col("pos") - 1).drop("turn"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % STEP
    sizes = pin(placed.groupBy("conv_id").agg(F.count("*").alias("own")))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", heads.cast("long"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = pin(convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))))
    tail = placed.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos >= h")
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_id", "bytes")
    # At most STEP - 1 turns of a base go to at most 2 * BLOCK - 1 conversations.
    first = placed.where(F.col("pos") < STEP - 1).withColumnRenamed("conv_id", "base")
    head = convs.where("k > 0").select("conv_id", "base", "k").join(first, "base").where("pos < k")
    rebuilt = pin(head.select("conv_id", "pos", "turn_id", "bytes").union(tail))
    lengths = convs.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    release(turns)
    return rebuilt, lengths


def _runs_of_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (ends, conv_id) -> one row for each run of equal `ends` in a batch."""
    for batch in batches:
        keys, ids = batch["ends"].to_numpy(), batch["conv_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        yield pd.DataFrame({
            "ends": [keys[a] for a, _ in spans], "first": np.array([ids[a] for a, _ in spans], np.int64),
            "ids": [",".join(map(str, ids[a:b].tolist())) for a, b in spans],
        })


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of ids in order -> one digest for each `ends`; a piece is forgotten once it is counted in."""
    at, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, ids in zip(batch["ends"], batch["ids"]):
            if key == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((at, state.hexdigest()))
            at, state = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["ends", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(at, state.hexdigest())], columns=["ends", "ends_sha256"])


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(ends, conv_id) -> (ends, SHA-256 of the ids in order); a large group is sorted by many tasks.

    The digest of a group needs its bytes one after the other, so one task reads them, as few long
    pieces, and keeps none.
    """
    pieces = ends.repartitionByRange(parts, "ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    pieces = pieces.mapInPandas(_runs_of_ids, "ends binary, first long, ids string")
    return pieces.repartition(parts, "ends").sortWithinPartitions("ends", "first").mapInPandas(_digests, "ends binary, ends_sha256 string")


class TernaryTree:
    """Trie whose nodes find a child by a ternary search: lower codes, higher codes, one step down.

    Node 0 is the root. A node is made after its parent, so sums run up in reverse order of making.
    """

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, code: int, parent: int) -> int:
        self.code.append(code)
        for link in (self.low, self.high, self.down):
            link.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """The node of a sequence of codes, with all that is missing on the way to it."""
        at = 0
        for code in codes:
            t = self.down[at]
            if t < 0:
                t = self.down[at] = self._new(code, at)
            while self.code[t] != code:
                link = self.low if code < self.code[t] else self.high
                if link[t] < 0:
                    link[t] = self._new(code, at)
                t = link[t]
            at = t
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root to this one."""
        way = []
        while node >= 0:
            way.append(node)
            node = self.parent[node]
        return way[::-1]


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves: sorted rows make balanced trees."""
    spans = [(0, n)]
    for lo, hi in spans:  # grows while it is read
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(lo, mid), (mid + 1, hi)]


def _shared(a: bytes, b: bytes | None) -> int:
    """Turns that two sequences begin with alike; -1 if there is no second one."""
    if b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH).reshape(n, WIDTH) for s in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def build(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard; what reaches into another shard has a `key` and the sums of this shard alone.

    A node shared with the shard before is counted there (`once`, and as a child); members, gross
    bytes and leaves add up over shards.
    """
    rows = rows.sort_values("seq", ignore_index=True)
    seqs = rows["seq"].tolist()
    before, after = (None if pd.isna(x) else bytes(x) for x in (border["before"].iloc[0], border["after"].iloc[0]))
    ids = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2).astype(np.uint64)
    codes = np.unique(ids, axis=0, return_inverse=True)[1].reshape(-1).tolist()  # the shard's dictionary, in order
    start = np.cumsum([0, *(len(s) // WIDTH for s in seqs)]).tolist()

    tree, end = TernaryTree(), [0] * len(seqs)
    for i in medians(len(seqs)):
        end[i] = tree.insert(codes[start[i] : start[i + 1]])
    n = len(tree.code)
    members, least, size, more, ends = [0] * n, [None] * n, [0] * n, [0] * n, [None] * n
    for i, (node, copies, first, sizes, goes_on, key) in enumerate(zip(end, rows["n"], rows["least"], rows["sizes"], rows["more"], rows["ends"])):
        members[node], least[node], more[node] = int(copies), int(first), int(goes_on)
        ends[node] = None if goes_on else key
        for step, v in enumerate(tree.path(node)[1:]):
            size[v] = int(sizes[step])
    # Which nodes other shards have as well, and which of these the shard before has.
    with_before, with_after = _shared(seqs[0], before), _shared(seqs[-1], after)
    counted_before = set(tree.path(end[0])[: with_before + 1])
    boundary: dict[int, bytes] = {}
    for seq, node, deep in ((seqs[0], end[0], with_before), (seqs[-1], end[-1], with_after)):
        state = hashlib.sha256()
        for v, depth in zip(tree.path(node), range(deep + 1)):
            if depth:
                state.update(seq[(depth - 1) * WIDTH : depth * WIDTH])
            boundary[v] = state.digest()[:WIDTH]
    goes_on_after = end[-1] if after is not None and with_after == tree.depth[end[-1]] else -1

    children, leaves = more[:], [int(tree.down[v] < 0 and v != goes_on_after) for v in range(n)]
    own = [0 if v in counted_before else 1 for v in range(n)]
    gross, once = [0] * n, [own[v] * size[v] for v in range(n)]
    for v in range(n - 1, 0, -1):
        p = tree.parent[v]
        gross[v] += members[v] * size[v]
        for sums in (members, leaves, gross, once):
            sums[p] += sums[v]
        children[p] += own[v]
        least[p] = least[v] if least[p] is None else min(least[p], least[v])
    up = [None if p < 0 or p in boundary else least[p] for p in tree.parent]
    return pd.DataFrame({
        "shard": np.full(n, rows["shard"].iloc[0], np.int32), "key": [boundary.get(v) for v in range(n)],
        "parent_key": [boundary.get(p) for p in tree.parent], "conv_id": least, "depth": tree.depth,
        "parent_conv_id": pd.array(up, "Int64"), "n_convs": members, "n_children": children, "n_leaves": leaves, "gross": gross, "once": once, "ends": ends,
    })


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 as the contract of `op13` names them. Turns go by (turn, null first); turns of one
    conversation with equal `turn` go by the hash of their role and text, and repeated rows are
    turns of their own. Null roles and texts are empty ones. Rows without conv_id belong to no
    conversation and are left out. The remainders are SQL's: that of a negative id is negative or 0.
    An empty table has no conversation, so no root either: the result is empty.

    Sequences of turn ids, equal ones merged, are dealt to shards by range; a shard's trie holds about
    TURNS turns at most. A conversation goes into a shard only up to the first turn that no other has
    at that place: what follows is a chain, and is written without a tree. So what one task holds of
    a conversation is 16 bytes a turn of what it may share with others.
    """
    spark = conversations.sparkSession
    rebuilt, lengths = rebuild(conversations)
    places = rebuilt.groupBy("pos", "turn_id").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    lengths = pin(lengths.join(places.groupBy("conv_id").agg(F.min("pos").alias("alone")), "conv_id", "left"))
    cut = rebuilt.join(lengths.select("conv_id", "alone", "length"), "conv_id")
    turns = cut.where("alone is null or pos <= alone").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("t"))
    seqs = lengths.join(turns, "conv_id", "left").select(
        "conv_id", F.coalesce(F.unhex(F.array_join(F.col("t.turn_id"), "")), F.lit(b"")).alias("seq"),
        F.coalesce(F.col("t.bytes"), F.array().cast("array<bigint>")).alias("sizes"),
        F.coalesce(F.col("alone") + 1 < F.col("length"), F.lit(False)).alias("more"),
    )
    seqs = pin(seqs.withColumn("ends", F.substring(F.unhex(F.sha2("seq", 256)), 1, WIDTH)))
    paths = pin(seqs.groupBy("seq", "ends", "more").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes")))
    amount = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-amount // TURNS), min(parts, amount // FEW_TURNS))
    dealt = pin(paths.repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id()))
    # One row a shard.
    by_shard = Window.orderBy("shard")
    borders = dealt.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    borders = borders.select("shard", F.lag("high").over(by_shard).alias("before"), F.lead("low").over(by_shard).alias("after"))
    nodes = pin(dealt.groupBy("shard").cogroup(borders.groupBy("shard")).applyInPandas(build, NODE))

    shared = nodes.where("key is not null")
    merged = pin(shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "gross", "once")], F.max("ends").alias("ends"),
    ))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "gross", "once", "ends"]
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.join(above, "parent_key", "left").select(*columns)
    # A shared parent is looked up by shard as well: its children in a shard are at most the shard's rows.
    there = shared.select("shard", "key").join(merged.select("key", "conv_id"), "key")
    there = there.select("shard", F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    lower = nodes.where("key is null").join(there, ["shard", "parent_key"], "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
    digests = end_digests(seqs.where("not more").select("ends", "conv_id"), max(1, min(parts, shards)))
    found = upper.union(lower).join(digests, "ends", "left").select(
        *columns[:6], (F.col("gross") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )
    last = F.col("pos") + 1 == F.col("length")
    chains = cut.where("pos > alone").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return found.union(chains)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Sequences are lists of turns; a node's subtree is found by joining every conversation's prefixes to
#: the nodes they pass.
OP13_SQL = r"""
WITH RECURSIVE tab(i, c) AS MATERIALIZED (
  SELECT i, c FROM (SELECT i, i AS c, 0 AS k FROM range(256) r(i)) WHERE k = 0),
crc(i, c, k) AS (
  SELECT i, c, 0 FROM tab UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substring(s, i, 1)) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) % 9 AS h
  FROM ids, crcs),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, list(role) OVER w AS roles, list(text) OVER w AS texts, text
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
m AS (
  SELECT conv_id, depth, md5(CAST(roles AS VARCHAR) || CAST(len(CAST(roles AS VARCHAR)) AS VARCHAR) || CAST(texts AS VARCHAR)) AS node, CAST(strlen(text) AS BIGINT) AS size FROM p
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
n AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM m GROUP BY node),
up AS (SELECT DISTINCT a.node, b.node AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
kids AS (SELECT parent, count(*) AS k FROM up GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sub AS (
  SELECT top, count(*) FILTER (WHERE k IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM below JOIN n USING (node) LEFT JOIN kids ON kids.parent = below.node GROUP BY top),
last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN last USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sub ON sub.top = n.node LEFT JOIN up USING (node) LEFT JOIN n q ON q.node = up.parent
  LEFT JOIN kids ON kids.parent = n.node LEFT JOIN ends ON ends.node = n.node
"""
