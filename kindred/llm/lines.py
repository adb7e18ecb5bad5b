"""Line dedup: segment-partition edit join, banded bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.common import components, dealt, forest, in_blocks, table, text_key, whole_runs
from kindred.session import pin

#: Edits between two lines that count as one, and code points from which edits are allowed for.
EDITS, LEAST_CHARS = 2, 20
BLOCK = 512
#: Ids of 8 bytes that may be broadcast.
SENT_IDS = 1_000_000


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 pieces of a line, sizes at most one apart, longer ones last."""
    base, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i > edits - more)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(target length, segment, start, size) of the substrings that a line looks up.

    If an indexed line of length l is within `edits`, some i-th segment of it occurs in the line at
    a place that leaves at most i edits before it and edits - i behind it.
    """
    out = []
    for target in range(max(length - edits, 0), length + 1):
        gap = length - target
        for i, (start, size) in enumerate(segments(target, edits)):
            lowest = max(0, start - i, start + gap - (edits - i))
            highest = min(length - size, start + i, start + gap + (edits - i))
            out += [(target, i, at, size) for at in range(lowest, highest + 1)]
    return out


def _indexed(edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans: dict[int, list] = {}
        for batch in batches:
            keys, owners = [], []
            # Copies inside a batch count once; what copies in other batches add changes nothing.
            for line, owner in dict(zip(batch["line"], batch["line_id"])).items():
                n = len(line)
                plan = plans.get(n)
                if plan is None:  # a line's own segments are among its probes of length n
                    plan = plans[n] = [(at, at + size, (target << 8) + i) for target, i, at, size in probes(n, edits)]
                own = {xxhash.xxh3_64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in plan}
                keys += own
                owners += [owner] * len(own)
            yield pd.DataFrame({"segment": np.array(keys, np.uint64).view(np.int64), "line_id": owners})

    return run


def within(lines: list[np.ndarray], left: np.ndarray, right: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether lines[left[k]] and lines[right[k]] are at most `edits` apart, for all k at once.

    One machine word a pair holds the vertical differences of the 2 * edits + 1 cells around the
    diagonal; each column of the table is a few bit operations on all pairs.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    swap = sizes[left] > sizes[right]
    short, long = np.where(swap, right, left), np.where(swap, left, right)  # columns run over `long`
    out = np.zeros(len(left), bool)
    order = np.argsort(sizes[long], kind="stable")
    order = order[sizes[long[order]] - sizes[short[order]] <= edits]
    for begin in range(0, len(order), 4096):
        part = order[begin : begin + 4096]
        out[part] = _banded(lines, sizes, short[part], long[part], edits)
    return out


def _banded(lines, sizes, short, long, c):
    w = 2 * c + 1
    m, n = sizes[short], sizes[long]
    rows, width = len(short), int(n.max(initial=0))
    pattern = np.full((rows, width + 2 * w), 2**32 - 1, np.uint32)  # no character: matches nothing
    text = np.full((rows, width), 2**32 - 2, np.uint32)
    for k in range(rows):
        pattern[k, c : c + m[k]] = lines[short[k]]
        text[k, : n[k]] = lines[long[k]]
    one, mask = np.uint64(1), np.uint64((1 << w) - 1)
    bits = (one << np.arange(w, dtype=np.uint64))[None, :]
    # Band of column j: pattern rows j - c .. j + c. Above the table the differences are zero.
    vp = np.full(rows, ((1 << w) - 1) ^ ((1 << c) - 1), np.uint64)
    vn = np.zeros(rows, np.uint64)
    score = np.minimum(m, c)  # down the lower end of the band, then along the last pattern row
    for j in range(width):
        alive = j < n
        if not alive.any():
            break
        eq = ((pattern[:, j : j + w] == text[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        low = d0 >> one
        vp_new = (hn | ~(low | hp)) & mask
        vn_new = low & hp
        end = j + c < m
        step = 1 - ((d0 >> np.uint64(2 * c)) & one).astype(np.int64)
        at = np.clip(m - 1 - j + c, 0, 2 * c).astype(np.uint64)
        along = ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64)
        score += np.where(alive, np.where(end, step, along), 0)
        vp, vn = vp_new, vn_new
    return score <= c


def _near(edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, bounds in whole_runs(batches, ["segment", "left", "right"]):
            ids, which = np.unique(piece["line_key"].to_numpy(), return_inverse=True)
            first = np.full(len(ids), -1)
            first[which[::-1]] = np.arange(len(piece))[::-1]
            texts = piece["line"].to_numpy()
            lines = [np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in first]
            # An edit changes a count of characters by two at the most.
            counts = np.stack([np.bincount(x & 31, minlength=32) for x in lines]).astype(np.int32)
            own, left, right = piece["own"].to_numpy(), piece["left"].to_numpy(), piece["right"].to_numpy()
            pairs = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo == 2:
                    pairs.append(which[lo:hi][None, :])
                    continue
                a = lo + np.flatnonzero(own[lo:hi] == left[lo])
                b = lo + np.flatnonzero(own[lo:hi] == right[lo])
                for k in a:
                    at = b[b > k] if left[lo] == right[lo] else b
                    far = np.abs(counts[which[at]] - counts[which[k]]).sum(axis=1)
                    near = which[at[far <= 2 * edits]]
                    pairs.append(np.stack([np.full(len(near), which[k]), near], axis=1))
            links = np.concatenate(pairs)
            links = np.unique(np.sort(links, axis=1), axis=0)  # two lines can share several segments
            links = links[(links[:, 0] != links[:, 1])]
            links = links[np.abs(counts[links[:, 0]] - counts[links[:, 1]]).sum(axis=1) <= 2 * edits]
            keep = within(lines, links[:, 0], links[:, 1], edits)
            label = forest(len(ids), links[keep, 0], links[keep, 1])
            far = label != np.arange(len(ids))
            if far.any():
                yield pd.DataFrame({"a": ids[far], "b": ids[label[far]]})

    return run


def line_classes(lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """`line`s, copies allowed -> (node, root), keys of lines that some other line is linked with."""
    known = lines.where(F.length("line") >= least).select("line", F.xxhash64("line").alias("line_id"))
    index = known.mapInPandas(_indexed(edits), "segment long, line_id long")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = index.repartition(parts, "segment")  # one exchange for the aggregate and the join
    shared = index.groupBy("segment").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo < hi").select("segment")
    met = pin(index.join(shared, "segment").distinct())
    needed = pin(met.select("line_id").distinct())
    # Few lines meet another: their ids go to all tasks if they are few, else the lines move.
    if needed.count() <= SENT_IDS:
        needed = F.broadcast(needed)
    texts = pin(known.join(needed, "line_id", "left_semi").distinct().withColumn("line_key", text_key("line")))
    pieces = in_blocks(met.join(texts, "line_id"), "segment", "line_key", BLOCK)
    return components(dealt(pieces, "segment", "left", "right").mapInPandas(_near(edits), "a binary, b binary"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, n_lines, n_removed = [], [], []
        for text, gone in zip(batch["text"], batch["gone"]):
            parts = [] if text is None else text.split("\n")
            out = set() if gone is None else set(gone)
            kept.append(None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in out))
            n_lines.append(len(parts))
            n_removed.append(len(out))
        yield batch.drop(columns="gone").assign(kept_text=kept, n_lines=n_lines, n_removed=n_removed)


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """The columns of `docs`, then kept_text, n_lines, n_removed.

    Lines end at line feeds. Equal lines are one; so are lines of at least `least` code points that
    are at most `edits` insertions, deletions and substitutions apart, and lines linked through
    others. Of each such class the first line stays, by (doc_id, null last; hash of the text;
    place); all others go. Empty lines always stay. Null texts stay null and have no lines. Rows
    that repeat doc_id and text are alike: all keep what the first keeps. Columns of these names in
    `docs` are replaced.
    """
    docs = docs.drop("kept_text", "n_lines", "n_removed", "gone", "text_hash")
    own = [F.col("doc_id").isNull().alias("anonymous"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("number"), text_key().alias("text_hash")]
    # Keys of a text are worked out before its lines are, once a text.
    parts = docs.select(*own, F.split("text", "\n").alias("parts"))
    rows = parts.select("anonymous", "number", "text_hash", F.posexplode("parts").alias("at", "line")).where("line <> ''")
    linked = line_classes(rows.select("line"), edits, least)
    places = pin(rows.select("anonymous", "number", "text_hash", "at", text_key("line").alias("line_key")))
    classed = places.join(linked, places["line_key"] == linked["node"], "left").select(
        "anonymous", "number", "text_hash", "at", F.coalesce("root", "line_key").alias("line_class")
    )
    place = F.struct("anonymous", "number", "text_hash", "at")
    first = classed.groupBy("line_class").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    gone = classed.join(first, "line_class").where(place != F.col("first"))
    gone = pin(gone.groupBy("anonymous", "number", "text_hash").agg(F.collect_set("at").alias("gone")))
    keyed = docs.select("*", *own)
    joined = keyed.join(gone, ["anonymous", "number", "text_hash"], "left").select(*docs.columns, "gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInPandas(_kept, f"{schema}, kept_text string, n_lines long, n_removed long")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
