"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.common import components, dealt, forest, in_blocks, runs, table, text_key
from kindred.session import pin

WORDS, SIMILARITY = 5, 0.8
#: Hash values of a sketch, and values that one band joins on: a pair at the threshold is missed by
#: all bands with probability (1 - 0.8 ** 4) ** 32 < 5e-8.
HASHES, BAND = 128, 4
#: Hash values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
BLOCK = 512

_RNG = np.random.default_rng(20_240)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_WORD = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; fewer words are one run."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    values = []
    for w in words:
        value = seen.get(w)
        if value is None:
            value = seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        values.append(value)
    hashes = np.array(values, np.uint64)
    if len(hashes) < WORDS:
        hashes = np.concatenate([hashes, np.zeros(WORDS - len(hashes), np.uint64)])
    n = len(hashes) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for j in range(WORDS):
        total = (total ^ (total >> np.uint64(29))) + hashes[j : j + n] * _WORD[j]
    return np.unique(mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(hashes), 1024):
        part = hashes[start : start + 1024, None] * _MULTIPLY + _ADD
        np.minimum(out, (part >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def _least_matches(similarity: float = SIMILARITY) -> np.ndarray:
    """For 1, 2, ... compared steps: the matches below which a pair is dropped.

    With a uniform prior on the similarity, m matches of n give a Beta(m + 1, n - m + 1) posterior;
    its part above the threshold is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, least = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= TOLERANCE:
                least = m
                break
        out.append(least)
    return np.array(out)


LEAST = _least_matches()


def survivors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sets of sketches that outlive the step-by-step comparison."""
    i, j = np.divmod(np.arange(len(left) * len(right)), len(right))
    matches = np.zeros(len(i), np.int32)
    for step, least in enumerate(LEAST):
        at = slice(step * STEP, (step + 1) * STEP)
        for start in range(0, len(i), 65_536):
            part = slice(start, start + 65_536)
            matches[part] += (left[i[part], at] == right[j[part], at]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard of sets[i], sets[j] for index pairs."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shared = np.zeros(len(i), np.int64)
    if len(i) <= 8 * len(sets):
        for k, (a, b) in enumerate(zip(i, j)):
            x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            at = np.searchsorted(y, x)
            shared[k] = (y[np.minimum(at, len(y) - 1)] == x).sum()
    else:  # most sets are alike: one product of 0/1 tables gives all intersections
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        product = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(inverse, kind="stable")
        inverse, row = inverse[order], row[order]
        for start in range(0, len(values), 8192):
            lo, hi = np.searchsorted(inverse, [start, start + 8192])
            part = np.zeros((len(sets), min(8192, len(values) - start)), np.float32)
            part[row[lo:hi], inverse[lo:hi] - start] = 1
            product += part @ part.T
        shared = product[i, j].astype(np.int64)
    # In whole numbers of a millionth, so that a pair at the threshold is never lost to rounding.
    return shared * 1_000_000 >= np.int64(round(SIMILARITY * 1_000_000)) * (sizes[i] + sizes[j] - shared)


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[str, int] = {}
        digests, sketches = [], []
        for text in batch["text"]:
            values = shingles(text, seen)
            if len(values):
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketches.append(sketch(values).tobytes())
            else:
                digests.append(None)
                sketches.append(None)
        yield pd.DataFrame({"key": batch["key"], "class": digests, "sketch": sketches})


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        values = np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(len(batch), HASHES // BAND, BAND).astype(np.uint64)
        total = np.broadcast_to(np.arange(HASHES // BAND, dtype=np.uint64), values.shape[:2]).copy()
        for j in range(BAND):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
        n = values.shape[1]
        yield pd.DataFrame({"band": total.ravel().view(np.int64), "class": np.repeat(batch["class"].to_numpy(), n)})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a spanning forest of each bucket's pairs that outlive the comparison."""
    for piece in runs(batches, ["band", "left", "right"]):
        values = np.frombuffer(b"".join(piece["sketch"]), np.uint32).reshape(len(piece), HASHES)
        own, ids = piece["own"].to_numpy(), piece["class"].to_numpy()
        first, second = _sides(piece)
        i, j = survivors(values[first], values[second])
        i, j = first[i], second[j]
        keep = i < j if piece["left"].iloc[0] == piece["right"].iloc[0] else own[i] != own[j]
        label = forest(len(piece), i[keep], j[keep])
        far = label != np.arange(len(piece))
        if far.any():
            yield pd.DataFrame({"a": ids[far], "b": ids[label[far]]})


def _sides(piece: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    own = piece["own"].to_numpy()
    return np.flatnonzero(own == piece["left"].iloc[0]), np.flatnonzero(own == piece["right"].iloc[0])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per piece and class: documents linked to it, and its links of a spanning forest."""
    for piece in runs(batches, ["root", "left", "right"]):
        seen: dict[str, int] = {}
        sets = [shingles(t, seen) for t in piece["text"]]
        values = np.stack([sketch(s) for s in sets])
        ids, copies = piece["class"].to_numpy(), piece["copies"].to_numpy()
        first, second = _sides(piece)
        i, j = survivors(values[first], values[second])
        i, j = first[i], second[j]
        if piece["left"].iloc[0] == piece["right"].iloc[0]:
            keep = i < j
            i, j = i[keep], j[keep]
        # A candidate is a pair that meets in a band.
        bands = values.reshape(len(values), -1, BAND)
        keep = np.zeros(len(i), bool)
        for start in range(0, len(i), 16_384):
            part = slice(start, start + 16_384)
            keep[part] = (bands[i[part]] == bands[j[part]]).all(axis=2).any(axis=1)
        i, j = i[keep], j[keep]
        keep = exact(sets, i, j)
        i, j = i[keep], j[keep]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = forest(len(ids), i, j)
        some = links > 0
        if some.any():
            yield pd.DataFrame({"class": ids[some], "links": links[some].astype(np.int64), "to": ids[label[some]]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), copy_class, class_id, n_links for every row of `docs`.

    Two rows are linked if the Jaccard similarity of their sets of runs of five words is 0.8 or
    more; a text of one to four words is one run. class_id is the least doc_id reachable by links,
    n_links the number of other rows linked directly. Rows with equal sets are one class that is
    compared once. Texts without a word (null, empty, white space) are linked with nothing: their
    class_id is their doc_id, n_links 0. Null doc_ids count as rows but never name a class unless
    all are null; repeated rows are linked with each other.
    """
    keyed = docs.select("doc_id", "text", text_key().alias("key"))
    texts = keyed.select("key", "text")
    rows = pin(keyed.select("doc_id", "key").groupBy("key", "doc_id").agg(F.count("*").alias("times")))
    sketches = pin(texts.mapInPandas(_sketched, "key binary, class binary, sketch binary").dropDuplicates(["key"]))
    per_text = rows.groupBy("key").agg(F.sum("times").alias("times"), F.min("doc_id").alias("least"))
    known = pin(sketches.select("key", "class").where("class is not null").join(per_text, "key"))
    classes = pin(known.groupBy("class").agg(F.sum("times").alias("copies"), F.min("least").alias("least"), F.min("key").alias("key")))
    unique = sketches.join(classes.select("key"), "key").select("class", "sketch")
    unique = pin(unique)
    bands = pin(unique.mapInPandas(_bands, "band long, class binary"))
    shared = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    buckets = bands.join(shared, "band").join(unique, "class")
    pieces = dealt(in_blocks(buckets, "band", "class", BLOCK), "band", "left", "right")
    likely = components(pieces.mapInPandas(_near, "a binary, b binary"))
    grouped = likely.withColumnRenamed("node", "class").join(classes, "class").select("class", "root", "copies", "key")
    members = grouped.join(texts.dropDuplicates(["key"]), "key").drop("key")
    pieces = dealt(in_blocks(members, "root", "class", BLOCK), "root", "left", "right")
    links = pin(pieces.mapInPandas(_verified, "class binary, links long, to binary"))
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("class").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "class")
    least = joined.join(classes.select("class", "least"), "class")
    least = joined.join(least.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("class", "class_id")
    found = classes.select("class", "copies", "least").join(counts, "class", "left").join(least, "class", "left").select(
        "class", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    found = pin(known.select("key", "class").join(found, "class"))
    out = rows.join(found, "key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.withColumn("turn", F.explode(F.expr("sequence(1L, times)")))
    return out.select("doc_id", "key", F.col("class").alias("copy_class"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
