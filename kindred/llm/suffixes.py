"""Suffix-array dedup: passages of 400 bytes that start more than once in a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.common import dealt, table, text_key, whole_runs
from kindred.session import pin

LENGTH = 400
#: Bytes of the substrings whose least hash names a window, and windows in one region at the most.
GRAM, REGION = 16, 512
#: Bytes sorted in one array, and distinct regions of one name beyond which its windows are counted
#: by fingerprint over many tasks instead of sorted in one.
SHARD, HOT = 1 << 20, 4096
#: Places in a sorted array, of a few MB at the most.
PLACE = np.int32


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last is the least of all."""
    n = len(t)
    rises = np.empty(n, bool)
    rises[-1] = True
    up = np.append(t[1:] > t[:-1], True)
    at = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=PLACE), PLACE(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]  # next place where neighbours differ
    rises[:-1] = up[at]
    return rises


def _deal(queues: list[list[np.ndarray]], items: np.ndarray, chars: np.ndarray) -> None:
    order = np.argsort(chars, kind="stable")
    items, chars = items[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for part, c in zip(np.split(items, cuts), chars[np.concatenate([[0], cuts])] if len(chars) else []):
        queues[c].append(part)


def _induce(t: np.ndarray, rises: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """All suffixes sorted from the leftmost-smaller ones `low` in order: one pass up, one down.

    A bucket is worked off as arrays: what it was dealt, then round by round what that brings into
    the bucket itself (runs of one character), then its leftmost-smaller suffixes.
    """
    none = np.zeros(0, PLACE)
    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(starts, low, t[low])
    falling: list[list[np.ndarray]] = [[] for _ in range(size)]
    rising: list[list[np.ndarray]] = [[] for _ in range(size)]

    def pass_on(items, queues, c, wanted):
        before = items[items > 0] - 1
        before = before[rises[before] == wanted]
        chars = t[before]
        own = chars == c
        if not own.all():
            _deal(queues, before[~own], chars[~own])
        return before[own]

    up: list[np.ndarray] = []
    for c in range(size):
        rounds, now = [], np.concatenate(falling[c]) if falling[c] else none
        while len(now):
            rounds.append(now)
            now = pass_on(now, falling, c, False)
        up.append(np.concatenate(rounds) if rounds else none)
        for part in starts[c]:
            pass_on(part, falling, c, False)
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        rounds, now = [], np.concatenate(rising[c]) if rising[c] else none
        if c == 0:
            now = np.array([len(t) - 1], PLACE)
        while len(now):
            rounds.append(now)
            now = pass_on(now, rising, c, True)
        pass_on(up[c][::-1], rising, c, True)
        out += [*rounds, up[c][::-1]]
    return np.concatenate(out)[::-1]


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the substrings of the given sizes at a and b are equal."""
    same = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[sizes[live] > k]
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    return same


def _ranks(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of many names: pairs of ranks are named again and again.

    A rank is the number of suffixes that are surely smaller, so one that no other suffix has is
    final; only the others are sorted again.
    """
    n, width = len(names), 1
    order = np.argsort(names).astype(PLACE)
    rank, live, key = np.zeros(n, PLACE), order, names[order].astype(np.int64)
    first = np.arange(n, dtype=PLACE)  # where the live ones stand in the order
    while True:
        starts = np.append(True, key[1:] != key[:-1])
        rank[live] = np.maximum.accumulate(np.where(starts, first, 0))
        alone = starts & np.append(starts[1:], True)
        live, first = live[~alone], first[~alone]
        if not len(live):
            return order
        after = np.where(live + width < n, rank[np.minimum(live + width, n - 1)] + 1, 0)
        key = rank[live] * np.int64(n + 2) + after
        by = np.argsort(key)
        live, key = live[by], key[by]
        order[first] = live
        width *= 2


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Sorted suffixes of t (values below size; the last value is 0 and the only 0).

    Leftmost-smaller substrings are sorted by an induction from their unsorted starts and named;
    the string of names is sorted in the same way while it has few names, else by doubling; its
    order induces the order of all suffixes.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, PLACE)
    rises = _types(t)
    low = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(PLACE)
    if len(low) > 1:
        is_low = np.zeros(n, bool)
        is_low[low] = True
        rough = _induce(t, rises, low, size)
        rough = rough[is_low[rough]]
        ends = np.append(low[1:], PLACE(n - 1))
        sizes = np.zeros(n, PLACE)
        sizes[low] = ends - low + 1
        a, b = rough[:-1], rough[1:]
        alike = sizes[a] == sizes[b]
        alike[alike] = _same(t, a[alike], b[alike], sizes[a[alike]])
        names = np.zeros(n, PLACE)
        names[rough] = np.concatenate([[0], np.cumsum(~alike)])
        names = names[low]
        del rough, sizes, is_low, a, b, alike
        many = int(names.max()) + 1
        if many == len(low):
            order = np.argsort(names)
        elif many <= 1024:
            order = suffix_array(names, many)
        else:
            order = _ranks(names)
        low = low[order]
    return _induce(t, rises, low, size)


def repeated_prefixes(t: np.ndarray, sa: np.ndarray, firsts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: common prefix with the suffix before it in order, and with the one after it.

    The permuted common prefixes follow text order: one less than at the place before, unless the
    characters before the two suffixes differ. Only there, and at `firsts`, is it counted, up to
    `most`.
    """
    n = len(t)
    before = np.full(n, -1, PLACE)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=PLACE)
    chain = np.zeros(n, bool)
    ok = (at > 0) & (before > 0)
    chain[ok] = t[at[ok] - 1] == t[before[ok] - 1]
    chain[firsts] = False
    heads = np.flatnonzero(~chain)
    common = np.zeros(n, PLACE)
    four = np.concatenate([t, np.zeros(most + 8, t.dtype)]).astype(np.uint64)
    four = four[:-1] | four[1:] << np.uint64(16)
    four = four[:-2] | four[2:] << np.uint64(32)
    live = heads[before[heads] >= 0]
    k = 0
    while len(live) and k < most:
        differ = four[live + k] ^ four[np.minimum(before[live] + k, len(four) - 1)]
        whole = differ == 0
        low = differ[~whole]
        low = low & (~low + np.uint64(1))
        common[live[~whole]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 16
        live = live[whole]
        k += 4
    common[live] = most
    last = np.maximum.accumulate(np.where(chain, PLACE(-1), at))
    common = np.maximum(common[last] - (at - last), 0)
    common[before < 0] = 0
    after = np.zeros(n, PLACE)
    after[sa[:-1]] = common[sa[1:]]
    return common, after


def repeated_windows(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per region: the starts of its substrings of `length` bytes that start elsewhere here too."""
    joined = np.frombuffer(b"\0".join([*regions, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum([len(r) + 1 for r in regions])
    joined[ends - 1] = 1
    t = np.append(joined, np.uint16(0))
    firsts = np.concatenate([[0], ends[:-1]])
    sa = suffix_array(t, 258)
    before, after = repeated_prefixes(t, sa, firsts, max(map(len, regions)) + 1)
    common = np.maximum(before, after) >= length
    out = []
    for first, end in zip(firsts, ends):
        out.append(np.flatnonzero(common[first : max(end - length, first)]))
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    return x


def regions_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(text, first window, windows, name, hash of the bytes, periodic) for all texts of at least `length`.

    A window's name is the least hash of the substrings of GRAM bytes in it, so equal windows have
    equal names; a region is a run of windows of one name. In a periodic region the named substring
    occurs again, so that its windows may repeat each other.
    """
    kept = [i for i, x in enumerate(texts) if len(x) >= length]
    begin = 0
    while begin < len(kept):
        stop, total = begin, 0
        while stop < len(kept) and total < SHARD:
            total += len(texts[kept[stop]])
            stop += 1
        part, begin = kept[begin:stop], stop
        sizes = np.array([len(texts[i]) for i in part])
        data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        eight = _words(data)
        grams = (eight[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
        grams = (grams ^ grams >> np.uint64(31)) * np.uint64(0xFF51AFD7ED558CCD)
        grams ^= grams >> np.uint64(33)
        width, span = length - GRAM + 1, 1
        least = grams
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(part)), sizes)[: len(least)]
        at = np.arange(len(least)) - np.repeat(ends - sizes, sizes)[: len(least)]
        valid = at + length <= sizes[owner]
        cut = np.ones(len(least), bool)
        cut[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
        head = np.maximum.accumulate(np.where(cut, np.arange(len(least)), 0))
        cut |= (np.arange(len(least)) - head) % REGION == 0
        starts = np.flatnonzero(cut & valid)
        stops = np.append(np.flatnonzero(cut), len(least))
        stops = stops[np.searchsorted(stops, starts, side="right")]
        last = ends[owner[starts]] - length - (ends - sizes)[owner[starts]]  # last window of the text
        names = least[starts].view(np.int64)
        for s, e, o, name, most in zip(starts.tolist(), stops.tolist(), owner[starts].tolist(), names.tolist(), last.tolist()):
            first = int(at[s])
            n = min(e - s, most - first + 1)
            text = texts[part[o]]
            content = xxhash.xxh3_64_intdigest(text[first : first + n + length - 1]) - (1 << 63)
            yield part[o], first, n, name, content, np.count_nonzero(grams[s : s + n + width - 1] == least[s]) > 1


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of batches in pieces of about SHARD bytes of data, so that what is made of a piece stays small."""
    for batch in batches:
        sizes = batch["data"].map(len).to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SHARD)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(batch)]):
            yield batch.iloc[start:stop]


def _regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches):
        texts = [bytes(x) for x in batch["data"]]
        keys = batch["key"].to_numpy()
        rows = list(regions_of(texts))
        if rows:
            own, first, n, name, content, periodic = map(list, zip(*rows))
            at = [xxhash.xxh3_64_intdigest(keys[o] + f.to_bytes(8, "little")) - (1 << 63) for o, f in zip(own, first)]
            yield pd.DataFrame({"key": keys[own], "first": first, "windows": n, "name": name, "content": content, "place": at, "periodic": periodic})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with the regions wanted of them -> regions with their bytes."""
    for batch in _pieces(batches):
        rows = []
        for data, wanted in zip(batch["data"], batch["wanted"]):
            for w in wanted:
                rows.append((w["name"], w["content"], w["hot"], bytes(data[w["first"] : w["first"] + w["windows"] + LENGTH - 1])))
        yield pd.DataFrame(rows, columns=["name", "content", "hot", "bytes"])


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist())) if len(starts) else []


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for piece, _ in whole_runs(batches, ["name"], SHARD // (2 * LENGTH)):
        rows = []
        for name, content, starts in zip(piece["name"], piece["content"], repeated_windows([bytes(x) for x in piece["bytes"]])):
            rows += [(name, content, a, b) for a, b in _spans(starts)]
        yield pd.DataFrame(rows, columns=["name", "content", "low", "high"])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of a region by two independent 64-bit sums over its bytes."""
    rng = np.random.default_rng(LENGTH)
    factors = rng.integers(1, 2**63, (2, LENGTH // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for name, content, data in zip(batch["name"], batch["content"], batch["bytes"]):
            eight = _words(np.frombuffer(data, np.uint8))
            eight = (eight ^ eight >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            eight ^= eight >> np.uint64(32)
            n = len(data) - LENGTH + 1
            sums = np.zeros((2, n), np.uint64)
            for j in range(LENGTH // 8):
                sums += eight[None, 8 * j : 8 * j + n] * factors[:, j, None]
            yield pd.DataFrame({"one": sums[0].view(np.int64), "two": sums[1].view(np.int64), "content": content, "name": name, "low": np.arange(n)})


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches):
        kept, removed, runs = [], [], []
        for data, spans, copied in zip(batch["data"], batch["spans"], batch["copied"]):
            data = bytes(data)
            gone = np.zeros(len(data) + 1, np.int8)
            if copied and len(data) >= LENGTH:
                gone[: len(data)] = 1
            elif spans is not None:
                edge = np.zeros(len(data) + 1, np.int64)
                for s in spans:
                    edge[s["low"]] += 1
                    edge[s["high"] + LENGTH] -= 1
                gone = (np.cumsum(edge) > 0).astype(np.int8)
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(np.append(0, gone)) == 1).sum()))
            kept.append(np.frombuffer(data, np.uint8)[gone[: len(data)] == 0].tobytes())
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in batch["data"]], "n_removed": removed, "n_spans": runs, "kept": kept,
        })


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of `docs`.

    Removes every byte covered by a string of 400 bytes that also starts anywhere else in the
    corpus, the same text included; judged on the input, so all copies of a passage go. Matches
    lie within one text. Null texts are empty: nothing to remove. Texts under 400 bytes stay whole.
    Equal texts of 400 bytes and more go whole, whatever their doc_id; null and repeated ids count
    as rows of their own.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), text_key().alias("key"))
    copies = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    found = pin(texts.select("key", "data").where(F.octet_length("data") >= LENGTH).mapInPandas(
        _regions, "key binary, first int, windows int, name long, content long, place long, periodic boolean"
    ))
    # Equal texts have equal places. A name of one place has no repeated window unless it is periodic.
    shared = found.groupBy("name").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("periodic").alias("p"))
    shared = shared.where("a < b or p").select("name")
    places = pin(found.join(shared, "name").distinct())
    classes = pin(places.groupBy("name", "content").agg(F.min("place").alias("place"), F.max("place").alias("other"), F.max("periodic").alias("p")))
    several = classes.groupBy("name").agg(F.count("*").alias("n"), F.max("p").alias("p")).where("n > 1 or p").select("name", (F.col("n") > HOT).alias("hot"))
    wanted = classes.select("name", "place").join(several, "name").join(places, ["name", "place"])
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("name", "content", "hot", "first", "windows")).alias("wanted"))
    chosen = texts.select("key", "data").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    cut = pin(chosen.join(wanted, "key").mapInPandas(_cut, "name long, content long, hot boolean, bytes binary"))
    schema = "name long, content long, low int, high int"
    in_order = dealt(cut.where("not hot").drop("hot"), "name").mapInPandas(_sorted, schema)
    marks = cut.where("hot").select("name", "content", "bytes").mapInPandas(_fingerprints, "one long, two long, content long, name long, low int")
    window = F.xxhash64("content", "low")
    again = marks.groupBy("one", "two").agg(F.min(window).alias("a"), F.max(window).alias("b")).where("a < b").select("one", "two")
    counted = marks.join(again, ["one", "two"]).select("name", "content", "low", F.col("low").alias("high"))
    copied = classes.where("place < other").join(places.select("name", "content", "windows").distinct(), ["name", "content"])
    all_of = copied.select("name", "content", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))
    spans = in_order.union(counted).union(all_of)
    spans = places.join(spans, ["name", "content"]).select("key", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    spans = pin(spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    rows = texts.join(copies, "key", "left").join(spans, "key", "left").select("doc_id", "data", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    return rows.mapInPandas(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
