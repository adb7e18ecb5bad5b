"""Byte-level BPE: words are merged by a fold of higher-order functions over a literal rank map.

A token is one character of a private alphabet (its code point is the token's id), so a word being
merged is a short string, a merge is a replacement in it, and the pair to merge next is the least entry
of the rank map among its neighbouring characters. Long words keep the entries of their pairs in an
array, so that a step looks up two pairs and not all.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kindred.llm.common import table
from kindred.session import pin

FILE = "byte_bpe_multi_50k.tiktoken"
#: Most tokens of a vocabulary: the private alphabet is the basic plane below the surrogates.
MOST = 0xD800
#: Words whose encoding is looked up instead of folded where they occur: a bound for the table that
#: goes to all tasks (about 60 bytes a word), not for the result.
FREQUENT = 1 << 18
_BUCKETS = 1 << 16
#: Words longer than this are merged place by place.
LONG = 128
#: A character is its token's id; id 0 has one of its own, as `translate` drops the character 0.
_ZERO = "\ufffd"
#: Comes after all merged characters.
_NONE = "\ufffc"
_SINGLY, _AT_ONCE = "!", "-"


def char(token: int) -> str:
    return chr(token) if token else _ZERO


@dataclass(frozen=True)
class Vocabulary:
    ranks: dict[bytes, int]
    pairs: dict[str, str]  # two token characters -> merged character, a mark, the two


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a rank file: base64 of a token's bytes and its rank on each line.

    Merges inside a token's bytes go the same way alone as within a word, so of all the pairs that
    spell a token only the one its own bytes come to last is ever merged; only that is kept.
    """
    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MOST or max(ranks.values()) >= MOST or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"a vocabulary needs all single bytes and ranks under {MOST}")
    if any(rank == 0 and len(token) > 1 for token, rank in ranks.items()):
        raise ValueError("rank 0 must be a single byte")
    pairs = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joins = [ranks.get(a + b, MOST) for a, b in zip(parts, parts[1:])]
            at = joins.index(min(joins))
            if joins[at] == MOST:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            # Joining it can bring a pair that goes first if a part has a later rank than the whole.
            mark = _SINGLY if max(ranks[x] for x in parts) > rank else _AT_ONCE
            pair = char(ranks[parts[0]]) + char(ranks[parts[1]])
            pairs[pair] = char(rank) + mark + pair
    return Vocabulary(ranks, pairs)


def _place(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def _find(maps: Column, key: Column, buckets: int = _BUCKETS) -> Column:
    return F.try_element_at(F.get(maps, _place(key, buckets)), key)


def _maps(entries: DataFrame, buckets: int) -> Column:
    """(key, value) rows of a bounded table -> one literal value: an array of small maps.

    A look-up in one large map scans all its entries; in a small one it ends at the key, so keys of
    a large `n`, where the table has it, come first. The value comes as a scalar subquery, which
    goes along with the tasks as bytes instead of as written text.
    """
    first = [(-F.col("n")).alias("n")] if "n" in entries.columns else []
    inside = F.transform(F.array_sort(F.collect_list(F.struct(*first, "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    grouped = entries.groupBy(_place(F.col("key"), buckets).alias("at")).agg(inside.alias("entries"))
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("at")).join(grouped, "at", "left")
    none = F.array().cast(grouped.schema["entries"].dataType)
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("entries", none).alias("entries"))))
    return every.agg(F.transform(ordered, lambda x: F.map_from_entries(x["entries"])).alias("maps")).scalar()


def _list(spark: SparkSession, values: list[str]) -> Column:
    """A bounded list of texts -> one value, an array in the same order, as a scalar subquery."""
    entries = spark.createDataFrame(list(enumerate(values)), "at int, value string")
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return entries.agg(F.transform(ordered, lambda x: x["value"]).alias("list")).scalar()


def with_tables(rows: DataFrame, path: str, use, name: str, **more: Column) -> DataFrame:
    """Adds column `name`, use(tables of the vocabulary), to rows.

    Higher-order functions take no subquery as written; a column that is used once is one to them.
    """
    vocab, spark = vocabulary(path), rows.sparkSession
    size = max(vocab.ranks.values()) + 1
    pieces = [""] * size
    for token, rank in vocab.ranks.items():
        pieces[rank] = token.decode("latin-1")
    whole = [(t.decode("latin-1"), char(r)) for t, r in vocab.ranks.items() if len(t) > 1]
    more["pairs"] = _maps(spark.createDataFrame(list(vocab.pairs.items()), "key string, value string"), _BUCKETS)
    more["whole"] = _maps(spark.createDataFrame(whole, "key string, value string"), _BUCKETS)
    more["pieces"] = _list(spark, pieces)
    t = F.struct(
        F.lit("".join(char(vocab.ranks[bytes([i])]) for i in range(256))).alias("bytes"),
        *[F.col(f"bpe_{field}").alias(field) for field in more],
    )
    return rows.withColumns({f"bpe_{field}": value for field, value in more.items()}).select(*rows.columns, let(t, use).alias(name))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Matches of the pattern, in order; together they are the whole text."""
    # The same alternatives with their common first character written once: fewer tries a place.
    pattern = public_tokenizers.PATTERN.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:s|t|re|ve|m|ll|d)|")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def _entry(pair: Column, pairs: Column) -> Column:
    """The merged character and the pair; for a pair that has none, the mark that comes after all characters."""
    return F.coalesce(_find(pairs, pair), F.concat(F.lit(_NONE + _SINGLY), pair))


def _by_pair(start: Column, pairs: Column) -> Column:
    """Merges all places of the least pair in a step.

    That is the same as one by one, first to last, unless a merge brings a pair that goes before
    it; pairs that can do so are marked and merged one place a step.
    """
    def step(state, _):
        now = state["now"]
        places = F.sequence(F.lit(1), F.length(now) - 1)
        best = F.array_min(F.transform(places, lambda i: _find(pairs, F.substring(now, i, F.lit(2)))))

        def go(best):
            pair, to = F.substring(best, -2, 2), F.substring(best, 1, 1)
            first = F.instr(now, pair)
            once = F.concat(F.substring(now, F.lit(1), first - 1), to, F.substring(now, first + 2, F.length(now)))
            after = F.when(F.substring(best, 2, 1) == _SINGLY, once).otherwise(F.replace(now, pair, to))
            return F.struct(F.coalesce(after, now).alias("now"), best.isNull().alias("done"))

        return F.when(state["done"] | (F.length(now) < 2), state).otherwise(let(best, go))

    begin = F.struct(start.alias("now"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(2), F.length(start)), begin, step, lambda s: s["now"])


def _by_place(start: Column, pairs: Column) -> Column:
    """Merges the least pair of a long word, where it stands first, until no pair is left that merges.

    The state is the entries of all neighbouring pairs, which spell the tokens too: a merge takes one entry out
    and looks up its two neighbours anew, all others stay as they are. A word that ends as a single
    token is in the vocabulary as a whole and never comes here.
    """
    def step(state, _):
        now = state["now"]

        def go(found):
            best, at = found["best"], found["at"]
            token = F.substring(best, 1, 1)
            anew = lambda e, i: (
                F.when(i == at - 2, _entry(F.concat(F.substring(e, 3, 1), token), pairs))
                .when(i == at, _entry(F.concat(token, F.substring(e, 4, 1)), pairs)).when(i != at - 1, e)
            )
            merged = F.filter(F.transform(now, anew), lambda e: e.isNotNull())
            return F.when(best >= _NONE, F.struct(now.alias("now"), F.lit(True).alias("done"))).otherwise(
                F.struct(merged.alias("now"), F.lit(False).alias("done"))
            )

        place = lambda best: F.struct(best.alias("best"), F.array_position(now, best).cast("int").alias("at"))
        return F.when(state["done"], state).otherwise(let(let(F.array_min(now), place), go))

    entries = F.transform(F.sequence(F.lit(1), F.length(start) - 1), lambda i: _entry(F.substring(start, i, F.lit(2)), pairs))
    begin = F.struct(entries.alias("now"), F.lit(False).alias("done"))
    spelt = lambda s: F.concat(
        F.array_join(F.transform(s["now"], lambda e: F.substring(e, 3, 1)), ""), F.substring(F.element_at(s["now"], -1), 4, 1)
    )
    return F.aggregate(F.sequence(F.lit(2), F.length(start)), begin, step, spelt)


def _merged(word: Column, t: Column) -> Column:
    """The word's tokens as a string of the private alphabet."""
    latin = F.lit("".join(map(chr, range(256))))

    def folded(one):
        start = F.call_function("translate", one, latin, t["bytes"])
        size = F.length(one)
        slow = F.when(size < 2, start).when(size <= LONG, _by_pair(start, t["pairs"])).otherwise(_by_place(start, t["pairs"]))
        return F.coalesce(_find(t["whole"], one), slow)

    return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), folded)


def _plain(tokens: Column) -> Column:
    return F.replace(tokens, F.lit(_ZERO), F.lit("\0"))


def _ids(tokens: Column) -> Column:
    """Token characters -> array of ids."""
    return F.transform(F.filter(F.split(_plain(tokens), ""), lambda c: c != ""), F.ascii)


def encode(word: Column, t: Column) -> Column:
    """Ids of a text that is one match of the pattern; t: the tables."""
    return _ids(_merged(word, t))


def decode(ids: Column, t: Column) -> Column:
    """The bytes of the tokens of an array of ids, concatenated; a character a byte."""
    return F.array_join(F.transform(ids, lambda i: F.element_at(t["pieces"], i + 1)), "")


def _packed(tokens: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers; a character a byte.

    UTF-32 writes the characters, which are the ids, as big-endian integers; backwards they are little-endian.
    """
    return F.reverse(F.decode(F.encode(F.reverse(_plain(tokens)), "UTF-32"), "ISO-8859-1"))


def _coded(word: Column, t: Column) -> Column:
    """A word's ids and the bytes decoded from them, a character a byte."""
    return let(_merged(word, t), lambda tokens: F.struct(_packed(tokens).alias("ids"), decode(_ids(tokens), t).alias("bytes")))


def frequent_words(docs: DataFrame, path: str, most: int, buckets: int) -> Column:
    """The codes of at most `most` words of `docs`, those with the most occurrences, as small maps.

    The maps are one value of bounded size, a scalar subquery that Spark sends along with the tasks.
    """
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = pin(counts)
    # Words of one number of occurrences go in together, as far as they fit.
    steps = Window.orderBy(F.desc("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("so_far", F.sum("words").over(steps))
    least = levels.where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    chosen = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    coded = pin(with_tables(chosen.select(F.col("word").alias("key"), "n"), path, lambda t: _coded(F.col("key"), t), "value"))
    return _maps(coded, buckets)


def tokenize(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """The columns of `docs` with n_tokens, ids and decoded for each whole text.

    Every match of the pattern is encoded on its own. The distinct words are counted and the most
    frequent, a fixed number, are encoded once and looked up; all other words are folded where they
    stand, so nothing is exploded or shuffled for the encoding itself. ids is binary, 4 bytes a
    token. Null texts are empty: no tokens, no bytes. Columns of these names in `docs` are replaced.
    """
    buckets = max(1, frequent // 4)
    known = frequent_words(docs, path, frequent, buckets)
    coded = lambda t: F.transform(words(F.col("text")), lambda w: F.coalesce(_find(t["known"], w, buckets), _coded(w, t)))
    kept = docs.drop("n_tokens", "ids", "decoded", "coded", *(f"bpe_{x}" for x in ("known", "pairs", "whole", "pieces")))
    joined = lambda part: F.encode(F.array_join(F.col("coded")[part], ""), "ISO-8859-1")
    rows = with_tables(kept, path, coded, "coded", known=known).select(*kept.columns, joined("ids").alias("ids"), joined("bytes").alias("decoded"))
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(FILE))
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
