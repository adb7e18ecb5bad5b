"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.llm.common import table
from kindred.session import pin, release

#: Bounds of what is fitted on: labelled rows for the learnt lexicons, texts for the classifier.
LABELLED, SAMPLE = 12_000, 12_000
#: Stems that the learnt lexicons share, and stems that the classifier weighs.
LEXICON, STEMS = 64, 256
THRESHOLD = 0.5
#: Share of a text's words from which a stem counts as dense, a mark of its own.
DENSE = 0.01

#: Insults by kind, one voter a kind.
INSULTS = {
    "mind": "idiot moron stupid imbecile dumb fool dimwit halfwit cretin brainless",
    "worth": "pathetic worthless loser useless nobody failure coward",
    "filth": "trash scum garbage filth vermin disgusting vile repulsive parasite",
    "ridicule": "clown buffoon laughable ridiculous",
}
#: Patterns, one voter each; those of words look at the text in lower case.
PATTERNS = {
    "threat": r"\b(?:shut up|get lost|drop dead|hate you|kill you|hurt you)\b",
    "address": r"\byou(?:'re| are) (?:an? |such |so |all )",
    "shouting": r"(?:\b[A-Z]{3,}\b[^A-Za-z]+){3}",
    "bangs": r"[!?]{3,}",
}
LEARNT = 8  # voters of learnt stems
NAMES = [*INSULTS, *PATTERNS, *[f"stems{i}" for i in range(LEARNT)]]

_WORD = re.compile(r"[^\W\d_]+")
_COMPILED = [re.compile(p) for p in PATTERNS.values()]
#: One of these stands in a text where the pattern matches; most texts hold none.
_HINTS = [("shut up", "get lost", "drop dead", "e you", "l you", "t you"), ("you",), ("",), ("!!", "??", "!?", "?!")]
_CAPITALS = re.compile("[A-Z]{3}")
_FIXED = {word: 1 << i for i, words in enumerate(INSULTS.values()) for word in words.split()}


def stems(word: str) -> list[str]:
    """A lower-case word's beginnings of 3 to 7 letters, and the word itself with an end mark."""
    return [word[:n] for n in range(3, min(len(word), 7) + 1)] + [word + "$"]


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _all_marks(words: list[str]) -> set[str]:
    """Every stem of a text, and, with a plus, those that make up a share of DENSE of its words."""
    counts: dict[str, int] = {}
    for word, times in Counter(words).items():
        if len(word) <= 40:
            for stem in stems(word):
                counts[stem] = counts.get(stem, 0) + times
    least = DENSE * len(words)
    return set(counts) | {stem + "+" for stem, times in counts.items() if times >= least}


def _looked_up(marks: dict[str, int]) -> Callable[[list[str]], set[int]]:
    """words -> marks of their stems, as `_all_marks` has them.

    A stem has three letters or is a whole word, so the first three letters of a word rule out most.
    """
    wanted = {m.removesuffix("+") for m in marks}
    heads = {m.removesuffix("$")[:3] for m in wanted}

    def of(words: list[str]) -> set[int]:
        counts: dict[str, int] = {}
        for word in words:
            if word[:3] in heads and len(word) <= 40:
                for stem in stems(word):
                    if stem in wanted:
                        counts[stem] = counts.get(stem, 0) + 1
        least = DENSE * len(words)
        out = {marks[s] for s in counts if s in marks}
        return out | {marks[s + "+"] for s, times in counts.items() if times >= least and s + "+" in marks}

    return of


def _vote(text: str | None, words: list[str], learnt: Callable[[list[str]], set[int]]) -> int:
    """One bit a voter: 1 if it calls the text toxic, 0 if it abstains."""
    bits = 0
    for word in _FIXED.keys() & set(words):
        bits |= _FIXED[word]
    for bit in learnt(words):
        bits |= bit
    if text:
        low = text.lower()
        for i, (pattern, hints) in enumerate(zip(_COMPILED, _HINTS)):
            seen = low if i < 2 else text
            if any(h in seen for h in hints) and (i != 2 or _CAPITALS.search(seen)) and pattern.search(seen):
                bits |= 1 << (len(INSULTS) + i)
    return bits


@dataclass
class LabelModel:
    """Voters given the hidden label: each depends on the label and on one other voter at most.

    rates[c, j, b]: how often voter j votes in class c when its parent's vote is b. The parents form
    the tree that holds the most of the voters' correlation within the classes.
    """

    prior: float = 0.1
    parents: list[int] = field(default_factory=lambda: [-1] * len(NAMES))
    rates: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.001, 0.1])[:, None, None], (1, len(NAMES), 2)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of bits (n x voters)."""
        logs = np.zeros((2, len(votes)))
        for c in (0, 1):
            logs[c] += np.log(self.prior if c else 1 - self.prior)
            for j, p in enumerate(self.parents):
                rate = self.rates[c, j, 0] if p < 0 else np.where(votes[:, p] > 0, self.rates[c, j, 1], self.rates[c, j, 0])
                logs[c] += np.where(votes[:, j] > 0, np.log(rate), np.log1p(-rate))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def _tree(joint: list[np.ndarray], singles: list[np.ndarray], sizes: list[float]) -> list[int]:
    """Parent of each voter: the spanning tree of the highest information between voters, given the class."""
    k = len(singles[0])
    total = sum(sizes)
    gain = np.zeros((k, k))
    for both, one, n in zip(joint, singles, sizes):
        for x in (0, 1):
            for y in (0, 1):
                p = both if x and y else one[:, None] - both if x else one[None, :] - both if y else n - one[:, None] - one[None, :] + both
                a, b = (one if x else n - one)[:, None], (one if y else n - one)[None, :]
                p = np.maximum(p, 0) + 1e-9
                gain += p / total * np.log(p * n / np.maximum(a * b, 1e-9))
    parents, left, best = [-1] * k, set(range(1, k)), {j: (gain[0, j], 0) for j in range(1, k)}
    while left:
        j = max(left, key=lambda i: (best[i][0], -i))
        if best[j][0] > 1e-4:  # else the voter depends on the label alone
            parents[j] = best[j][1]
        left.remove(j)
        for i in left:
            best[i] = max(best[i], (gain[j, i], j), key=lambda x: (x[0], -x[1]))
    return parents


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation and maximisation over patterns of votes (one row each) and how often they occur.

    `counts` are of all texts, their labels hidden. `known` (n x 2) counts labelled texts by class;
    they keep the classes' meaning and weigh as much as the others in sum. Without labels of both
    classes nothing tells the classes apart, and the rates stay as they are given.
    """
    model = LabelModel()
    if not len(votes) or known.sum(axis=0).min() == 0:
        return model
    votes = votes.astype(float)
    weight = counts.sum() / known.sum()
    hidden = np.zeros(len(votes))  # begins with what the labelled texts say
    for step in range(rounds):
        q = model.posterior(votes)
        shares = [hidden * (1 - q) + weight * known[:, 0], hidden * q + weight * known[:, 1]]
        sizes = [s.sum() + 1e-9 for s in shares]
        singles = [s @ votes for s in shares]
        joint = [(votes * s[:, None]).T @ votes for s in shares]
        prior = float(np.clip((sizes[1] + 1) / (sum(sizes) + 2), 1e-4, 0.9))
        parents = _tree(joint, singles, sizes) if step < 10 else model.parents
        rates = np.zeros_like(model.rates)
        for c in (0, 1):
            base = (singles[c] + (0.5 if c else 0.05)) / (sizes[c] + 1)
            for j, p in enumerate(parents):
                rates[c, j] = base[j]
                if p >= 0:
                    on, off = singles[c][p], sizes[c] - singles[c][p]
                    rates[c, j, 1] = (joint[c][j, p] + 4 * base[j]) / (on + 4)
                    rates[c, j, 0] = (singles[c][j] - joint[c][j, p] + 4 * base[j]) / (max(off, 0) + 4)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        moved = abs(prior - model.prior) + np.abs(rates - model.rates).max()
        model = LabelModel(prior, parents, rates)
        if step and moved < 1e-7:
            break
        hidden = counts.astype(float)
    return model


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(len(NAMES))) & 1


@dataclass
class Model:
    """Weights of voters and stems, and the bias: what a text's score is made of."""

    lexicon: dict[str, int]
    label_model: LabelModel
    stems: dict[str, int]
    weights: np.ndarray

    def score(self, texts: pd.Series) -> np.ndarray:
        learnt, marked = _looked_up(self.lexicon), _looked_up(self.stems)
        out = np.zeros(len(texts))
        k = len(NAMES)
        for i, text in enumerate(texts):
            words = _words(text)
            found = marked(words)
            bits = _vote(text, words, learnt)
            out[i] = self.weights[-1] + sum(self.weights[j] for j in range(k) if bits >> j & 1) + sum(self.weights[k + m] for m in found)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt; a null doc_id is held out, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _least(ids: DataFrame, most: int) -> DataFrame:
    """The `most` rows of least hash of doc_id: a draw that reruns repeat."""
    return ids.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(most)


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(text, q) -> (stem, n texts with it, sum of their q)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[str, int] = {}
            s: dict[str, float] = {}
            for text, q in zip(batch["text"], batch["q"]):
                for stem in _all_marks(_words(text)):
                    n[stem] = n.get(stem, 0) + 1
                    s[stem] = s.get(stem, 0.0) + q
            yield pd.DataFrame({"stem": list(n), "n": list(n.values()), "s": list(s.values())})

    return rows.select("text", "q").mapInPandas(run, "stem string, n long, s double").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _information(n: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    a = toxic / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(a > 0, a * np.log(a / share), 0) + np.where(a < 1, (1 - a) * np.log((1 - a) / (1 - share)), 0)
    return np.where(a > share, n * parts, 0)


def _lexicon(told: DataFrame, most: int) -> list[str]:
    """Stems for the learnt voters: each tells most about the labelled texts that no voter before it marks.

    So words that merely stand in copies of a toxic text are not chosen beside the one that makes it
    toxic. The fixed voters' texts count as marked from the start. Labelled texts come to the driver as lists of candidates.
    """
    stems_ = _telling(told, 8 * most, 2.0, False)
    marks = {s: i for i, s in enumerate(stems_)}

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _looked_up(marks)
        for batch in batches:
            words = [_words(t) for t in batch["text"]]
            yield pd.DataFrame({"q": batch["q"], "marked": [any(w in _FIXED for w in x) for x in words], "found": [sorted(of(x)) for x in words]})

    if not marks:
        return []
    rows = told.mapInPandas(listed, "q double, marked boolean, found array<int>").toPandas()
    share = float(rows["q"].mean())
    at = np.repeat(np.arange(len(rows)), rows["found"].map(len))
    what = np.concatenate([np.asarray(f, np.int64) for f in rows["found"]])
    q, free = rows["q"].to_numpy(float), ~rows["marked"].to_numpy(bool)
    out: list[str] = []
    while len(out) < most:
        use = free[at]
        n = np.bincount(what[use], minlength=len(stems_))
        tells = _information(n, np.bincount(what[use], q[at[use]], len(stems_)), share)
        best = int(np.argmax(tells))  # of equals the first, which tells more over all
        if tells[best] < np.log(len(stems_)) + 2:
            break
        out.append(stems_[best])
        free[at[what == best]] = False
    return out


def _telling(rows: DataFrame, most: int, margin: float, both_ways: bool) -> list[str]:
    """Up to `most` stems whose texts are toxic more often than others, beyond what chance gives.

    A stem in n texts with a toxic share of a tells n * KL(a, share of all). As many stems are looked
    at, the best of them tell the logarithm of their number by chance; `margin` comes on top. Of stems
    that begin alike, the most telling one is taken.
    """
    sizes = rows.agg(F.count("*"), F.sum("q")).first()
    n, toxic = float(sizes[0]), float(sizes[1] or 0)
    if toxic < 1 or n - toxic < 1:
        return []
    counts = pin(_stem_counts(rows).where("n > 1"))
    base, a = F.lit(toxic / n), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("n")))
    log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    tells = F.col("n") * (log(a, base) + log(1 - a, 1 - base))
    found = counts.withColumn("tells", F.round(tells, 9)).where(F.lit(True) if both_ways else a > base)
    found = found.where(F.col("tells") > float(np.log(max(counts.count(), 1)) + margin))
    out: list[str] = []
    chosen: set[str] = set()
    beginnings: set[str] = set()
    for row in found.orderBy(F.desc("tells"), F.length("stem").desc(), "stem").limit(8 * most).collect():
        bare = row["stem"].removesuffix("+")
        marks = {bare[:i] for i in range(3, len(bare) + 1)}
        if bare in beginnings or marks & chosen:
            continue
        out.append(row["stem"])
        chosen.add(bare)
        beginnings |= marks
        if len(out) == most:
            break
    release(counts)
    return out


def _fit_linear(rows: list[list[int]], q: np.ndarray, size: int, steps: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; `rows` lists each text's features, the last weight is the bias."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([x for r in rows for x in r], np.int64)
    w, first, second = (np.zeros(size + 1) for _ in range(3))
    mean = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(mean / (1 - mean))
    for step in range(1, steps + 1):
        g = w[-1] + np.bincount(at, w[what], len(rows))
        d = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - q) / len(rows)
        grad = np.append(np.bincount(what, d[at], size), d.sum())
        grad[:-1] += ridge * w[:-1]
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        w -= 0.1 * (1 - 0.9 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sample: int = SAMPLE) -> Model:
    """Learns from the votes on all texts and at most `labelled` labelled ones; `sample` texts train the classifier.

    Labels of held-out rows are left out before anything else. The label model counts patterns of
    votes over all documents: at most 2 ** voters of them come to the driver. Without labels the
    fixed voters work alone; on an empty table nothing is learnt and scores are the prior.
    """
    docs = docs.select("doc_id", "text")
    trusted = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    trusted = _least(trusted.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("q")), labelled)  # bounded
    told = pin(docs.join(F.broadcast(trusted), "doc_id").groupBy("doc_id", "q").agg(F.min("text").alias("text")))
    chosen = _lexicon(told, LEXICON)
    lexicon = {s: 1 << (len(INSULTS) + len(PATTERNS) + i % LEARNT) for i, s in enumerate(chosen)}

    def votes(text: pd.Series) -> pd.Series:
        learnt = _looked_up(lexicon)
        return pd.Series([_vote(t, _words(t), learnt) for t in text], dtype="int64")

    call = F.pandas_udf(votes, "long")
    counts = {r["votes"]: r["n"] for r in docs.groupBy(call("text").alias("votes")).agg(F.count("*").alias("n")).collect()}
    known = {(r["votes"], int(r["q"])): r["n"] for r in told.groupBy(call("text").alias("votes"), "q").agg(F.count("*").alias("n")).collect()}
    codes = np.array(sorted({*counts, *(v for v, _ in known)}), np.int64)
    label_model = fit_label_model(
        _bits(codes), np.array([counts.get(c, 0) for c in codes.tolist()], float),
        np.array([[known.get((c, y), 0) for y in (0, 1)] for c in codes.tolist()], float).reshape(-1, 2),
    )

    # At most `sample` ids; of rows with one id the one of the least text.
    ids = _least(docs.where("doc_id is not null").select("doc_id").distinct(), sample)
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt = _looked_up(lexicon)
        for batch in batches:
            bits = np.array([_vote(t, _words(t), learnt) for t in batch["text"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "votes": bits, "q": label_model.posterior(_bits(bits))})

    texts = pin(texts.mapInPandas(judged, "doc_id long, text string, votes long, q double"))
    marks = {s: i for i, s in enumerate(_telling(texts, STEMS, 2.0, True))}

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _looked_up(marks)
        for batch in batches:
            found = [sorted(of(_words(t))) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "votes": batch["votes"], "q": batch["q"], "found": found})

    rows = texts.mapInPandas(described, "doc_id long, votes long, q double, found array<int>").toPandas().sort_values("doc_id")
    release(told)
    release(texts)
    k = len(NAMES)
    if not len(rows):
        return Model(lexicon, label_model, marks, np.append(np.zeros(k + len(marks)), np.log(label_model.prior / (1 - label_model.prior))))
    listed = [[j for j in range(k) if v >> j & 1] + [k + int(m) for m in f] for v, f in zip(rows["votes"], rows["found"])]
    weights = _fit_linear(listed, rows["q"].to_numpy(float), k + len(marks))
    return Model(lexicon, label_model, marks, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` but those named so before, with held_out, score and predicted.

    Null texts are empty texts, scored by the bias alone. Repeated rows are scored alike. An empty
    table gives an empty table.
    """
    call = F.pandas_udf(lambda text: pd.Series(model.score(text), dtype=float), "double")
    kept = docs.drop("held_out", "score", "predicted")
    rows = kept.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", call(F.col("text")))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
