"""Secret scans over a ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.llm.common import table
from kindred.session import pin

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)


@dataclass(frozen=True)
class Rule:
    """`pattern` has the match as its group 1; `value` names the group whose length is tested."""

    kind: str
    pattern: str
    value: int
    least: int
    hint: str


#: Fixed patterns of the three kinds, in the order in which they are listed.
RULES = (
    Rule("assign", ASSIGN, 2, 6, r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24, r"[0-9a-f]{24}"),
)
VERSION = "2026-1"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, rule: Rule, index: int) -> Column:
    """Leftmost non-overlapping matches of a rule as (start, kind, end) in code points.

    A pattern glued to the end of the match before it gives the gaps and the matches; their summed
    lengths are the places.
    """
    glued = F.lit(rf"(?s)\G(.*?){rule.pattern}")
    steps = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, glued, F.lit(1)), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, glued, F.lit(2)), F.length).alias("own"),
        F.transform(F.regexp_extract_all(text, glued, F.lit(rule.value + 1)), F.length).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("found"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + x["own"]
        one = F.array(F.struct(begin.alias("start"), F.lit(index).alias("kind"), end.alias("end")))
        kept = F.when(x["value"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    found = F.aggregate(steps, start, step, lambda s: s["found"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, text) versions -> (ledger rows added, findings of every path).

    A blob is a text by its SHA-256; versions of equal text are one blob. Blobs that the ledger
    holds under this rule version are not scanned again. The ledger has blob, rule_version and the
    spans of each kind; append the added rows to it. Findings has path, blob and the spans, also
    for paths without any. Null texts are empty; null and repeated paths stay as they are.
    """
    keyed = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    blobs = keyed.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version)
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    found = F.array_sort(F.concat(*[spans(F.col("text"), rule, i) for i, rule in enumerate(rules)]))
    added = pin(blobs.select("blob", F.lit(version).alias("rule_version"), found.alias("spans")))
    known = added if ledger is None else added.unionByName(seen.select("blob", "rule_version", "spans"))
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    findings = keyed.select("path", "blob").join(hits, "blob", "left")
    return added, findings.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))


def written(column: Column, rules=RULES) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(column, one), ",")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    _, found = scan(docs)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    text = written(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"),
    )
