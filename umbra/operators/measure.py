"""Measures over gold and predicted spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import wilson
from umbra.operators.policy import _OPINIONS, PROFILES, decide
from umbra.operators.spans import covered, exact_matches, near_misses, overlapping, ratio

# The labels of each group of the core scope, and labels outside of it.
CORE = {
    "personal": ("PERSON", "ID_CARD", "EMPLOYEE_ID"),
    "enterprise": ("ORG", "SUPPLIER", "DEPARTMENT"),
    "project": ("PROJECT", "LAND_PARCEL"),
    "locator": ("CONTACT", "CONTRACT_ID", "BID_ID", "BANK_ACCOUNT", "CREDENTIAL", "SYSTEM_URL", "ORG_CODE", "ADDRESS", "LOCATION"),
}
QUASI = ("AMOUNT", "DATE", "SCALE", "TIMELINE", "MILESTONE", "LOCATION_CONTEXT", "DISCOUNT_RATE")
PLACES = ("ADDRESS", "LOCATION")


def core_group(label: Column, category: Column) -> Column:
    """semantic, a group of the core scope, quasi or other; a place counts as quasi where its category says so."""
    quasi = F.coalesce(category == "quasi_identifier", F.lit(False))
    out = F.when((category == "semantic_sensitive") | label.isin(*_OPINIONS), "semantic")
    for group, labels in CORE.items():
        out = out.when(label.isin(*labels) & ~(label.isin(*PLACES) & quasi), group)
    return out.when(quasi | label.isin(*QUASI), "quasi").otherwise("other")


def coverage_report(gold: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ("category", "scenario")) -> DataFrame:
    """One row for each value of each dimension and one for all: total, fully, partial, missed, leaked, rates and interval."""
    table = covered(gold, predicted)
    sets = [[F.col(c)] for c in by] + [[]]
    one = lambda name: F.count_if(F.col("status") == name).alias(name)
    rows = table.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("total"), one("fully"), one("partial"), one("missed"), F.sum("leakage").alias("leaked"))
    low, high = wilson("fully", "total")
    return rows.withColumns({"fully_rate": ratio(F.col("fully"), F.col("total")), "leak_rate": ratio(F.col("leaked"), F.col("total")), "low": low, "high": high})


def precision_recall(counts: DataFrame) -> DataFrame:
    """label, tp, fp, fn with precision and recall."""
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def decoy_hits(decoys: DataFrame, predicted: DataFrame, by: str) -> DataFrame:
    """by, total, hit, rate: decoys that a prediction touches."""
    hit = overlapping(decoys, predicted).select("doc_id", "start", "end").distinct().withColumn("hit", F.lit(1))
    out = decoys.join(hit, ["doc_id", "start", "end"], "left").groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"))
    return out.withColumn("rate", ratio(F.col("hit"), F.col("total")))


def residuals(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, core_group, status, n, leaked of core spans that aren't fully covered."""
    table = covered(gold, predicted).withColumn("core_group", core_group(F.col("label"), F.col("category")))
    left = table.where((F.col("status") != "fully") & F.col("core_group").isin(*CORE))
    return left.groupBy("label", "core_group", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("leakage").alias("leaked"))


def risk_reduction(gold: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """level, leaked, reduction: how much less leaks than from the raw text."""
    out = None
    for name, predicted in levels.items():
        one = covered(gold, predicted).agg(F.sum("leakage").alias("leaked"), F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("level"), "leaked", (1 - ratio(F.col("leaked"), F.col("total"))).alias("reduction"))
        out = one if out is None else out.unionByName(one)
    return out


def utility_matrix(gold: DataFrame, strategies: dict[str, dict[str, str]]) -> DataFrame:
    """strategy, category, action, n: what strategies (category to action) do to labelled spans."""
    out = None
    for name, actions in strategies.items():
        action = F.when(F.lit(False), "")
        for category, a in actions.items():
            action = action.when(F.col("category") == category, a)
        one = gold.select(F.lit(name).alias("strategy"), "category", action.otherwise("redact").alias("action"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("strategy", "category", "action").agg(F.count(F.lit(1)).alias("n"))


# What the strategies of the utility measure leave readable besides semantic spans, and what they make coarse.
READABLE, COARSE = ("quasi_identifier", "legal_analysis"), ("AMOUNT", "DATE", "LOCATION", "LOCATION_CONTEXT")
STRATEGIES = ("standard", "review", "strict", "contract_review", "litigation")


def policy_action(strategy: str, label: Column, category: Column, risk: Column | None = None) -> Column:
    """What a strategy does to a labelled span: pass, redact, warn, generalize or block. Decoys pass; a strategy that isn't known passes all.

    standard, review and strict differ in what meaning and hints they leave; the others are profiles, but what only hints
    at somebody is never replaced by them.
    """
    kind = F.coalesce(category, F.lit(""))
    semantic, hint = kind == "semantic_sensitive", kind.isin(*READABLE)
    decoy = F.when(kind == "decoy", "pass")
    core = F.when(label.isin(*[x for group in CORE.values() for x in group]), "redact").otherwise("pass")
    if strategy == "standard":
        return decoy.when(semantic | hint, "pass").otherwise(core)
    if strategy == "review":
        return decoy.when(semantic, "warn").when(hint, "pass").otherwise(core)
    if strategy == "strict":
        quasi = F.when(label.isin(*COARSE), "generalize").otherwise("warn")
        return decoy.when(semantic, "warn").when(kind == "quasi_identifier", quasi).when(hint, "pass").otherwise(core)
    if strategy in PROFILES:
        decided = decide(PROFILES[strategy], label, F.lit("high") if risk is None else risk)
        return decoy.when(hint & (decided == "redact"), "pass").otherwise(decided)
    return F.lit("pass")


def evaluation(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, tp, fp, fn, near: exact matches by label, and how many of the false positives are near misses (a free gold span overlaps)."""
    fp, fn = predicted.join(gold.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end", "label"], "left_anti"), gold.join(predicted.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end", "label"], "left_anti")
    pairs = near_misses(fn, fp).select("doc_id", "start", "end").join(fp.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end"])
    near = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("near"))
    return exact_matches(gold, predicted).join(near, "label", "left").fillna(0, ["near"])


def round_trip(docs: DataFrame, refilled: DataFrame) -> DataFrame:
    """n, restored, blocked: texts that come back from redaction and refill as they were. docs: doc_id, text; refilled: doc_id, status, text."""
    back = refilled.select("doc_id", "status", F.col("text").alias("back"))
    return docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == F.col("back")).alias("restored"), F.count_if(F.col("status") != "ok").alias("blocked"))


def round_trip_rows(rows: DataFrame) -> DataFrame:
    """As round_trip, of refilled rows that have their text beside them (whole, status, text): nothing is joined."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("whole") == F.col("text")).alias("restored"), F.count_if(F.col("status") != "ok").alias("blocked"))


def review_queue(gold: DataFrame, predicted: DataFrame, least: float = 0.75) -> DataFrame:
    """queue, label, n, risk: what people should look at: core spans left in clear (persons, or any in part), semantic spans, and unsure model spans."""
    table = covered(gold, predicted).withColumn("core", core_group(F.col("label"), F.col("category")))
    left = table.where((F.col("status") != "fully") & F.col("core").isin(*CORE) & ((F.col("label") == "PERSON") | (F.col("status") == "partial"))).select(F.lit("core_residual").alias("queue"), "label", F.lit("high").alias("risk"))
    meaning = gold.where(core_group(F.col("label"), F.col("category")) == "semantic").select(F.lit("semantic_policy").alias("queue"), "label", F.lit("medium").alias("risk"))
    unsure = predicted.where((F.col("source") == "model") & (F.col("confidence") < least)).select(F.lit("low_confidence_model").alias("queue"), "label", F.lit("high").alias("risk"))
    return left.unionByName(meaning).unionByName(unsure).groupBy("queue", "label", "risk").agg(F.count(F.lit(1)).alias("n"))


def model_diagnostics(raw: DataFrame, fused: DataFrame, gold: DataFrame, others: DataFrame) -> DataFrame:
    """label, raw, kept, dropped, lift: a model's spans before and after fusion, and gold spans that only the model touches. raw, fused: doc_id, start, end, label, source."""
    key = ["doc_id", "start", "end", "label"]
    model = raw.where(F.col("source") == "model").select(*key).distinct()
    after = fused.where(F.col("source") == "model").select(*key).distinct()
    kept = model.join(after, key, "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    lift = overlapping(overlapping(gold, others, "left_anti"), after).groupBy("label").agg(F.count(F.lit(1)).alias("lift"))
    all_ = model.groupBy("label").agg(F.count(F.lit(1)).alias("raw"))
    joined = all_.join(kept, "label", "full").join(lift, "label", "full").fillna(0, ["raw", "kept", "lift"])
    return joined.select("label", "raw", "kept", (F.col("raw") - F.col("kept")).alias("dropped"), "lift")


def compare(before: DataFrame, after: DataFrame, key: str, measures: tuple[str, ...]) -> DataFrame:
    """key and, of each measure, before, after and delta: two result tables side by side."""
    b, a = (t.select(key, *[F.col(m).alias(f"{m}_{name}") for m in measures]) for t, name in ((before, "before"), (after, "after")))
    columns = [c for m in measures for c in (F.col(f"{m}_before"), F.col(f"{m}_after"), (F.coalesce(f"{m}_after", F.lit(0)) - F.coalesce(f"{m}_before", F.lit(0))).alias(f"{m}_delta"))]
    return b.join(a, key, "full").select(key, *columns)


def dataset_summary(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """kind, value, n: how samples spread over scenarios and kinds of documents, and spans over categories."""
    def one(table: DataFrame, column: str) -> DataFrame:
        return table.groupBy(F.lit(column).alias("kind"), F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    return one(samples, "scenario").unionByName(one(samples, "doc_type")).unionByName(one(gold, "category"))


# Actions that keep a span readable, and those that put a placeholder in.
PRESERVED, REPLACED = ("pass", "warn", "generalize"), ("redact", "block")


def utility_rates(spans: DataFrame, predicted: DataFrame, action: Column) -> DataFrame:
    """category, n, replaced, preserved, preserve_rate: what is left readable under a policy's action where detectors hit or miss. spans: doc_id, start, end, label, category."""
    hit = overlapping(spans, predicted).select("doc_id", "start", "end").distinct().withColumn("hit", F.lit(True))
    marked = spans.withColumn("action", action).join(hit, ["doc_id", "start", "end"], "left")
    gone = F.coalesce(F.col("hit"), F.lit(False)) & F.col("action").isin(*REPLACED)
    kept = F.col("action").isin(*PRESERVED) & ~gone
    out = marked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("replaced"), F.count_if(kept).alias("preserved"))
    return out.withColumn("preserve_rate", ratio(F.col("preserved"), F.col("n")))


def over_redaction(spans: DataFrame, predicted: DataFrame, action: Column, by: str) -> DataFrame:
    """by, n: spans of a utility set that a placeholder hides."""
    hit = overlapping(spans.withColumn("action", action).where(F.col("action").isin(*REPLACED)), predicted)
    return hit.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def action_matrix(spans: DataFrame, strategies: dict[str, Column]) -> DataFrame:
    """strategy, label, action (mixed where categories differ), n, categories."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), a.alias("action")) for k, a in strategies.items()]))
    rows = spans.select("label", "category", each.alias("s")).select("label", "category", "s.*")
    action = F.when(F.count_distinct("action") > 1, "mixed").otherwise(F.min("action"))
    return rows.groupBy("strategy", "label").agg(action.alias("action"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
