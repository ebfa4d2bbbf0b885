"""Scanners for prompt injection and secrets, and what follows from their findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import patterns
from umbra.functions.text import entropy, half_width, keyed_hash, text_hash
from umbra.operators import detect
from umbra.operators.spans import overlapping

SEVERITIES = {"info": 1, "warn": 2, "critical": 3}


def _finding(pattern_id: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(pattern_id).alias("pattern_id"), m.alias("matched"))


def injection(texts: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, pattern_id, matched: all matches of all signatures."""
    found = [F.transform(F.regexp_extract_all("text", F.lit(patterns.FLAGS + p), F.lit(0)), _finding(i)) for i, p in patterns.INJECTION.items()]
    rows = texts.select(*key, F.explode(F.flatten(F.array(*found))).alias("f"))
    return rows.select(*key, "f.pattern_id", "f.matched").where(F.trim("matched") != "")


def secrets(texts: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, pattern_id, matched: known key formats, private keys (of badly framed ones the markers), and named values of enough length and entropy."""
    known = [r for r in patterns.RULES if r.label == "CREDENTIAL" and r.rule_id != "token_like"]
    found = [F.transform(F.regexp_extract_all("text", F.lit(patterns.FLAGS + r.pattern), F.lit(r.group)), _finding(r.rule_id)) for r in known]
    named = F.filter(F.regexp_extract_all("text", F.lit(patterns.SECRET), F.lit(1)), lambda m: (F.char_length(m) >= patterns.SECRET_LENGTH) & (entropy(m) >= patterns.SECRET_BITS))
    found.append(F.transform(named, _finding("generic_secret")))
    scan = half_width("text")
    keys, cut = detect.private_keys(F.col("text"), scan), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    bad = F.when(keys["error"].isNotNull(), detect.matches(scan, patterns.PRIVATE_KEY_MARKER))
    found += [F.transform(keys["ranges"], lambda s: _finding("private_key_block")(cut(s))), F.transform(bad, lambda s: _finding("private_key_malformed")(cut(s)))]
    return texts.select(*key, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f")).select(*key, "f.pattern_id", "f.matched")


def output_alerts(replies: DataFrame, mapped: DataFrame, force_block: bool = False, least: str = "warn", block_from: str | None = None) -> DataFrame:
    """doc_id, type, severity, action, matched, n: secrets of a reply, and placeholders in it that no mapping has. replies: doc_id, reply; mapped: doc_id, placeholder."""
    leaked = secrets(replies.select("doc_id", F.col("reply").alias("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_set("matched")).alias("matched"))
    seen = replies.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("reply", F.lit(patterns.PLACEHOLDER), F.lit(0)))).alias("placeholder"))
    strange = seen.join(mapped.select("doc_id", "placeholder").distinct(), ["doc_id", "placeholder"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("placeholder")).alias("matched"))
    both = leaked.select("doc_id", "matched", F.lit("secret").alias("type"), F.lit("critical").alias("severity"), F.lit(False).alias("forced")).unionByName(strange.select("doc_id", "matched", F.lit("hallucinated_placeholder").alias("type"), F.lit("warn").alias("severity"), F.lit(force_block).alias("forced")))
    rank = severity(F.col("severity"))
    action = F.when(F.col("forced") | (rank >= SEVERITIES[block_from] if block_from else F.lit(False)), "block").otherwise("alert")
    out = both.withColumn("action", action).where((rank >= SEVERITIES[least]) | (F.col("action") == "block"))
    return out.select("doc_id", "type", "severity", "action", "matched", F.size("matched").alias("n"))


def outside_placeholders(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans found in masked texts, without those that touch a placeholder. docs: doc_id, text (masked)."""
    places = docs.select("doc_id", F.explode(detect.matches(F.col("text"), patterns.PLACEHOLDER)).alias("m")).select("doc_id", "m.start", "m.end")
    return overlapping(found.where(F.col("end") > F.col("start")), places, "left_anti")


def severity(name: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for key, rank in SEVERITIES.items():
        out = out.when(name == key, rank)
    return out.otherwise(0)


def alerts(injected: DataFrame, leaked: DataFrame, least: str = "warn", block_from: str | None = None) -> DataFrame:
    """Findings with type, severity, blocked and a hash in place of the match."""
    both = injected.withColumns({"type": F.lit("injection"), "severity": F.lit("warn")}).unionByName(leaked.withColumns({"type": F.lit("secret"), "severity": F.lit("critical")}))
    blocked = severity(F.col("severity")) >= SEVERITIES[block_from] if block_from else F.lit(False)
    out = both.withColumn("blocked", blocked).where((severity(F.col("severity")) >= SEVERITIES[least]) | F.col("blocked"))
    return out.withColumn("text_hash", text_hash("matched")).drop("matched")


#: Patterns whose matches could be guessed: of them not even a keyed hash is kept.
GUESSABLE = ("generic_secret",)


def alert_events(found: DataFrame, key: bytes, direction: str = "outbound", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, type, severity, direction, detector, n, hashes of findings (keep, pattern_id, matched, type, severity): one event for each pattern, without a value.

    hashes are keyed: they tell equal matches under one key, and can't be looked up without it.
    """
    hashed = F.when(~F.col("pattern_id").isin(*GUESSABLE), keyed_hash("matched", key))
    rows = found.withColumn("__hash", hashed)
    out = rows.groupBy(*keep, "type", "severity", F.col("pattern_id").alias("detector")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("__hash")).alias("hashes"))
    return out.select(*keep, "type", "severity", F.lit(direction).alias("direction"), "detector", "n", "hashes")


def summary(found: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, n, max_severity, types (in order, joined by a comma), blocked."""
    out = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max_by("severity", severity(F.col("severity"))).alias("max_severity"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.max("blocked").alias("blocked"))
    return out


def egress(jobs: DataFrame) -> DataFrame:
    """jobs (bound, ready, n_blocked, residual_block, residual_alert: booleans and counts) with reasons and allowed."""
    reasons = F.array_compact(F.array(F.when(~F.col("bound"), "app_not_bound"), F.when(~F.col("ready"), "detector_not_ready"), F.when(F.col("n_blocked") > 0, "blocked_labels"), F.when(F.col("residual_block"), "residual_block"), F.when(F.col("residual_alert"), "residual_alert")))
    return jobs.withColumn("reasons", F.array_join(reasons, ",")).withColumn("allowed", F.size(reasons) == 0)
