"""Ways back from placeholders other than one plain text: JSON values, edited Markdown, answers, sessions, grants."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from umbra import workers
from umbra.functions import patterns
from umbra.functions.text import text_hash
from umbra.operators.placeholders import altered, found, refill

# Limits of JSON values.
DEPTH, NODES, CHARS = 32, 10_000, 200_000

_EXACT = re.compile(patterns.PLACEHOLDER)
_LOOSE = [re.compile(p) for p in patterns.ALTERED]
_BARE = re.compile(patterns.BARE_PLACEHOLDER)


def _leaves(value: object, depth: int = 1, path: str = "$") -> Iterator[tuple[str, object, int]]:
    """path, leaf or container, depth of all nodes of a JSON value, in order."""
    yield path, value, depth
    if depth > DEPTH:
        return
    inner = enumerate(value) if isinstance(value, list) else value.items() if isinstance(value, dict) else ()
    for k, v in inner:
        yield from _leaves(v, depth + 1, f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}")


def _mapped(value: object, f) -> object:
    if isinstance(value, str):
        return f(value)
    if isinstance(value, list):
        return [_mapped(v, f) for v in value]
    return {k: _mapped(v, f) for k, v in value.items()} if isinstance(value, dict) else value


def _read(raw: str | None) -> tuple[object, list[str], str | None]:
    """The value, its string leaves, and why it is turned away."""
    try:
        value = json.loads(raw or "")
    except (ValueError, RecursionError):
        return None, [], "invalid_json"
    strings, nodes, chars = [], 0, 0
    for _, v, depth in _leaves(value):
        nodes += 1
        if depth > DEPTH:
            return value, [], "too_deep"
        if nodes > NODES:
            return value, [], "too_many_nodes"
        if isinstance(v, float) and not math.isfinite(v):
            return value, [], "number_not_finite"
        if isinstance(v, str):
            strings.append(v)
            chars += len(v)
    return value, strings, "too_long" if chars > CHARS else None


def _altered(text: str) -> set[str]:
    exact = set(_EXACT.findall(text))
    return {x for p in _LOOSE for x in p.findall(text)} - exact | set(_BARE.findall(text))


def string_leaves(rows: DataFrame, column: str = "payload", key: str = "doc_id") -> DataFrame:
    """key, path, value: the strings of JSON values (keys aren't read); a value beyond the limits gives one row with path null and the reason."""
    workers.ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, raw in zip(frame[key], frame[column], strict=True):
                value, _, bad = _read(raw)
                out += [(k, None, bad)] if bad else [(k, p, v) for p, v, _ in _leaves(value) if isinstance(v, str)]
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, path string, value string")


@F.pandas_udf(StringType())
def lower_descriptions(payload: pd.Series) -> pd.Series:
    """A JSON value with only its `description` strings in lower case: the shape of maps that touch nothing but descriptions."""
    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {k: x.lower() if k == "description" and isinstance(x, str) else walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    return payload.map(lambda raw: raw if raw is None else json.dumps(walk(json.loads(raw)), ensure_ascii=False, separators=(",", ":")))


def structured(rows: DataFrame, mapped: DataFrame, contract: str = "exact_transform") -> DataFrame:
    """doc_id, status, payload (null unless ok), error_types: JSON values whose strings are all checked before any is filled in.

    rows: doc_id, payload; mapped: doc_id, placeholder, original_value, n. exact_transform compares the counts of all placeholders.
    """
    table = mapped.groupBy(F.col("doc_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original_value"))).alias("known"), F.map_from_entries(F.collect_list(F.struct("placeholder", F.col("n").cast("int")))).alias("counts"))
    joined = rows.select("doc_id", "payload").join(table, F.col("doc_id") == F.col("of"), "left").drop("of")
    workers.ship(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]

    def one(raw: str | None, known: dict, expected: Counter) -> tuple[str, str | None, list[str]]:
        value, strings, bad = _read(raw)
        if bad:
            return "blocked", None, [bad]
        seen = Counter(p for s in strings for p in _EXACT.findall(s))
        exact = contract == "exact_transform"
        tests = (("unknown", bool(set(seen) - set(known))), ("missing", exact and any(not seen[p] for p in expected)), ("altered", any(map(_altered, strings))), ("count_mismatch", exact and seen != expected), ("not_allowed", contract == "none"))
        errors = [name for name, holds in tests if holds]
        if errors:
            return "blocked", None, errors
        return "ok", json.dumps(_mapped(value, lambda s: _EXACT.sub(lambda m: known.get(m[0], m[0]), s)), ensure_ascii=False, separators=(",", ":")), []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, *one(raw, dict(known or {}), Counter(dict(counts or {})))) for k, raw, known, counts in zip(frame["doc_id"], frame["payload"], frame["known"], frame["counts"], strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "status", "payload", "error_types"])

    return joined.mapInPandas(run, f"doc_id {kind}, status string, payload string, error_types array<string>")


def _problems(text: Column, mapped: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, reply) with values, unknown, altered, missing, duplicated, hits."""
    n = workers.joint(rows)  # a task's share stays the same as tables grow
    table = mapped.withColumnRenamed("doc_id", "of").repartition(n, "of").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original_value"))).alias("values"), F.map_from_entries(F.collect_list(F.struct("placeholder", F.col("n").cast("int")))).alias("counts"))
    joined = rows.repartition(n, "doc_id").join(table, F.col("doc_id") == F.col("of"), "left").drop("of")
    joined = joined.withColumns({"values": F.coalesce("values", F.expr("map()").cast("map<string,string>")), "counts": F.coalesce("counts", F.expr("map()").cast("map<string,int>")), "all": found(text)})
    known, times = F.map_keys("values"), lambda k: F.size(F.filter("all", lambda x: x == k))
    return joined.withColumns({
        "unknown": F.array_sort(F.array_distinct(F.array_except("all", known))), "altered": altered(text), "missing": F.array_sort(F.array_except(known, F.col("all"))),
        "duplicated": F.array_sort(F.filter(known, lambda k: times(k) > F.element_at("counts", k))), "hits": F.size(F.filter("all", lambda x: F.array_contains(known, x))),
    })


def _filled(text: Column) -> Column:
    gaps = F.split(text, patterns.PLACEHOLDER, -1)
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), found(text).alias("p")), lambda x: F.concat(x["g"], F.when(x["p"].isNull(), "").otherwise(F.coalesce(F.try_element_at("values", x["p"]), x["p"])))), "")


def markdown(texts: DataFrame, mapped: DataFrame, confirmed: bool = False) -> DataFrame:
    """doc_id, mode, status, text: edited or unedited Markdown. texts: doc_id, reply, recorded (sha256 of what was given out, or null).

    Unedited text must keep every placeholder's count. An edited one whose placeholders are not all there once more
    needs a confirmation; unknown or altered placeholders block in any mode.
    """
    rows = _problems(F.col("reply"), mapped, texts.select("doc_id", "reply", "recorded"))
    mode = F.when(F.sha2("reply", 256) == F.col("recorded"), "exact").otherwise("edited")
    bad = (F.size("unknown") > 0) | (F.size("altered") > 0)
    uneven = (F.size("missing") > 0) | (F.size("duplicated") > 0)
    status = F.when(bad, "blocked").when(uneven & (mode == "exact"), "blocked").when(uneven & F.lit(not confirmed), "needs_confirmation").otherwise("ok")
    return rows.select("doc_id", mode.alias("mode"), status.alias("status"), F.when(status == "ok", _filled(F.col("reply"))).alias("text"))


def answers(texts: DataFrame, mapped: DataFrame, confirmed: bool = False) -> DataFrame:
    """doc_id, status, text: answers may name some placeholders, or one often; one that names none needs a confirmation. texts: doc_id, reply."""
    rows = _problems(F.col("reply"), mapped, texts.select("doc_id", "reply"))
    status = F.when((F.size("unknown") > 0) | (F.size("altered") > 0), "blocked").when((F.col("hits") == 0) & F.lit(not confirmed), "needs_confirmation").otherwise("ok")
    return rows.select("doc_id", status.alias("status"), F.when(status == "ok", _filled(F.col("reply"))).alias("text"))


def all_or_none(texts: DataFrame, mapped: DataFrame) -> DataFrame:
    """doc_id, status, text: the older contract, by which every known placeholder must appear, however often."""
    rows = _problems(F.col("reply"), mapped, texts.select("doc_id", "reply"))
    status = F.when((F.size("unknown") > 0) | (F.size("missing") > 0) | (F.size("altered") > 0), "blocked").otherwise("ok")
    return rows.select("doc_id", status.alias("status"), F.when(status == "ok", _filled(F.col("reply"))).alias("text"))


def session(texts: DataFrame, mapped: DataFrame, strict: bool) -> DataFrame:
    """doc_id, status, text, error_types, restored: replies of a session; a strict profile wants all its placeholders, another one lets them be left out."""
    rows = _problems(F.col("reply"), mapped, texts.select("doc_id", "reply"))
    errors = F.array_compact(F.array(F.when(F.size("unknown") > 0, "unknown_placeholder"), F.when((F.size("missing") > 0) & F.lit(strict), "missing_placeholder"), F.when(F.size("altered") > 0, "altered_placeholder")))
    ok = F.size(errors) == 0
    return rows.select("doc_id", F.when(ok, "ok").otherwise("blocked").alias("status"), F.when(ok, _filled(F.col("reply"))).alias("text"), errors.alias("error_types"), F.when(ok, F.col("hits")).otherwise(0).alias("restored"))


def grants(masked: DataFrame, mapped: DataFrame, app_id: str) -> DataFrame:
    """handle, app_id, doc_id, expected: a grant for each masked text (doc_id, redacted_text); the handle tells nothing, the counts are of the text."""
    seen = masked.select("doc_id", F.explode(found(F.col("redacted_text"))).alias("placeholder")).groupBy("doc_id", "placeholder").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = seen.join(mapped.select("doc_id", "placeholder"), ["doc_id", "placeholder"], "left_semi").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("placeholder", "n")))).alias("expected"))
    return counts.select(F.expr("uuid()").alias("handle"), F.lit(app_id).alias("app_id"), "doc_id", "expected")


def granted(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (handle, app_id) with doc_id, expected and status: a handle is good for its own application only, and a stranger can't tell a wrong one from another's."""
    g = grants.withColumnRenamed("app_id", "owner")
    own = F.col("owner") == F.col("app_id")
    return requests.join(g, "handle", "left").select(*requests.columns, F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("expected")).alias("expected"), F.when(own, "ok").otherwise("not_found").alias("status"))


def audit_rows(refilled: DataFrame, handles: DataFrame, contract: str) -> DataFrame:
    """handle_hash, contract, status, restored: what is kept of a refill; no value, no text, and the handle as a hash. refilled: doc_id, status, text; handles: doc_id, handle, restored."""
    return refilled.join(handles, "doc_id").select(text_hash("handle").alias("handle_hash"), F.lit(contract).alias("contract"), "status", F.when(F.col("status") == "ok", F.col("restored")).otherwise(0).alias("restored"))


__all__ = ["all_or_none", "answers", "audit_rows", "granted", "grants", "lower_descriptions", "markdown", "refill", "session", "string_leaves", "structured"]
