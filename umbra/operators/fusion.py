"""One detection run under a profile: spans of all sources beside their text, fused, decided, numbered and put in.

Rules run in the same pass that fuses; spans of other sources (tables by doc_id) are gathered to their text in one
exchange, or none if there are none. After that nothing is joined: a document's spans stay an array beside its text.

The run is fail-closed. A profile that requires a model doesn't start without its predictions; a text that is too long,
holds a placeholder or a badly framed private key, or has a span outside of it, comes back with an error and no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra import workers
from umbra.functions import patterns, scan
from umbra.operators import detect, limits, policy

_GIVEN = ("start", "end", "label", "confidence", "source", "rule_id", "risk_level", "canonical_value")  # as in scan.Span
_GIVEN_TYPE = scan.ddl({n: scan.TYPES[n] for n in _GIVEN})


@dataclass(frozen=True)
class Detector:
    """A source of spans by name: `spans` makes (doc_id, start, end, label, confidence, ...) of (doc_id, text)."""

    name: str
    spans: Callable[[DataFrame], DataFrame]


DETECTORS: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    """Detections of a run may name it from now on. Its rank is that of its name in patterns.SOURCES, else OTHER_SOURCE."""
    if detector.name in DETECTORS:
        raise ValueError(f"detector {detector.name} is registered already")
    DETECTORS[detector.name] = detector
    return detector


def _table(spans: DataFrame, source: str | None = None) -> DataFrame:
    """A span table in the columns that a run takes; missing ones are null."""
    kinds = dict(zip(_GIVEN, ("int", "int", "string", "double", "string", "string", "string", "string"), strict=True))
    columns = [F.col(c).cast(t).alias(c) if c in spans.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    out = spans.select("doc_id", *columns)
    return out.withColumn("source", F.lit(source)) if source else out


def wanted_rules(profile: policy.Profile, rules: Iterable[patterns.Rule] = (*patterns.RULES, patterns.PRIVATE_KEY)) -> list[patterns.Rule]:
    """The rules, and those of public context where the profile leaves both their labels in clear."""
    clear = {*profile.deny, *(label for label, action in profile.actions.items() if action == "pass")}
    return [*rules, *(patterns.PUBLIC if {r.label for r in patterns.PUBLIC} <= clear else ())]


def run(docs: DataFrame, profile: policy.Profile, predictions: DataFrame | None = None, spans: Iterable[DataFrame] = (), detectors: Iterable[str] = (), rules: Iterable[patterns.Rule] = (*patterns.RULES, patterns.PRIVATE_KEY), model: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, text, error, degraded, blocked, spans of each document (doc_id, text; ids each once).

    predictions: a model's output (doc_id, start, end, label, score); spans: tables of further sources (dictionary,
    declared and known values, manual); detectors: names of registered ones; model: what makes spans of predictions and
    documents (model_spans.spans repairs names); without it predictions count as they are, and those outside of their text
    go. The array holds what the profile doesn't leave in clear, with text_hash, action, coarse and role; blocked are labels
    that the profile blocks. degraded: the profile would use a model, and there was none.

    A null text has no spans; a null id is one like any other; spans of ids that no document has are ignored; repeated spans count once.
    """
    if profile.model_required and predictions is None:
        raise detect.ModelRequired(f"profile {profile.name} requires model predictions")
    workers.ship(docs.sparkSession)
    reason = limits.refused(F.col("text"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("error"))
    tables = [_table(t) for t in spans] + [_table(DETECTORS[name].spans(docs.select("doc_id", "text")), name) for name in detectors]
    if predictions is not None and profile.use_model:
        tables.append(_table(model(predictions, docs) if model else detect.clean_predictions(predictions), "model"))
    rows = rows.withColumn("given", F.lit(None).cast(_GIVEN_TYPE))
    if tables:
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        # Both sides are dealt alike, into a number of parts that Spark doesn't lessen: their bytes are few, what Python does with them isn't.
        n, key = workers.parts(docs.select("doc_id", "text")), [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()]
        dealt = every.select(key[0].alias("__id"), key[1].alias("__null"), *_GIVEN).repartition(n, "__id", "__null")
        lists = dealt.groupBy("__id", "__null").agg(F.collect_set(F.struct(*_GIVEN)).alias("__given"))
        rows = rows.drop("given").withColumns({"__id": key[0], "__null": key[1]}).repartition(n, "__id", "__null")
        rows = rows.join(lists, ["__id", "__null"], "left").select("doc_id", "text", "error", F.col("__given").alias("given"))
    fused = _fused(rows if tables else workers.spread(rows), wanted_rules(profile, rules), patterns.ROLES.get(profile.roles) if profile.roles else None, profile)
    return _decided(fused, profile, profile.use_model and predictions is None)


_TYPES = {**scan.TYPES, "text_hash": "string", "role": "string", "surface": "string"}


def _fused(rows: DataFrame, rules: list[patterns.Rule], cues: dict[str, str] | None, profile: policy.Profile) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema, prepared = f"doc_id {kind}, text string, error string, spans {scan.ddl(_TYPES)}", []

    def one(whole: str | None, error: str | None, given: list[tuple] | None) -> tuple[str | None, list[tuple] | None]:
        if whole is None or error:
            return error, None
        if not prepared:
            prepared.append(scan.prepare(rules))
        found, error = scan.rules(whole, prepared[0])
        others = [s for s in (scan.Span(*g) for g in given or ()) if s.source != "model" or s.end is None or s.end <= len(whole)]
        if not error and any(s.start is None or s.end is None or s.label is None or not 0 <= s.start < s.end <= len(whole) for s in others):
            error = "span_out_of_bounds"
        if error:
            return error, None
        left = scan.fuse(whole, [*found, *(s._replace(confidence=1.0 if s.confidence is None else s.confidence, source=s.source or "") for s in others)])
        named = scan.roles(whole, left, cues) if cues else [None] * len(left)
        return None, [(*s, scan.digest(value := whole[s.start : s.end]), role, value) for s, role in zip(left, named, strict=True) if policy.kept(profile, s.label, s.risk_level, s.rule_id == patterns.PRIVATE_KEY.rule_id)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            every = scan.plain(batch.column(1))
            done = [one(*r) for r in zip(every, scan.plain(batch.column(2)), scan.lists(batch.column(3)), strict=True)]
            errors = pa.array([e for e, _ in done], pa.string())
            texts = pa.array([None if e else t for t, (e, _) in zip(every, done, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, errors, scan.column([s for _, s in done], _TYPES)], ["doc_id", "text", "error", "spans"])

    return rows.mapInArrow(task, schema)


def _decided(fused: DataFrame, profile: policy.Profile, degraded: bool) -> DataFrame:
    # What stays in clear is gone already; spans that are left get their action here.
    def judged(s: Column) -> Column:
        action = policy.decide(profile, s["label"], s["risk_level"], s["rule_id"] == patterns.PRIVATE_KEY.rule_id)
        return F.struct(*[s[n].alias(n) for n in _TYPES], action.alias("action"), policy.coarse(profile, s["label"], s["surface"], action).alias("coarse"))

    spans = F.filter(F.transform("spans", judged), lambda s: s["action"].isin("redact", "generalize", "block"))
    out = fused.select("doc_id", "text", "error", F.lit(degraded).alias("degraded"), spans.alias("spans"))
    blocked = F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["action"] == "block"), lambda s: s["label"])))
    return out.select("doc_id", "text", "error", "degraded", blocked.alias("blocked"), "spans")


def exploded(ran: DataFrame) -> DataFrame:
    """The spans of a run as a table."""
    return ran.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def redacted(ran: DataFrame, *keep: str) -> DataFrame:
    """doc_id, redacted_text, mapping (array of placeholder, label, original_value, n), error, degraded, blocked of a run. No exchange.

    keep: further columns of the run (spans, or made of them), which stay beside it: a plan that reads run and result would run twice.
    """
    kind = ran.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, redacted_text string, mapping {scan.ddl(scan.MAPPED)}, error string, degraded boolean, blocked array<string>"
    schema = ", ".join([schema, *(f"`{c}` {ran.schema[c].dataType.simpleString()}" for c in keep)])

    def one(whole: str | None, spans: list[tuple] | None) -> tuple[str | None, list[tuple] | None]:
        if whole is None:
            return None, None
        spans = spans or []  # start, end, label, role, surface, coarse
        values, mapped = scan.put_in(s[2:] for s in spans)
        return scan.replaced(whole, ((s[0], s[1], v) for s, v in zip(spans, values, strict=True))), mapped

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            done = [one(*r) for r in zip(scan.plain(batch.column(1)), scan.lists(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), scan.column([m for _, m in done], scan.MAPPED), *batch.columns[3:]], ["doc_id", "redacted_text", "mapping", *batch.schema.names[3:]])

    needed = F.transform("spans", lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "label", "role", "surface", "coarse")]))
    return ran.select("doc_id", "text", needed.alias("__spans"), "error", "degraded", "blocked", *keep).mapInArrow(task, schema)


def mapping(done: DataFrame) -> DataFrame:
    """doc_id, placeholder, label, original_value, n, text_hash of redacted documents: what leads back to the values."""
    rows = done.select("doc_id", F.explode("mapping").alias("m")).select("doc_id", "m.*")
    return rows.withColumn("text_hash", F.concat(F.lit("sha256:"), F.sha2(F.encode("original_value", "UTF-8"), 256)))


def redact_batches(items: DataFrame, profile: policy.Profile, predictions: DataFrame | None = None, shared: bool = False, most: int = limits.BATCH_ITEMS, chars: int = limits.TEXT_CHARS) -> DataFrame:
    """batch_id, item_id, status, redacted_text of items (batch_id, item_id, text), under one verdict for each batch.

    A batch that is too large, has an item id twice or none, a text that is too long or turned away by the run, or a label that
    the profile blocks, is refused as a whole: the status says why and no text of it comes back. shared: a value has the same
    placeholder in all items of its batch, numbered in the order of items; else each item counts for itself.
    """
    from umbra.operators import placeholders

    verdict = limits.batches(items, most, chars).select(F.col("batch_id").alias("__batch"), F.col("status").alias("verdict"))
    judged = items.select("batch_id", "item_id", "text").join(verdict, F.col("batch_id").eqNullSafe(F.col("__batch"))).drop("__batch")
    good = judged.where("verdict = 'ok'").select(F.to_json(F.struct("batch_id", "item_id"), {"ignoreNullFields": "false"}).alias("doc_id"), "batch_id", "item_id", "text")
    ran = run(good.select("doc_id", "text"), profile, predictions)
    names = good.select(F.col("doc_id").alias("__id"), "batch_id", "item_id")
    done = redacted(ran).join(names, F.col("doc_id") == F.col("__id"))
    bad = done.groupBy("batch_id").agg(F.coalesce(F.min("error"), F.when(F.max(F.size("blocked")) > 0, "blocked"), F.lit("ok")).alias("status"))
    if shared:
        spans = exploded(ran).join(names, F.col("doc_id") == F.col("__id")).drop("__id")
        named = placeholders.number(spans, "batch_id", ("item_id", "start"))
        texts = placeholders.rewrite(ran.where("error IS NULL"), named.select("doc_id", "start", "end", F.coalesce("coarse", "placeholder").alias("replacement")))
        done = done.drop("redacted_text").join(texts.select(F.col("doc_id").alias("__of"), "redacted_text"), F.col("doc_id").eqNullSafe(F.col("__of")), "left")
    out = done.select("batch_id", "item_id", "redacted_text").join(bad.withColumnRenamed("batch_id", "__batch"), F.col("batch_id").eqNullSafe(F.col("__batch")))
    refused = judged.where("verdict <> 'ok'").select("batch_id", "item_id", F.col("verdict").alias("status"), F.lit(None).cast("string").alias("redacted_text"))
    return out.select("batch_id", "item_id", "status", F.when(F.col("status") == "ok", F.col("redacted_text")).alias("redacted_text")).unionByName(refused)


def findings(masked: DataFrame, profile_rules: Iterable[patterns.Rule] = (*patterns.RULES, patterns.PRIVATE_KEY)) -> DataFrame:
    """doc_id, label, source, n: what detection finds again in masked texts (doc_id, redacted_text; ids each once) outside of their placeholders, fused. No exchange."""
    workers.ship(masked.sparkSession)
    rules, kind, counted = list(profile_rules), masked.schema["doc_id"].dataType.simpleString(), {"label": "string", "source": "string", "n": "long"}

    def one(whole: str | None, prepared: scan.Prepared) -> list[tuple]:
        spans, error = scan.rules(whole, prepared) if whole is not None else ([], None)
        places = [m.span() for m in re.finditer(patterns.PLACEHOLDER, whole)] if spans else []
        counts = Counter((s.label, s.source) for s in scan.outside(scan.fuse(whole, spans), places)) if spans and not error else {}
        return [(*key, n) for key, n in sorted(counts.items())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = scan.prepare(rules)
        for batch in (part for whole in batches for part in scan.slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), scan.column([one(t, prepared) for t in scan.plain(batch.column(1))], counted)], ["doc_id", "found"])

    found = masked.select("doc_id", F.col("redacted_text").cast("string")).mapInArrow(task, f"doc_id {kind}, found {scan.ddl(counted)}")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def snapshot(done: DataFrame, items: DataFrame) -> DataFrame:
    """namespace, placeholder, label, sources, documents, occurrences, detectors of a job's mapping: where its values stand, and what found them.

    done: what redacted() gives, with the spans of its run beside it (doc_id, mapping, spans); items: doc_id, namespace, source.
    """
    each = done.select("doc_id", F.explode("mapping").alias("m"), "spans").select("doc_id", "m.placeholder", "m.label", "m.original_value", "m.n", F.array_distinct(F.transform(F.filter("spans", lambda s: s["surface"] == F.col("m.original_value")), lambda s: F.concat_ws(":", s["source"], s["rule_id"]))).alias("by"))
    joined = each.join(items.select(F.col("doc_id").alias("__of"), "namespace", "source"), F.col("doc_id") == F.col("__of"))
    out = joined.groupBy("namespace", "label", "original_value").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("by")))).alias("detectors"))
    return out.select("namespace", "label", F.concat(F.lit("sha256:"), F.sha2("original_value", 256)).alias("text_hash"), "sources", "documents", "occurrences", "detectors")


def normalize(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, error, degraded, blocked, spans of documents under spans that a caller gives: with whole private keys added, fused again, hashed anew.

    A span outside of its text, and a badly framed key, turn their document away.
    """
    return run(docs, policy.Profile("given", use_model=False), spans=[spans], rules=[patterns.PRIVATE_KEY])
