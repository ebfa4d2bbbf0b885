"""Detectors: text to span table (doc_id, start, end, label, confidence, source, rule_id, risk_level, surface). Offsets are code points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra import workers
from umbra.functions import patterns, scan, text
from umbra.operators import matcher


def matches(scan: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end>> of all matches of a pattern (or of its group, which ends with the match)."""
    p = patterns.FLAGS + pattern
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        to = acc["at"] + F.char_length(x["gap"]) + F.char_length(F.coalesce(x["whole"], F.lit("")))
        found = F.array(F.struct((to - F.char_length(x["own"])).alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], found)).alias("out"))

    def places(whole: Column) -> Column:
        own = F.regexp_extract_all(scan, F.lit(p), F.lit(group)) if group else whole
        parts = F.arrays_zip(F.split(scan, p, -1).alias("gap"), whole.alias("whole"), own.alias("own"))
        return F.when(F.size(whole) > 0, F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])).otherwise(empty)

    # One search; a text with matches is also split at them, which gives their places.
    return F.get(F.transform(F.array(F.regexp_extract_all(scan, F.lit(p), F.lit(0))), places), F.lit(0))


def private_keys(whole: Column, scan: Column) -> Column:
    """struct<ranges: array<struct<start, end>>, error> of the PEM private keys of a text and its half-width view; null without a marker.

    Bad framing gives an error and no ranges: such a text must not be given out in part.
    """
    def piece(m: Column) -> Column:
        p = F.substring(scan, m["start"] + 1, m["end"] - m["start"])
        name = F.upper(F.regexp_replace(F.regexp_extract(p, "(?i)^-+(?:BEGIN|END)[ \t]+([^-]*)", 1), "[ \t]+", " "))
        framed = p.rlike("^-{5}[^-]") & p.rlike("[^-]-{5}$") & name.endswith("PRIVATE KEY")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), p.rlike("(?i)^-+BEGIN").alias("begin"), name.alias("name"), framed.alias("framed"))

    ranges = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("name"), ranges.alias("ranges"), F.lit(None).cast("string").alias("error"))

    def step(a: Column, m: Column) -> Column:
        opened, same = a["start"].isNotNull(), F.coalesce(a["name"] == m["name"], F.lit(False))
        blank = F.substring(whole, a["end"] + 1, m["start"] - a["end"]).rlike(r"(?U)^\s*\z")
        kind = F.when(~m["framed"], "incomplete").when(m["begin"] & opened, "nested").when(~m["begin"] & ~same, "mismatched").when(~m["begin"] & blank, "empty")
        found = F.when(m["begin"], a["ranges"]).otherwise(F.concat(a["ranges"], F.array(F.struct(a["start"].alias("start"), m["end"].alias("end")))))
        now = [F.when(m["begin"], m[c]).alias(c) for c in ("start", "end", "name")]
        return F.struct(*now, found.alias("ranges"), F.coalesce(a["error"], kind).alias("error"))

    def end(a: Column) -> Column:
        error = F.coalesce(a["error"], F.when(a["start"].isNotNull(), "incomplete"))
        return F.struct(F.when(error.isNull(), a["ranges"]).otherwise(ranges).alias("ranges"), F.concat(error, F.lit(" private key block")).alias("error"))

    folded = F.aggregate(F.transform(matches(scan, patterns.PRIVATE_KEY_MARKER), piece), first, step, end)
    return F.when(scan.rlike(patterns.FLAGS + patterns.PRIVATE_KEY_MARKER), folded)


def _scanned(docs: DataFrame, rules: Iterable[patterns.Rule], surfaces: bool = False) -> DataFrame:
    """doc_id, text, error, spans (scan.SPANS, and the surface if asked) of each text: one pass over compiled patterns."""
    workers.ship(docs.sparkSession)
    wanted, kind = list(rules), docs.schema["doc_id"].dataType.simpleString()
    types = scan.TYPES | ({"surface": "string"} if surfaces else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = scan.prepare(wanted)
        for batch in (part for whole in batches for part in scan.slices(whole)):
            texts = scan.plain(batch.column(1))
            found = [scan.rules(t, prepared) if t is not None else (None, None) for t in texts]
            spans = [s for s, _ in found]
            if surfaces:
                spans = [s if s is None else [(*x, t[x.start : x.end]) for x in s] for s, t in zip(spans, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e for _, e in found], pa.string()), scan.column(spans, types)], ["doc_id", "text", "error", "spans"])

    rows = workers.spread(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, error string, spans {scan.ddl(types)}")


def rule_arrays(docs: DataFrame, rules: Iterable[patterns.Rule] = (*patterns.RULES, patterns.PRIVATE_KEY)) -> DataFrame:
    """doc_id, text, spans (scan.SPANS) beside the text, without a shuffle; of a text with a badly framed private key there are none.

    A rule's pattern runs only on texts that hold one of its anchors. Of spans with equal bounds and label, the most
    confident stays (then the rule that comes last by name).
    """
    return _scanned(docs, rules).drop("error")


def rule_spans(docs: DataFrame, rules: Iterable[patterns.Rule] = (*patterns.RULES, patterns.PRIVATE_KEY)) -> DataFrame:
    """All rules over the half-width view, in one pass. Surfaces are cut from the original text."""
    each = _scanned(docs, rules, surfaces=True).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", *[f"s.{c}" for c in ("start", "end", "label", "confidence", "source", "rule_id", "risk_level", "surface")])


def known_values(docs: DataFrame, values: DataFrame, scope: str = "namespace") -> DataFrame:
    """doc_id, start, end, label, confidence, source, risk_level, canonical_value, surface: values that a scope owns, found again in its texts.

    docs: scope, doc_id (each once), text; values: scope, label, value. Values of 2 to 1000 characters are read literally;
    those of patterns.FLEXIBLE labels without white space may have up to two blanks or line ends between characters. A
    value of another scope is never looked for; texts and values meet by key (matcher).
    """
    fit = values.select(F.col(scope).alias("scope"), "label", F.col("value").alias("needle")).where(F.char_length("value").between(2, 1000)).distinct()
    loose = F.col("label").isin(*patterns.FLEXIBLE) & ~F.col("needle").rlike(r"(?U)\s")
    texts, out = docs.select("doc_id", F.col(scope).alias("scope"), F.col("text").alias("view")), None
    for broken, own in ((False, fit.where(~loose)), (True, fit.where(loose))):
        found = matcher.occurrences(texts, own.select("scope", "needle").distinct(), broken).join(own, ["scope", "needle"])
        out = found if out is None else out.unionByName(found)
    source = F.when(F.col("label").isin(*patterns.FLEXIBLE), "declared_value").otherwise("session_mapping")
    joined = out.join(docs.select(F.col("doc_id").alias("of"), "text"), F.col("doc_id") == F.col("of"))
    return joined.select("doc_id", "start", "end", "label", F.lit(1.0).alias("confidence"), source.alias("source"), F.lit("high").alias("risk_level"), F.col("needle").alias("canonical_value"), F.expr("substring(text, start + 1, end - start)").alias("surface"))


class ModelRequired(RuntimeError):
    """A profile wants a model's spans, and there are none to read."""


def detect(docs: DataFrame, profile, predictions: DataFrame | None = None) -> DataFrame:
    """Rule spans, and the model's where the profile uses one. A profile that requires a model fails without its predictions: rules alone would let names pass unseen."""
    if profile.model_required and predictions is None:
        raise ModelRequired(f"profile {profile.name} requires model predictions")
    found = rule_spans(docs)
    if predictions is None or not profile.use_model:
        return found
    model = adapt_predictions(predictions, docs).withColumns({"rule_id": F.lit(None).cast("string")})
    return found.unionByName(model.select(*found.columns))


def dictionary_spans(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """doc_id, start, end, label, confidence, source, entry_id, canonical_value, risk_level, surface.

    needles: entry_id, canonical_value, needle, label, risk_level. Texts and needles are compared in half-width and meet by
    key (matcher): no needle is broadcast or passes the driver.
    """
    every = F.lit(0)
    wanted = needles.select("entry_id", "canonical_value", text.half_width(F.trim("needle")).alias("needle"), "label", "risk_level").where(F.col("needle") != "").distinct()
    found = matcher.occurrences(docs.select("doc_id", every.alias("scope"), text.half_width("text").alias("view")), wanted.select(every.alias("scope"), "needle").distinct())
    joined = found.join(wanted, "needle").join(docs.select(F.col("doc_id").alias("of"), "text"), F.col("doc_id") == F.col("of"))
    surface = F.expr("substring(text, start + 1, end - start)").alias("surface")
    return drop_overlaps(joined.select("doc_id", "start", "end", "label", F.lit(0.99).alias("confidence"), F.lit("dictionary").alias("source"), "entry_id", "canonical_value", "risk_level", surface))


def drop_overlaps(spans: DataFrame) -> DataFrame:
    """Of overlapping spans with the same label, the first (then longest) stays; per document and label."""
    order = F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("end")).alias("short"), F.struct(*[c for c in spans.columns if c not in ("doc_id", "label", "start")]).alias("rest"))))
    kind = spans.groupBy("doc_id", "label").agg(order.alias("all"))
    kept = F.aggregate("all", F.struct(F.lit(-1).alias("to"), F.slice("all", 1, 0).alias("out")), lambda a, x: F.when(x["start"] >= a["to"], F.struct(x["rest"]["end"].alias("to"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    return kind.select("doc_id", "label", F.explode(kept).alias("s")).select("doc_id", F.col("s.start"), "label", "s.rest.*").select(*spans.columns)


def leading_repair(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """doc_id, start, end, label, canonical_value: texts that begin with a needle but for its first character, if one canonical value owns that rest."""
    rests = needles.where(F.char_length("needle") >= 5).select("label", F.expr("substring(needle, 2)").alias("rest"), "canonical_value").distinct()
    single = rests.groupBy("label", "rest").agg(F.count_distinct("canonical_value").alias("n"), F.min("canonical_value").alias("canonical_value")).where(F.col("n") == 1)
    lengths = single.select(F.char_length("rest").alias("size")).distinct()  # as many as there are lengths
    heads = docs.join(F.broadcast(lengths), F.char_length("text") >= F.col("size")).select("doc_id", F.expr("substring(text, 1, size)").alias("rest"))
    return heads.join(single, "rest").select("doc_id", F.lit(0).alias("start"), F.char_length("rest").alias("end"), "label", "canonical_value")


def suppress_areas(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans without amounts that are an area."""
    rest = docs.select(F.col("doc_id").alias("of"), F.col("text").alias("whole"))
    joined = spans.join(rest, F.col("doc_id") == F.col("of"), "left")
    tail = F.substring(F.col("whole"), F.col("end") + 1, F.lit(12))
    area = (F.col("label") == "AMOUNT") & (tail.rlike(patterns.AREA) | F.col("surface").rlike("(?:平方米|平米|㎡|m²)$"))
    return joined.where(~F.coalesce(area, F.lit(False))).select(*spans.columns)


def clean_predictions(predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """A model's output table (doc_id, start, end, label, score) as spans: malformed rows go, scores are held in [0, 1]. Texts aren't read."""
    good = predictions.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & F.col("label").isNotNull() & F.col("score").isNotNull())
    out = good.select("doc_id", "start", "end", "label", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.lit("model").alias("source"), F.lit("high").alias("risk_level"))
    return out.where(F.col("confidence") >= least)


def adapt_predictions(predictions: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The same with surfaces; spans outside of their text go."""
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    joined = clean_predictions(predictions, least).join(texts, F.col("doc_id") == F.col("of")).where(F.col("end") <= F.char_length("text"))
    return joined.drop("of").withColumn("surface", F.expr("substring(text, start + 1, end - start)")).drop("text")


def cut_windows(docs: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """doc_id, window, start, end: pieces of at most `size` characters for a model, cut at the last line end, else sentence end, of their back half.

    The next piece begins `overlap` characters before the last cut. A text is walked through once: each piece takes as long
    as its own characters.
    """
    workers.ship(docs.sparkSession)
    half, kind, types = size // 2, docs.schema["doc_id"].dataType.simpleString(), {"start": "int", "end": "int"}

    def cuts(whole: str) -> list[tuple[int, int]]:
        out, start = [], 0
        while True:
            hard = cut = min(len(whole), start + size)
            if hard < len(whole):
                line = whole.rfind("\n", start + half, hard)
                stop = max(whole.rfind(c, start + half + 1, hard) for c in patterns.SENTENCE_ENDS)
                cut = line + 1 if line >= 0 else stop + 1 if stop >= 0 else hard
            out.append((start, cut))
            if cut >= len(whole):
                return out
            start = max(start + 1, cut - overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), scan.column([cuts(t) for t in batch.column(1).to_pylist()], types)], ["doc_id", "all"])

    rows = workers.spread(docs.where(F.char_length("text") > 0).select("doc_id", "text"))
    folded = rows.mapInArrow(run, f"doc_id {kind}, all {scan.ddl(types)}")
    return folded.select("doc_id", F.posexplode("all").alias("window", "w")).select("doc_id", "window", "w.start", "w.end")


def windows(docs: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """doc_id, window, start, piece: a text cut into pieces for a model, by hard cuts."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where(F.char_length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("window", "start")).select("doc_id", "window", "start", F.expr(f"substring(text, start + 1, {size})").alias("piece"))
