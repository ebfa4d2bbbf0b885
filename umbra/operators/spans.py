"""Span algebra on span tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from umbra import workers
from umbra.functions import patterns, scan
from umbra.functions.text import text_hash

PIECE = {"start": "int", "end": "int", "no": "int"}


def clip(spans: DataFrame, priority: str = "priority") -> DataFrame:
    """Each character belongs to the best span over it (priority, confidence, length, then order); spans keep what is theirs.

    Spans meet in one exchange by doc_id, ranked; a sweep over the ends of a document's spans, with the live ones in a heap,
    gives each its pieces in n log n.
    """
    workers.ship(spans.sparkSession)
    key = F.struct((-F.col(priority)).alias("p"), (-F.col("confidence")).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "label", "source", F.struct(*spans.columns).alias("own"))
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("all"))
    lists = lists.select("doc_id", F.transform("all", lambda x: x["own"]).alias("all"), F.transform("all", lambda x: x["start"]).alias("starts"), F.transform("all", lambda x: x["end"]).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            swept = [scan.sweep(list(zip(s, e, strict=True))) for s, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scan.column(swept, PIECE)], ["doc_id", "all", "pieces"])

    schema = StructType([lists.schema["doc_id"], lists.schema["all"]]).add("pieces", ArrayType(StructType([StructField(n, IntegerType()) for n in PIECE])))
    pieces = lists.mapInArrow(run, schema).select("doc_id", F.explode(F.transform("pieces", lambda x: F.struct(x["start"].alias("new_start"), x["end"].alias("new_end"), F.get("all", x["no"]).alias("own")))).alias("x")).select("doc_id", "x.*")
    clipped = (F.col("new_start") != F.col("own.start")) | (F.col("new_end") != F.col("own.end"))
    rest = [F.col(f"own.{c}") for c in spans.columns if c not in ("doc_id", "start", "end")]
    return pieces.select("doc_id", F.col("new_start").alias("start"), F.col("new_end").alias("end"), *rest, clipped.alias("clipped"))


def trim(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans without white space at their edges, with surface; empty ones go."""
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    raw = F.expr("substring(text, start + 1, end - start)")
    joined = spans.drop("surface").join(texts, F.col("doc_id") == F.col("of")).withColumn("raw", raw)
    left, right = F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"(?U)^\s+", "")), F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"(?U)\s+$", ""))
    moved = joined.withColumns({"start": F.col("start") + left, "end": F.col("end") - right}).where(F.col("end") > F.col("start"))
    return moved.withColumn("surface", F.expr("substring(text, start + 1, end - start)")).drop("of", "text", "raw")


def drop_contained(spans: DataFrame) -> DataFrame:
    """Model spans within a model span of another label that is at least two characters longer go."""
    model = spans.where(F.col("source") == "model")
    outer = model.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("l"))
    inside = (F.col("doc_id") == F.col("d")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & (F.col("l") != F.col("label")) & (F.col("e") - F.col("s") >= F.col("end") - F.col("start") + 2)
    return model.join(outer, inside, "left_anti").unionByName(spans.where(F.col("source") != "model"))


def drop_redundant(spans: DataFrame) -> DataFrame:
    """Of model spans of one label where one holds the other, the better ranked stays (priority, confidence, length, order); per document and label."""
    key = F.struct((-F.col("priority")).alias("p"), (-F.col("confidence")).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "end", F.struct(*spans.columns).alias("own"))
    model = spans.where(F.col("source") == "model").groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(key)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        held = F.exists(kept, lambda k: ((x["start"] <= k["start"]) & (x["end"] >= k["end"])) | ((k["start"] <= x["start"]) & (k["end"] >= x["end"])))
        return F.when(held, kept).otherwise(F.concat(kept, F.array(x)))

    best = model.select(F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("s")).select("s.own.*")
    return best.unionByName(spans.where(F.col("source") != "model"))


def drop_fragments(spans: DataFrame) -> DataFrame:
    """Clipped spans (with surface) go where nothing but a general part of a name, or one character of a name or place, is left."""
    bare = F.regexp_replace("surface", r"(?U)\s", "")
    left = (F.col("label").isin("ORG", "ADDRESS") & (F.char_length(bare) == 1)) | ((F.col("label") == "ORG") & bare.isin(*patterns.CLIPPED_NAMES))
    return spans.where(~(F.coalesce(F.col("clipped"), F.lit(False)) & left))


def normalize(spans: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, out of bounds): a caller's spans with text_hash, each once, and those outside of their text, which must stop a job."""
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    joined = spans.join(texts, F.col("doc_id") == F.col("of"), "left")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.char_length("text"))
    marked = joined.withColumns({"inside": F.coalesce(inside, F.lit(False)), "text_hash": text_hash(F.expr("substring(text, start + 1, end - start)"))}).drop("of", "text")
    return marked.where("inside").drop("inside").dropDuplicates(["doc_id", "start", "end", "label", "text_hash"]), marked.where("not inside").drop("inside", "text_hash")


def exact_members(spans: DataFrame, others: DataFrame, how: str = "left_semi") -> DataFrame:
    """spans that are among the others with bounds, label, hash and source (or that aren't, by left_anti)."""
    key = ["doc_id", "start", "end", "label", "text_hash", "source"]
    return spans.join(others.select(*key).distinct(), key, how)


def near_misses(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id and bounds of a prediction and a gold span that overlap: predictions in order, each takes the first gold span that is free; a fold over each document."""
    g = gold.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gold"))
    p = predicted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("pred"))
    pairs = F.array().cast("array<struct<start:int,end:int,gold_start:int,gold_end:int,no:int>>")

    def step(out: Column, x: Column) -> Column:
        free = F.filter(F.transform("gold", lambda y, i: F.struct(y["start"].alias("s"), y["end"].alias("e"), i.alias("no"))), lambda y: (y["s"] < x["end"]) & (y["e"] > x["start"]) & ~F.exists(out, lambda o: o["no"] == y["no"]))
        first = F.get(free, F.lit(0))
        pair = F.struct(x["start"].alias("start"), x["end"].alias("end"), first["s"].alias("gold_start"), first["e"].alias("gold_end"), first["no"].alias("no"))
        return F.when(first.isNull(), out).otherwise(F.concat(out, F.array(pair)))

    folded = p.join(g, "doc_id").select("doc_id", F.explode(F.aggregate("pred", pairs, step)).alias("m"))
    return folded.select("doc_id", "m.start", "m.end", "m.gold_start", "m.gold_end")


def covered(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold (doc_id, start, end, ...) with covered (characters under any prediction), leakage and status."""
    names = gold.columns
    n = workers.joint(gold)  # a task's share stays the same as tables grow
    pred = predicted.select(F.col("doc_id").alias("d"), F.col("start").alias("ps"), F.col("end").alias("pe")).repartition(n, "d").distinct()
    parts = gold.select("doc_id", "start", "end").repartition(n, "doc_id").distinct().join(pred, (F.col("doc_id") == F.col("d")) & (F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")))
    parts = parts.select("doc_id", "start", "end", F.greatest("ps", "start").alias("a"), F.least("pe", "end").alias("b"))
    before = Window.partitionBy("doc_id", "start", "end").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("b").over(before), F.col("start"))
    sums = parts.withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", reach))).groupBy("doc_id", "start", "end").agg(F.sum("new").alias("covered"))
    key = ("doc_id", "start", "end")
    out = gold.repartition(n, *key).join(sums.repartition(n, *key), [*key], "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("int"))
    size = F.col("end") - F.col("start")
    return out.select(*names, "covered", ((size - F.col("covered")) / size).alias("leakage"), F.when(F.col("covered") == 0, "missed").when(F.col("covered") < size, "partial").otherwise("fully").alias("status"))


def exact_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, tp, fp, fn: one gold span to one prediction with the same bounds and label."""
    key = ["doc_id", "start", "end", "label"]
    g, p = gold.groupBy(*key).agg(F.count(F.lit(1)).alias("g")), predicted.groupBy(*key).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, key, "full").fillna(0, ["g", "p"])
    hit = F.least("g", "p")
    return both.groupBy("label").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def overlapping(spans: DataFrame, others: DataFrame, how: str = "left_semi") -> DataFrame:
    """spans that overlap one of the others (or none of them, by left_anti)."""
    o = others.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return spans.join(o, (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")), how)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
