"""A model's names as spans: split at line ends, extended to structural tails, repaired by what else a document holds.

A document's predictions meet its text in one exchange; all repairs look at one document, so nothing else is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra import workers
from umbra.functions import names, scan

_TYPES = {"start": "int", "end": "int", "label": "string", "score": "double", "canonical_value": "string", "repair": "string"}


def _by_document(predictions: DataFrame, docs: DataFrame, least: float, one: Callable[[str, list[tuple]], list[names.Name]]) -> DataFrame:
    workers.ship(docs.sparkSession)
    good = predictions.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & F.col("label").isNotNull() & (F.col("score") >= least))
    # Of equal bounds and labels the most confident comes first.
    order = F.array_sort(F.collect_list(F.struct("start", "end", "label", (-F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("less"))))
    # Dealt alike into parts for all cores, whose number Spark doesn't lessen.
    n = workers.parts(docs.select("doc_id", "text"))
    lists = good.withColumnRenamed("doc_id", "__of").repartition(n, "__of").groupBy("__of").agg(order.alias("given"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartition(n, "doc_id").join(lists, F.col("doc_id") == F.col("__of")).select("doc_id", "text", "given")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            done = [one(text or "", [(start, end, label, -less) for start, end, label, less in given if end <= len(text or "")]) for text, given in zip(batch.column(1).to_pylist(), scan.lists(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scan.column(done, _TYPES)], ["doc_id", "text", "spans"])

    out = rows.mapInArrow(run, f"doc_id {kind}, text string, spans {scan.ddl(_TYPES)}")
    return out.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "s.*", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("surface"))


def split(predictions: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, label, score, canonical_value, repair, surface: predictions by line; soft wraps within a name stay."""
    return _by_document(predictions, docs, least, lambda text, given: [names.Name(a, b, label, score) for s, e, label, score in given for a, b in names.lines(text, s, e, label)])


def extend(predictions: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The same columns: predictions by line, names of companies and places extended to their tails, each once."""
    return _by_document(predictions, docs, least, names.found)


def spans(predictions: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, label, confidence, source, risk_level, canonical_value, repair, surface: all repairs; what names nobody goes.

    predictions: doc_id, start, end, label, score; docs: doc_id (each once), text. Malformed rows, spans outside of their
    text and scores under `least` go; predictions of unknown ids are ignored.
    """
    found = _by_document(predictions, docs, least, lambda text, given: names.repaired(text, names.found(text, given)))
    return found.select("doc_id", "start", "end", "label", F.col("score").alias("confidence"), F.lit("model").alias("source"), F.lit("high").alias("risk_level"), "canonical_value", "repair", "surface")
