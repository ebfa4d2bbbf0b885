"""What a job takes in: sizes, ids, locators. Rows beyond a limit are told apart, never cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import patterns

# The default limits.
TEXT_CHARS, BATCH_ITEMS, REQUEST_BYTES, COVERAGE_ITEMS = 200_000, 64, 4_000_000, 1_000
SOURCE_ID = r"^[A-Za-z0-9_.:][A-Za-z0-9_.:-]{0,63}$"


def refused(text: Column, chars: int = TEXT_CHARS, size: int = REQUEST_BYTES) -> Column:
    """Why a text is turned away: text_too_long, request_too_large, reserved_placeholder; null if it isn't."""
    return F.when(F.char_length(text) > chars, "text_too_long").when(F.octet_length(text) > size, "request_too_large").when(text.rlike(patterns.PLACEHOLDER), "reserved_placeholder")


def admitted(docs: DataFrame, chars: int = TEXT_CHARS, size: int = REQUEST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(docs to work on, docs turned away with reason)."""
    marked = docs.withColumn("reason", refused(F.col("text"), chars, size))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def batches(items: DataFrame, most: int = BATCH_ITEMS, chars: int = TEXT_CHARS) -> DataFrame:
    """batch_id, n, status of each batch (batch_id, item_id, text): the whole batch is judged before any item is worked on."""
    one = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("ids"), F.count("item_id").alias("named"), F.max(F.char_length("text")).alias("longest"))
    status = F.when(F.col("n") > most, "too_many_items").when((F.col("ids") < F.col("n")) | (F.col("named") < F.col("n")), "ids_not_unique").when(F.col("longest") > chars, "text_too_long").otherwise("ok")
    return one.select("batch_id", "n", status.alias("status"))


def valid_source(source: Column) -> Column:
    """Not blank, no white space, no hyphen in front, at most 64 characters."""
    return F.coalesce(source.rlike(SOURCE_ID), F.lit(False))


def resolve(locators: DataFrame, blocks: DataFrame) -> DataFrame:
    """locators (locator: source#place) with block ids and status ok, malformed or unknown. blocks: source, place, block_id."""
    split = locators.withColumns({"source": F.regexp_extract("locator", r"^([^#]+)#(.+)$", 1), "place": F.regexp_extract("locator", r"^([^#]+)#(.+)$", 2)})
    found = blocks.groupBy("source", "place").agg(F.array_sort(F.collect_list("block_id")).alias("block_ids"))
    status = F.when(F.col("place") == "", "malformed").when(F.col("block_ids").isNull(), "unknown").otherwise("ok")
    return split.join(found, ["source", "place"], "left").select(*locators.columns, "block_ids", status.alias("status"))


def coverage_refused(items: DataFrame, most: int = COVERAGE_ITEMS, chars: int = TEXT_CHARS) -> DataFrame:
    """job_id, status of inspections: too many items to cover, or too many characters in all."""
    one = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("total"))
    return one.select("job_id", F.when(F.col("n") > most, "too_many_items").when(F.col("total") > chars, "text_too_long").otherwise("ok").alias("status"))
