"""Roles of parties from cues in front of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import patterns


def tag(docs: DataFrame, spans: DataFrame, role_set: str = "contract") -> DataFrame:
    """spans with role. The cue that ends nearest in front of a mention counts, the last such mention speaks for all of its value."""
    cues = patterns.ROLES[role_set]
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    party = F.col("label").isin(*patterns.ROLE_LABELS)
    near = spans.where(party).join(texts, F.col("doc_id") == F.col("of"))
    begin = F.greatest(F.col("start") - patterns.ROLE_WINDOW, F.lit(0))
    near = near.withColumn("window", F.substring(F.col("text"), begin + 1, F.col("start") - begin))
    # Characters after the last match of each role's cues; the fewest win, then the earlier role.
    after = [F.struct(F.char_length(F.regexp_extract("window", f"(?s)^.*(?:{cue})(.*)$", 1)).alias("far"), F.lit(i).alias("i"), F.lit(role).alias("role"), F.col("window").rlike(cue).alias("there")) for i, (role, cue) in enumerate(cues.items())]
    best = F.array_sort(F.filter(F.array(*after), lambda x: x["there"]))
    said = near.withColumn("said", F.try_element_at(best, F.lit(1))["role"]).where(F.col("said").isNotNull())
    by_value = said.groupBy(F.col("doc_id").alias("d"), F.col("surface").alias("v")).agg(F.max_by("said", F.struct("start", "end")).alias("role"))
    return spans.drop("role").join(by_value, reduce(lambda a, b: a & b, [F.col("doc_id") == F.col("d"), F.col("surface") == F.col("v"), party]), "left").drop("d", "v")
