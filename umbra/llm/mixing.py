"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums, a cut at the budget.

Targets come from a table of sources: each source's share by weight stops at `cap` times its size, and what is over goes
to the others by weight. That is min(cap * size, level * weight) for one level, found by running sums over the sources
in the order in which they reach their cap.

A source whose target is e whole epochs and a rest gives every document e times, and those documents once more whose
words come first in the order of their keys, until the rest is used up; the last one gives only its first words. Rows
are dealt by ranges of (source, key), so that a source with most of the rows is spread over many tasks; a task needs
only its own rows and the sums of the ranges before it.

Defined results: null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own,
the last one; rows of one source with equal ids and texts are told apart by their place in the input, so that their
results are the same in any order; a source without words has the target 0; an empty table gives no rows; columns
besides the three named ones don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import common

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The table of sources (source, source_size; a row for each source) with the target of each, a double."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = sources.withColumn("__w", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("__w"), F.col("source").asc_nulls_last())
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = weighed.withColumns({
        "__taken": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
        "__rest": F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)),
        "__all": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    # The level if all sources before this one in order have stopped at their cap; the first that it doesn't fill sets it.
    level = (F.col("__all") - F.col("__taken")) / F.col("__rest")
    at = sums.withColumns({"__level": F.when(level * F.col("__w") <= F.col("source_size") * cap, level), "__rank": F.row_number().over(by_cap)})
    found = at.withColumn("__level", F.min(F.when(F.col("__level").isNotNull(), F.struct("__rank", "__level"))).over(every)["__level"])
    full = (F.col("source_size") * cap).cast("double")
    return found.select("source", "source_size", F.least(full, F.coalesce(F.col("__level") * F.col("__w"), full)).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = "", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of each row of docs; the same for the same rows and seed."""
    text = F.col(text_column).cast("string")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("__key"))
    # Null last, and a key for joins that null has too.
    rows = rows.withColumns({"__of": F.concat(F.when(F.col("source").isNull(), "b").otherwise("a"), F.coalesce("source", F.lit(""))), "__no": F.monotonically_increasing_id()})
    order = ("__key", "doc_id", "size", "__no")
    dealt = common.stored(rows.repartitionByRange("__of", *order).withColumn("__range", F.spark_partition_id()), "mix")

    parts = dealt.groupBy("__of", "source", "__range").agg(F.sum("size").alias("n"))  # a row for each source and range
    sources = parts.groupBy("__of", "source").agg(F.sum("n").alias("source_size"))
    wanted = sources.select("__of", F.col("source").alias("__source")).join(targets(sources.select("source", "source_size"), weights, share, cap), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    ahead = Window.partitionBy("__of").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("__of", "__range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base")).join(wanted, "__of")

    within = Window.partitionBy("__of", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["__of", "__range"])
    return placed.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("__base") + F.col("__ahead")).alias("taken"))


def _taken(before: Column) -> Column:
    """Words that a row gives if `before` words of its source come first."""
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size")
    return epochs * F.col("size") + F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))


def materialized(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that a mix of docs (ids each once) takes: docs, once for each epoch (column epoch, from 0); the last text cut after its last taken word."""
    taken = mixed.where("taken > 0").select(F.col("doc_id").alias("__of"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    each = docs.join(taken, F.col(id_column) == F.col("__of")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("CAST((__taken - 1) div __size AS INT)"))))
    left = F.least(F.col("__taken") - F.col("epoch") * F.col("__size"), F.col("__size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_column, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), left.cast("int")), "")
    return each.withColumn(text_column, F.when(left < F.col("__size"), cut).otherwise(F.col(text_column))).drop("__of", "__size", "__taken")


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat(':', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source), w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, 2 * coalesce(sum(n) OVER (ORDER BY n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER (ORDER BY n / w::DOUBLE, source NULLS LAST) AS no, sum(n) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT arg_min(level, no) AS level FROM (SELECT *, (budget - gone::DOUBLE) / rest::DOUBLE AS level FROM o) x WHERE level * w <= 2 * n),
t AS (SELECT source, n, least((2 * n)::DOUBLE, coalesce(level * w, (2 * n)::DOUBLE)) AS target FROM o, l),
p AS (SELECT doc_id, size, n AS source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - ahead, 0), size) END AS taken FROM p"""
