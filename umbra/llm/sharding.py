"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

The ring has 65,536 cells. A shard owns `virtual_nodes` cells; a key's cell is the top 16 bits of its hash, and its
home is the shard of the next virtual node clockwise. Shards have bounded loads: rows div shards, and one more for the
first rows mod shards. Arcs are filled in ring order; keys that find their shard full continue clockwise to the next
shard with room. So counts differ by at most one, whatever the keys, and only keys of full shards leave their home.

The cascade needs only counts by arc, a table whose size the ring fixes. Ranks within an arc come from hash buckets of
bounded size, so no window holds an arc. Equal rows are counted before the shuffle and spread out again after it.

Defined results: null text has size 1 and the checksum of no bytes; a null key hashes like any other; equal rows get
different slots; no rows give no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import common

CELLS = 1 << 16
#: Rows that one ranking window holds, on average.
BUCKET_ROWS = 20_000
#: Copies of a row that one row of the last step gives.
SPREAD = 50_000


def ring(spark, shards: int, virtual_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(cell, arc) for each of the 65,536 cells, and (arc, prefer): the shards in clockwise order from the arc's own."""
    nodes = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.shiftrightunsigned(F.xxhash64(F.lit("ring"), F.col("id")), 48).cast("int").alias("at"))
        .groupBy("at").agg(F.min("shard").alias("shard"))
    )
    ordered = nodes.agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("nodes"))  # as many as the ring has
    arcs = ordered.select(F.posexplode("nodes").alias("arc", "node"), "nodes").select(
        "arc",
        F.col("node.at").alias("at"),
        F.when(F.col("arc") == 0, F.lit(-1)).otherwise(F.expr("nodes[arc - 1].at")).alias("before"),
        F.size("nodes").alias("n"),
        F.element_at("nodes", -1)["at"].alias("last"),
        F.expr("array_distinct(transform(concat(slice(nodes, arc + 1, size(nodes)), slice(nodes, 1, arc)), x -> x.shard))").alias("prefer"),
    )
    wrapped = F.when((F.col("arc") == 0) & (F.col("last") < CELLS - 1), F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).otherwise(F.array().cast("array<int>"))
    cells = arcs.select("arc", F.explode(F.concat(F.sequence(F.col("before") + 1, F.col("at")), wrapped)).alias("cell"))
    return cells, arcs.select("arc", "prefer")


def _cascade(shards: int) -> Column:
    """array<struct<arc, shard, lo, n>>: of the keys of each arc, in rank order, those from lo on that a shard takes."""
    zero = F.lit(0).cast("long")
    free = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    start = F.struct(free.cast("array<bigint>").alias("free"), F.array().cast("array<struct<arc:int,shard:int,lo:bigint,n:bigint>>").alias("out"))

    def one_arc(acc, arc):
        def one_shard(a, s):
            take = F.least(a["left"], F.element_at(a["free"], s + 1))
            flow = F.struct(arc["arc"].alias("arc"), s.alias("shard"), a["lo"].alias("lo"), take.alias("n"))
            return F.struct(
                (a["left"] - take).alias("left"),
                (a["lo"] + take).alias("lo"),
                F.transform(a["free"], lambda v, i: F.when(i == s, v - take).otherwise(v)).alias("free"),
                F.when(take > 0, F.concat(a["out"], F.array(flow))).otherwise(a["out"]).alias("out"),
            )

        begun = F.struct(arc["n"].alias("left"), zero.alias("lo"), acc["free"].alias("free"), acc["out"].alias("out"))
        return F.aggregate(arc["prefer"], begun, one_shard, lambda a: F.struct(a["free"].alias("free"), a["out"].alias("out")))

    return F.aggregate(F.col("arcs"), start, one_arc, lambda a: a["out"])


def assign(rows: DataFrame, key: str, shards: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """rows (narrow: all columns are grouped and shuffled) with shard int and slot long, gapless from 0 in each shard."""
    spark, columns = rows.sparkSession, rows.columns
    cells, arcs = ring(spark, shards, virtual_nodes)
    names = [f"__umbra_{i}" for i in range(len(columns))]
    hashed = F.xxhash64(F.lit("key"), F.col(names[columns.index(key)]))
    counted = rows.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("__m"))
    placed = common.stored(counted.withColumn("__cell", F.shiftrightunsigned(hashed, 48).cast("int")).join(F.broadcast(cells), F.col("__cell") == F.col("cell")).drop("cell", "__cell"), "ring")
    total = placed.agg(F.sum("__m").alias("m"), F.count(F.lit(1)).alias("r")).first()
    buckets = max(1, (total.r or 0) // (BUCKET_ROWS * shards * virtual_nodes) + 1)
    placed = placed.withColumn("__sub", F.pmod(F.xxhash64(F.lit("sub"), *names), F.lit(buckets)).cast("int"))

    sizes = placed.groupBy("arc", "__sub").agg(F.sum("__m").alias("n"))
    before = Window.partitionBy("arc").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    by_arc = arcs.join(sizes.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").fillna(0, ["n"])
    gathered = by_arc.agg(F.array_sort(F.collect_list(F.struct("arc", "n", "prefer"))).alias("arcs"), F.sum("n").alias("total"))  # as many as the ring has
    flows = gathered.select(F.explode(_cascade(shards)).alias("f")).select("f.*")
    earlier = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    flows = flows.select("arc", "shard", "lo", (F.col("lo") + F.col("n")).alias("hi"), F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("slot0"))

    ahead = Window.partitionBy("arc", "__sub").orderBy(F.xxhash64(F.lit("rank"), *names), *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__rank", F.coalesce(F.sum("__m").over(ahead), F.lit(0).cast("long"))).join(bases, ["arc", "__sub"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("base"))
    met = ranked.join(F.broadcast(flows.withColumnRenamed("arc", "__arc")), (F.col("arc") == F.col("__arc")) & (F.col("__rank") < F.col("hi")) & (F.col("__rank") + F.col("__m") > F.col("lo")))
    first, last = F.greatest("__rank", "lo") - F.col("lo") + F.col("slot0"), F.least(F.col("__rank") + F.col("__m"), "hi") - F.col("lo") + F.col("slot0") - 1
    part = met.select(*names, "shard", last.alias("__last"), F.explode(F.sequence(first, last, F.lit(SPREAD))).alias("__first"))
    slot = F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + SPREAD - 1, F.col("__last")))).alias("slot")
    return part.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "shard", slot)


def op6_consistent_ring(spark, sf_dir: str) -> DataFrame:
    docs = common.id_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = assign(rows, "doc_id", 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
