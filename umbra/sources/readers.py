"""Samples, dictionaries, files as blocks, and Markdown out of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = "sample_id string, text string, gold_spans array<struct<start:int,end:int,label:string,text:string,category:string>>, decoys array<struct<start:int,end:int,text:string>>, metadata struct<source:string,scenario:string,doc_type:string>"
ENTRY = "entry_id string, canonical_value string, aliases array<string>, label string, risk_level string, version string, status string, allow_leading_ocr_truncation boolean"


def samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of a JSON-lines file: a gold span must cut its own text out of the sample."""
    good, bad = numbered_samples(spark, path)
    return good.drop("line_no"), bad.drop("line_no", "reason")


def numbered_samples(spark: SparkSession, path: str, schema: str = SAMPLE, spans: tuple[str, ...] = ("gold_spans",)) -> tuple[DataFrame, DataFrame]:
    """Samples with their line number, from 1 in each file; and those turned away, with reason (malformed, no_text, span_mismatch). Blank lines are none.

    Lines are numbered by what each part of a file has before it, so a file isn't read by one task.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    part = F.shiftright("at", 33)
    sizes = lines.groupBy("file", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = lines.withColumn("part", part).join(bases, ["file", "part"]).select((F.col("at") - F.col("first") + F.col("base") + 1).alias("line_no"), "value").where(F.trim("value") != "")
    rows = numbered.withColumn("s", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.withColumn("whole", F.try_parse_json("value").isNotNull()).select("line_no", "whole", "s.*")
    cut = F.lit(True)
    for name in spans:
        cut = cut & F.coalesce(F.forall(F.coalesce(F.col(name), F.array()), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["text"]), F.lit(False))
    reason = F.when(~F.col("whole"), "malformed").when(F.col("text").isNull(), "no_text").when(~cut, "span_mismatch")
    marked = rows.withColumn("reason", reason).drop("whole")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("multiLine", True).json(list(paths))


def merged_dictionary(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(entries of all files with `file_no`, in the order in which the files are named; one row with the version of their contents)."""
    out = None
    for i, path in enumerate(paths):
        one = dictionary(spark, path).withColumn("file_no", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out, content_version(spark, *paths)


def content_version(spark: SparkSession, *paths: str) -> DataFrame:
    """version: a hash over the files' bytes, one file after the other in the order in which they are named. Dictionaries are small files."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.format("binaryFile").load(path).select(F.lit(i).alias("no"), "path", "content")
        out = one if out is None else out.unionByName(one)
    files = out.agg(F.array_sort(F.collect_list(F.struct("no", "path", F.hex("content").alias("hex")))).alias("all"))
    return files.select(F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(F.transform("all", lambda x: x["hex"]), "")), 256)).alias("version"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block, line, text: the lines of a text that aren't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where(F.trim("text") != "")
    return rows.withColumn("block", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).select("doc_id", "block", "line", "text")


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: blocks (doc_id, block, text, heading level or null) in order, blank line between, one line end at the end."""
    line = F.when(F.col("heading").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("block", line.alias("line"))))
    return blocks.groupBy("doc_id").agg(ordered.alias("all")).select("doc_id", F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("markdown"))


def _tables(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, order, block_id, body, ids (block_id of all cells): the cells of each table as a pipe table, at the place of its first cell."""
    text = F.regexp_replace(F.regexp_replace(F.trim("text"), r"\|", r"\\|"), r"\s*\n\s*", "<br>")
    key = ["doc_id", "table_id"]

    def since(all_: str, name: str) -> Callable[[Column, Column], Column]:
        # How far an entry is behind the one before it, by which cells and rows that nothing is given for are put in.
        def gap(x: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(F.col(all_), i - 1)[name]).otherwise(-1)
            return F.when(x[name] == last, F.raise_error(F.concat(F.lit(f"a table has a {name} twice: "), x[name].cast("string")))).otherwise(x[name] - last).cast("int")

        return gap

    at, cell = F.min(F.struct("order", "block_id")).alias("at"), F.when(F.col("col") >= 0, F.struct("col", text.alias("text")))
    rows = cells.groupBy(*key, "row").agg(F.max("col").alias("cols"), at, F.collect_list("block_id").alias("ids"), F.array_sort(F.collect_list(cell)).alias("own"))
    space, far = since("own", "col"), F.coalesce(F.get("own", F.size("own") - 1)["col"], F.lit(0))
    line = F.array_join(F.transform("own", lambda x, i: F.concat(F.repeat(F.lit(" | "), space(x, i) - F.when(i == 0, 1).otherwise(0)), x["text"])), "")
    rows = rows.select(*key, "row", "cols", "at", "ids", far.cast("int").alias("far"), line.alias("line"))
    # Rows without a cell are rows of a table too.
    every = F.array_sort(F.collect_list(F.when(F.col("row") >= 0, F.struct("row", "far", "line"))))
    whole = rows.groupBy(*key).agg(F.max("cols").cast("int").alias("cols"), F.min("at").alias("at"), F.flatten(F.collect_list("ids")).alias("ids"), every.alias("lines"))
    skip, empty = since("lines", "row"), F.concat(F.lit("| "), F.repeat(F.lit(" | "), F.col("cols")), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("cols") + 1))
    full = F.transform("lines", lambda x, i: F.struct(skip(x, i).alias("skip"), F.concat(F.lit("| "), x["line"], F.repeat(F.lit(" | "), F.col("cols") - x["far"]), F.lit(" |")).alias("line")))
    whole = whole.where(F.size("lines") > 0).select(*key, "at", "ids", rule.alias("rule"), empty.alias("empty"), full.alias("lines"))
    blank = F.concat("empty", F.lit("\n"))

    def put(x: Column, i: Column) -> Column:
        first = F.when(x["skip"] == 1, F.concat(x["line"], F.col("rule"))).otherwise(F.concat(F.col("empty"), F.col("rule"), F.lit("\n"), F.repeat(blank, x["skip"] - 2), x["line"]))
        return F.when(i == 0, first).otherwise(F.concat(F.repeat(blank, x["skip"] - 1), x["line"]))

    return whole.select(*key, F.col("at.order"), F.col("at.block_id"), F.array_join(F.transform("lines", put), "\n").alias("body"), "ids")


def block_tree(blocks: DataFrame, ancillary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, markdown; doc_id, block_id, first_line, last_line of each block) of blocks, as rendered() puts them together."""
    whole = rendered(blocks, ancillary)
    return whole.select("doc_id", "markdown"), whole.select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*")


def rendered(blocks: DataFrame, ancillary: bool = False) -> DataFrame:
    """doc_id, markdown, places (array of block_id, first_line, last_line) of blocks as extraction gives them, in one pass.

    blocks: doc_id, block_id, order, text, kind (paragraph, heading, cell, ancillary), level, table_id, row, col. Blank
    blocks go, but for cells; order and then id say what comes first. The cells of a table (also of a sheet) are one pipe table
    where its first cell stands. ancillary blocks (headers, footers, notes) come only when asked. Lines count from 1; all
    cells of a table have its lines.
    """
    shown = blocks.where((F.coalesce("kind", F.lit("paragraph")) != "ancillary") | F.lit(ancillary))
    cells = shown.where("kind = 'cell' AND table_id IS NOT NULL").select("doc_id", "block_id", "order", F.coalesce("text", F.lit("")).alias("text"), "table_id", "row", "col")
    plain = shown.where("(kind IS NULL OR kind <> 'cell' OR table_id IS NULL)").where(F.trim(F.coalesce("text", F.lit(""))).rlike(r"\S"))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    body = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(F.trim("text"), r"\s*\n\s*", " "))).otherwise(F.col("text"))
    every = plain.select("doc_id", "order", "block_id", F.lit(None).cast("string").alias("table_id"), body.alias("body"), F.array("block_id").alias("ids")).unionByName(_tables(cells).select("doc_id", "order", "block_id", F.col("table_id").cast("string").alias("table_id"), "body", "ids"))
    size = F.char_length("body") - F.char_length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))) + 1
    before = Window.partitionBy("doc_id").orderBy("order", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("lines", size).withColumn("first_line", (F.coalesce(F.sum(F.col("lines") + 1).over(before), F.lit(0)) + 1).cast("int"))
    placed = placed.withColumn("last_line", (F.col("first_line") + F.col("lines") - 1).cast("int"))
    own = F.transform("ids", lambda x: F.struct(x.alias("block_id"), F.col("first_line"), F.col("last_line")))
    ordered = F.array_sort(F.collect_list(F.struct("first_line", "body")))
    every = placed.select("doc_id", "first_line", "body", own.alias("own")).groupBy("doc_id").agg(ordered.alias("all"), F.flatten(F.collect_list("own")).alias("places"))
    return every.select("doc_id", F.concat(F.array_join(F.transform("all", lambda x: x["body"]), "\n\n"), F.lit("\n")).alias("markdown"), "places")


def paragraphs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of paragraphs joined by a blank line, and where each starts (doc_id, block, start, end)."""
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + 2).over(before), F.lit(0)).cast("int")
    places = blocks.withColumn("start", start).select("doc_id", "block", "start", (F.col("start") + F.char_length("text")).alias("end"))
    joined = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("all")).select("doc_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"))
    return joined, places


def remap(spans: DataFrame, places: DataFrame) -> DataFrame:
    """spans with block and local bounds; null where a span crosses paragraphs (which stops an export)."""
    p = places.select(F.col("doc_id").alias("d"), "block", F.col("start").alias("ps"), F.col("end").alias("pe"))
    inside = (F.col("doc_id") == F.col("d")) & (F.col("ps") <= F.col("start")) & (F.col("pe") >= F.col("end"))
    return spans.join(p, inside, "left").withColumns({"local_start": F.col("start") - F.col("ps"), "local_end": F.col("end") - F.col("ps")}).drop("d", "ps", "pe")
