"""State over turns: placeholders that stay the same in a session, replies that come in chunks, windows of audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.functions.patterns import PLACEHOLDER
from umbra.operators.placeholders import altered, number
from umbra.streaming import state


def mask_values(values: DataFrame) -> DataFrame:
    """values (namespace, seq, label, surface) with placeholders numbered by first appearance; the batch form."""
    return number(values, scope="namespace", order=("seq",))


def mask_declared(values: DataFrame) -> DataFrame:
    """values (namespace, seq, label, surface) with masked: the placeholder of each declared value, by its exact characters; blank and null values pass as they are."""
    blank = F.col("surface").isNull() | ~F.col("surface").rlike(r"(?U)\S")
    named = mask_values(values.where(~blank)).withColumn("masked", F.col("placeholder")).drop("placeholder")
    return named.unionByName(values.where(blank).withColumn("masked", F.col("surface")))


def mask_stream(values: DataFrame, hours: int | None = 24) -> DataFrame:
    """The same over a stream: a namespace's state has its placeholders and the last seq; rows out of order are marked, and it ends `hours` after its last row."""
    return state.mask_values(values, hours * 3_600_000 if hours else None)


def held_back(chunks: DataFrame) -> DataFrame:
    """chunks (stream_id, chunk_no, text) with out: what may go out with each chunk, when the start of a placeholder at a chunk's end waits for the next one.

    What a chunk leaves depends on it alone, unless it is all made of characters of a placeholder: then what waits goes on.
    So chunks are put in runs of one other chunk and those that only hand on, and a chunk is joined with its run only. Null
    texts are empty; the last chunk gives all that waits.
    """
    order = Window.partitionBy("stream_id").orderBy("chunk_no")
    rows = chunks.select("stream_id", "chunk_no", F.coalesce("text", F.lit("")).alias("text")).withColumns({"goes_on": F.col("text").rlike("^[A-Z0-9_]*$"), "tail": F.regexp_extract("text", "<[A-Z0-9_]*$", 0), "next": F.lead("chunk_no").over(order)})
    rows = rows.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("stream_id", "run").orderBy("chunk_no")
    rows = rows.withColumns({"first": F.first("tail").over(within), "begins": F.row_number().over(within) == 1})
    # In a run whose first chunk leaves a tail, all that follow wait with it.
    rows = rows.withColumns({"waits": (F.col("first") != "") & F.col("next").isNotNull(), "left": F.when(F.col("begins"), F.col("tail")).otherwise(F.col("text"))})
    waiting = F.when(F.col("first") != "", F.array_join(F.collect_list("left").over(within.rowsBetween(Window.unboundedPreceding, -1)), "")).otherwise("")
    rows = rows.withColumn("own_wait", waiting)
    # A chunk that begins a run also gives what waited at the end of the run before it.
    ended = rows.withColumn("end_wait", F.when(F.col("first") != "", F.concat("own_wait", "left")).otherwise(""))
    ended = ended.withColumn("came", F.when(F.col("begins"), F.coalesce(F.lag("end_wait").over(order), F.lit(""))).otherwise(F.col("own_wait")))
    body = F.when(F.col("begins"), F.expr("substring(text, 1, char_length(text) - char_length(tail))")).otherwise(F.lit(""))
    out = F.when(F.col("waits"), F.when(F.col("begins"), F.concat("came", body)).otherwise("")).otherwise(F.concat("came", "text"))
    return ended.select("stream_id", "chunk_no", out.alias("out"))


def _known(mapped: DataFrame) -> DataFrame:
    """__of, known, unnamed: the values of each stream by placeholder, and whether a row has none."""
    pairs = F.collect_set(F.when(F.col("placeholder").isNotNull(), F.struct("placeholder", "original_value")))
    return mapped.groupBy(F.col("stream_id").alias("__of")).agg(F.map_from_entries(pairs).alias("known"), F.max(F.col("placeholder").isNull()).alias("unnamed"))


def _put(known: Column) -> Column:
    """The text that goes out (out, with its placeholders in `all`), filled in."""
    put = F.transform(F.arrays_zip(F.split("out", PLACEHOLDER, -1).alias("g"), F.col("all").alias("p")), lambda x: F.concat(x["g"], F.when(x["p"].isNull(), "").otherwise(F.coalesce(F.try_element_at(known, x["p"]), x["p"]))))
    return F.when(F.size("all") > 0, F.array_join(put, "")).otherwise(F.col("out"))


def _held(chunks: DataFrame) -> DataFrame:
    return held_back(chunks).withColumn("all", F.regexp_extract_all("out", F.lit(PLACEHOLDER), F.lit(0)))


def refill_chunks(chunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """stream_id, chunk_no, text: chunks with their placeholders filled in, as refill_stream does it; unknown ones stay. mapped: stream_id, placeholder (each once), original_value."""
    joined = _held(chunks).join(_known(mapped), F.col("stream_id") == F.col("__of"), "left")
    return joined.select("stream_id", "chunk_no", _put(F.coalesce("known", F.expr("map()").cast("map<string,string>"))).alias("text"))


def rolling(chunks: DataFrame, size: int = 1024) -> DataFrame:
    """chunks with seen: the chunk behind the last `size` characters before it, for scanners that look over chunk ends.

    A chunk hands on only its own last `size` characters, and as many chunks are gathered as are needed for `size` of them:
    the characters before a chunk are a running sum, so a range window over it finds these chunks.
    """
    order = Window.partitionBy("stream_id").orderBy("chunk_no")
    rows = chunks.where(F.char_length("text") > 0).withColumns({"tail": F.expr(f"right(text, {size})"), "behind": F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # Chunks that end within the last `size` characters before this one begins, and the one that reaches into them.
    rows = rows.withColumn("reach", F.col("behind") - F.char_length("text"))
    near = Window.partitionBy("stream_id").orderBy("reach").rangeBetween(-size, -1)
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "tail")).over(near)), lambda x: x["tail"]), "")
    one_before = F.coalesce(F.lag("tail").over(order), F.lit(""))
    edge = F.min("chunk_no").over(near)
    held = rows.withColumns({"own": own, "edge": edge, "last": one_before})
    before_edge = held.select(F.col("stream_id").alias("s"), F.col("chunk_no").alias("c"), F.col("last").alias("reaching"))
    joined = held.join(before_edge, (F.col("stream_id") == F.col("s")) & (F.coalesce("edge", F.col("chunk_no")) == F.col("c")))
    seen = F.concat(F.expr(f"right(concat(reaching, own), {size})"), F.col("text"))
    return joined.withColumn("seen", seen).select(*chunks.columns, "seen")


def hydrate(persisted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping, counters, rows turned away) of persisted rows (namespace, placeholder, label, original_value).

    A malformed placeholder, one given twice, and a second placeholder of one value and prefix are turned away, which stops a session; counters go on
    from the highest number of each prefix.
    """
    prefix, number_ = F.regexp_extract("placeholder", r"^<([A-Z][A-Z0-9_]*)_(\d{3,})>$", 1), F.regexp_extract("placeholder", r"^<([A-Z][A-Z0-9_]*)_(\d{3,})>$", 2)
    rows = persisted.withColumns({"prefix": prefix, "number": F.try_to_number(number_, F.lit("999999999")).cast("long")})
    twice = rows.groupBy("namespace", "placeholder").agg(F.count(F.lit(1)).alias("times"))
    double = rows.groupBy("namespace", "prefix", "original_value").agg(F.count_distinct("placeholder").alias("names"))
    marked = rows.join(twice, ["namespace", "placeholder"]).join(double, ["namespace", "prefix", "original_value"])
    reason = F.when(F.col("prefix") == "", "malformed").when(F.col("times") > 1, "placeholder_twice").when(F.col("names") > 1, "value_twice")
    marked = marked.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull())
    return good.select("namespace", "placeholder", "label", "original_value"), good.groupBy("namespace", "prefix").agg(F.max("number").alias("next_after")), marked.where(F.col("reason").isNotNull()).select("namespace", "placeholder", "reason")


def strict_streams(chunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """stream_id, chunk_no, status, text: a stream is filled in only if the whole of it passes; else no chunk of it is given out.

    A stream is judged by its placeholders alone, which are found over chunk ends (held_back keeps a cut one together), so
    only they are gathered, not the text, and the verdict comes to the chunks with the values, in one join. mapped: stream_id,
    placeholder, original_value.
    """
    held, none = _held(chunks), F.expr("map()").cast("map<string,string>")
    bent = F.size(altered(F.regexp_replace("out", PLACEHOLDER, ""))) > 0
    seen = held.select("stream_id", bent.alias("bent"), F.explode_outer(F.array_distinct("all")).alias("placeholder")).groupBy("stream_id").agg(F.max("bent").alias("bent"), F.collect_set("placeholder").alias("seen"))
    judged = seen.join(_known(mapped), F.col("stream_id") == F.col("__of"), "left").withColumn("known", F.coalesce("known", none))
    names = F.map_keys("known")
    status = F.when(F.col("bent") | (F.size(F.array_except("seen", names)) > 0), "unknown_or_altered").when(F.coalesce("unnamed", F.lit(False)) | (F.size(F.array_except(names, F.col("seen"))) > 0), "missing").otherwise("ok")
    verdicts = judged.select(F.col("stream_id").alias("__stream"), status.alias("status"), "known")
    joined = held.join(verdicts, F.col("stream_id").eqNullSafe(F.col("__stream")))
    return joined.select("stream_id", "chunk_no", "status", F.when(F.col("status") == "ok", _put(F.col("known"))).alias("text"))


def masked_turns(turns: DataFrame, system_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns whose text is to be masked, turns that stay as they are): system turns stay in clear unless a profile says otherwise."""
    own = F.lit(True) if system_too else F.coalesce(F.col("role") != "system", F.lit(True))
    return turns.where(own & F.col("text").isNotNull()), turns.where(~own | F.col("text").isNull())


def collected(turns: DataFrame) -> DataFrame:
    """conv_id, text: all turns of a conversation in order, a line each, for scanners that look at the whole of it."""
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))


def sliding_sessions(uses: DataFrame, hours: int = 24) -> DataFrame:
    """user_id, session_start, expires_at, n: each use moves the end of a session `hours` on; a use after the end begins a new one. For tables and, with a watermark, streams."""
    out = uses.groupBy(F.session_window("ts", f"{hours} hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("expires_at"), "n")


def audit_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, users: tumbling windows by event time with a watermark; for tables and streams."""
    marked = events.withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "users")
