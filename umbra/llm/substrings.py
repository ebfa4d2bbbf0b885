"""Removal of repeated substrings by prefix-free parsing.

Triggers: in each string of LENGTH bytes the window with the least rolling hash is its trigger, which depends on the
string's bytes alone. Neighbouring strings with the same trigger make a phrase; phrases overlap by a string, so each
string lies within one phrase, and equal strings have the same place in phrases with the same trigger. The parse (which
phrase stands where) and the dictionary (different phrases, how often) follow from grouping. A phrase of the dictionary
that occurs twice is repeated as a whole. What is left are different phrases with a trigger in common: their suffixes of
LENGTH bytes are put in order, and neighbours that agree over the whole length are repeated strings. The parse takes
both back to the documents, where the runs of covered bytes are cut out.

Only triggers that occur twice come into the dictionary, and only phrases that share a trigger with another one into the
suffix order; phrases are counted in their task before the shuffle. Triggers with over HOT_PHRASES different phrases
aren't gathered: their strings are counted one by one, with sums made before the shuffle.

Phrases are told apart by two 64-bit hashes (of trigger and phrase).

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing; repeated rows are repeats of each
other, also with the same doc_id; strings never cross rows; rows with a null or the same doc_id are documents like any
other, as spans belong to a row number (common.numbered), not to a doc_id; a text of over 268 million bytes
(phrases.MOST) stops the job with a ValueError that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import common
from umbra.llm.phrases import Rolling, mix, phrases

LENGTH = 200
WINDOW = 48
HOT_PHRASES = 20_000
#: Bytes of phrases whose suffixes are put in order at a time (one trigger's phrases may be more).
ORDER_BYTES = 4 << 20


def _texts(rows: DataFrame) -> DataFrame:
    """__row, text of numbered rows."""
    return rows.select(common.ROW, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, at >> 24 & 255


def parse(rows: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """trigger, phrase (hashes; null: a phrase counted with another row of its step), row, place, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text", 1 << 20):
            data, bounds = common.bytes_view(batch.column(1))
            if len(data) < length:
                continue
            rolling = Rolling(data)
            lo, hi, at = phrases(rolling, bounds, length, window)
            trigger, phrase = rolling.of(at, at + window), mix(rolling.of(lo, hi + length) + (at - lo).astype(np.uint64))
            row = np.searchsorted(bounds, lo, side="right") - 1
            place = (lo - bounds[row]) << 32 | (hi - lo) << 24 | (at - lo) << 16
            _, first, of = np.unique(phrase, return_index=True, return_inverse=True)
            n = np.minimum(np.bincount(of), 2)[of]
            counted = np.ones(len(lo), bool)
            counted[first] = False
            yield common.record(["trigger", "phrase", "row", "place", "n"], [pa.array(trigger.view(np.int64), mask=counted), pa.array(phrase.view(np.int64), mask=counted), pa.array(batch.column(0).to_numpy()[row]), pa.array(place), pa.array(n)])

    return _texts(rows).mapInArrow(common.lean(run), "trigger long, phrase long, row long, place long, n long")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the `length` bytes there, and whether each differs from the one before it.

    Eight bytes at a time; groups of equal strings are final as soon as their hashes agree.
    """
    rolling = Rolling(data)
    whole = rolling.of(starts, starts + length)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | wide[k : k + len(data)]
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))  # places in the order that aren't final
    for depth in range(0, length, 8):
        if not len(live):
            break
        word = eight[starts[order[live]] + depth]
        if depth + 8 > length:
            word = word >> np.uint64(8 * (depth + 8 - length))
        by = np.lexsort((whole[order[live]], word, group[live]))
        order[live], word = order[live][by], word[by]
        g, w = group[live], whole[order[live]]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        group[live] = live[first][np.cumsum(new) - 1]
        size = np.diff(np.append(first, len(live)))
        same = w[np.append(first[1:], len(live)) - 1] == w[first]  # hashes are in order within a group
        live = live[np.repeat((size > 1) & ~same, size)]
    return order, np.concatenate([[True], group[1:] != group[:-1]]) if len(starts) else np.zeros(0, bool)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _extents(spread: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """trigger, hot, n, row, place, bytes of the phrases in `spread`."""
    kind = "array<struct<place:long,trigger:long,n:long,hot:boolean>>"
    lists = spread.groupBy("row").agg(F.collect_list(F.struct("place", "trigger", "n", "hot")).alias("own"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            data, bounds = common.bytes_view(batch.column(1))
            own = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            place, trigger, n, hot = (flat.field(i) for i in range(4))
            lo, reach = _unpacked(place.to_numpy())
            start, size = bounds[row] + lo, reach + length
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            cut = data[_ranges(start, size)]
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(cut)]).cast(pa.binary())
            yield common.record(["trigger", "hot", "n", "row", "place", "bytes"], [trigger, hot, n, batch.column(0).take(pa.array(row)), place, column])

    joined = _texts(rows).join(lists, F.col(common.ROW) == F.col("row")).select("row", "text", F.col("own").cast(kind))
    return joined.mapInArrow(common.lean(run), "trigger long, hot boolean, n long, row long, place long, bytes binary")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in the order of their trigger, in tables of whole triggers with about `most` bytes."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= most:
            table = pa.Table.from_batches(kept)
            trigger = table.column(0).to_numpy()
            last = int(np.searchsorted(trigger, trigger[-1]))
            if last:
                yield table.slice(0, last)
                table = table.slice(last)
            kept, size = table.combine_chunks().to_batches(), table.nbytes if not last else 0
    if kept:
        yield pa.Table.from_batches(kept)


def _common_strings(extents: DataFrame, length: int) -> DataFrame:
    """row, lo, hi: runs of starts of strings that also stand in another phrase; of phrases that occur once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, ORDER_BYTES):
            table = table.combine_chunks()
            data, bounds = common.bytes_view(table.column("bytes"))
            lo, reach = _unpacked(table.column("place").to_numpy())
            owner = np.repeat(np.arange(len(lo)), reach + 1)
            starts = _ranges(bounds[:-1], reach + 1)
            order, new = suffix_order(data, starts, length)
            shared = np.zeros(len(starts), bool)
            shared[order] = ~new | np.concatenate([~new[1:], [False]])
            shared &= (table.column("n").to_numpy() < 2)[owner]
            begin = shared & np.concatenate([[True], ~shared[:-1] | (owner[1:] != owner[:-1])])
            end = shared & np.concatenate([~shared[1:] | (owner[1:] != owner[:-1]), [True]])
            a, b = np.flatnonzero(begin), np.flatnonzero(end)
            o = owner[a]
            offset = lo[o] - bounds[o]
            yield common.record(["row", "lo", "hi"], [pa.array(table.column("row").to_numpy()[o]), pa.array(starts[a] + offset), pa.array(starts[b] + offset)])

    rows = extents.where(~F.col("hot")).select("trigger", "n", "row", "place", "bytes")
    size = rows.agg(F.sum(F.octet_length("bytes")).alias("b")).first().b or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * ORDER_BYTES)))
    return rows.repartition(parts, "trigger").sortWithinPartitions("trigger").mapInArrow(common.lean(run), "row long, lo long, hi long")


def _hot_strings(extents: DataFrame, length: int) -> DataFrame:
    """The same for triggers with very many phrases: strings are counted by their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "bytes", 1 << 20):
            data, bounds = common.bytes_view(batch.column(4))
            lo, reach = _unpacked(batch.column(3).to_numpy())
            owner = np.repeat(np.arange(len(lo)), reach + 1)
            starts = _ranges(bounds[:-1], reach + 1)
            whole = Rolling(data).of(starts, starts + length)
            yield common.record(["trigger", "whole", "row", "start", "n"], [pa.array(batch.column(0).to_numpy()[owner]), pa.array(whole.view(np.int64)), pa.array(batch.column(2).to_numpy()[owner]), pa.array(starts - bounds[owner] + lo[owner]), pa.array(batch.column(1).to_numpy()[owner])])

    rows = extents.where("hot").select("trigger", "n", "row", "place", "bytes")
    strings = rows.mapInArrow(common.lean(run), "trigger long, whole long, row long, start long, n long")
    twice = strings.groupBy("trigger", "whole").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("trigger", "whole")
    return strings.where(F.col("n") < 2).join(twice, ["trigger", "whole"], "left_semi").select("row", F.col("start").alias("lo"), F.col("start").alias("hi"))


def spans(rows: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT_PHRASES) -> DataFrame:
    """row, lo, hi: first and last starts of repeated strings in numbered rows, in runs that may overlap."""
    spark = rows.sparkSession
    common.ship(spark)
    parsed = common.stored(parse(rows, length, window), "parse")
    counted = parsed.where(F.col("trigger").isNotNull())
    often = counted.groupBy("trigger").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("trigger")
    shared = common.stored(counted.join(often, "trigger").select("trigger", "phrase", "row", "place", "n"), "shared")
    alone = common.stored(parsed.where(F.col("trigger").isNull()).select("row", "place"), "counted")
    common.tidy(spark, parsed)
    one = Window.partitionBy("trigger", "phrase")
    ranked = shared.withColumns({"all": F.sum("n").over(one), "nth": F.row_number().over(one.orderBy("row", "place"))})
    dictionary = common.stored(ranked, "dictionary")
    common.tidy(spark, shared)
    entries = dictionary.where(F.col("nth") == 1).select("trigger", "row", "place", F.col("all").alias("n"))
    several = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).where(F.col("phrases") > 1)
    spread = entries.join(several, "trigger").select("trigger", "row", "place", "n", (F.col("phrases") > hot).alias("hot"))
    extents = common.stored(_extents(spread, rows, length), "extents")
    common.tidy(spark)
    lo = F.shiftright("place", 32)
    whole = [t.select("row", lo.alias("lo"), (lo + F.shiftright("place", 24).bitwiseAND(F.lit(255))).alias("hi")) for t in (dictionary.where(F.col("all") > 1), alone)]
    found = common.stored(whole[0].unionByName(whole[1]).unionByName(_common_strings(extents, length)).unionByName(_hot_strings(extents, length)), "spans")
    common.tidy(spark, dictionary, alone, extents)
    return found


def _cut(batch: pa.RecordBatch, length: int) -> Iterator[tuple[memoryview, np.ndarray, np.ndarray]]:
    """For each row (row, text, own): its bytes, and where its maximal removed runs start and end."""
    data, bounds = common.bytes_view(batch.column(1))
    own = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
    at, flat = own.offsets.to_numpy(), own.flatten()
    at = at - at[0]  # a slice's offsets count from the whole column, its values from the slice
    lo, hi = (flat.field(i).to_numpy() for i in range(2))
    raw = memoryview(data)
    for i in range(batch.num_rows):
        text = raw[bounds[i] : bounds[i + 1]]
        mine = slice(at[i], at[i + 1])
        a, b = lo[mine], hi[mine] + length
        if len(a):
            by = np.argsort(a, kind="stable")
            a, b = a[by], np.maximum.accumulate(b[by])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            a, b = a[new], b[np.append(new[1:], len(b)) - 1]
        yield text, a, b


def _lists(rows: DataFrame, length: int) -> DataFrame:
    """row, own: the spans of each row that has any."""
    return spans(rows, length).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            out: list[tuple[int, int, int, str]] = []
            for text, a, b in _cut(batch, length):
                kept, end = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(text[end:x])
                    end = y
                kept.update(text[end:])
                out.append((len(text), int((b - a).sum()), len(a), kept.hexdigest()))
            yield common.record(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [batch.column(3), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))])

    rows = common.numbered(common.id_text(docs))
    whole = rows.join(_lists(rows, length), F.col(common.ROW) == F.col("row"), "left").select("row", F.coalesce("text", F.lit("")).alias("text"), "own", "doc_id")
    return whole.mapInArrow(common.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (all columns) with repeated substrings cut out of the text; bytes of a character that was cut in part go with it.

    n_chars, where docs has it, follows the text. Rows and other columns stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            texts = []
            for text, a, b in _cut(batch, length):
                ends = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)] if len(a) else [0, len(text)]
                texts.append("".join([bytes(text[x:y]).decode("utf-8", "ignore") for x, y in zip(ends[::2], ends[1::2], strict=True)]))
            yield common.record(["__umbra_of", "__umbra_text"], [batch.column(0), pa.array(texts, pa.string())])

    rows = common.numbered(docs)
    cut = _texts(rows).join(_lists(rows, length), F.col(common.ROW) == F.col("row")).select("row", "text", "own").mapInArrow(common.lean(run), "__umbra_of long, __umbra_text string")
    out = rows.join(cut, F.col(common.ROW) == F.col("__umbra_of"), "left")
    text = F.coalesce("__umbra_text", "text")
    columns = [text.alias("text") if c == "text" else F.when(F.col("__umbra_of").isNotNull(), F.char_length("__umbra_text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*columns)


def op5_prefix_free_parsing(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
