"""Many literal needles in many texts, dealt by key.

A needle's first characters are its key. Each text gives its different stretches of that length with their places; a
join with the needles' keys, each with the lengths of needles that it begins, leaves places at which a needle may stand.
What stands there in these lengths is cut out and joined with the needles. So no needle passes the driver, a text meets
only needles that it may hold, and Spark broadcasts a side only if its measured size allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra import workers

#: Characters of a key; a shorter needle is its own key.
KEY_CHARS = 6
#: Rows that a task gives on at a time.
BATCH_ROWS = 20_000
#: Blanks and line ends that may break a needle after each of its characters, where breaks are allowed.
BLANKS, MOST_BLANKS = " \t\r\n", 2


def _places(whole: str, loose: bool) -> tuple[str, list[int] | range]:
    """The text that is searched, and the place of each of its characters."""
    if not loose:
        return whole, range(len(whole))
    at = [i for i, c in enumerate(whole) if c not in BLANKS]
    return "".join(whole[i] for i in at), at


def _passed(rows: DataFrame, columns: list[str], found: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """doc_id, scope and what `found` gives of the columns of each row."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "scope")]
    names = ["doc_id", "scope", *(c.split()[0] for c in schema.split(", "))]
    arrow = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    types = [arrow[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, own = [], [batch.column(i).type for i in (0, 1)]

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), [*own, *types], strict=True)], names)  # noqa: B023

            for doc, scope, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += [(doc, scope, *x) for x in found(*rest)]
                if len(held) > BATCH_ROWS:
                    yield made()
                    held = []
            if held:
                yield made()

    return rows.select("doc_id", "scope", *columns).mapInArrow(run, f"doc_id {kinds[0]}, scope {kinds[1]}, {schema}")


def _keys(docs: DataFrame, sizes: list[int], loose: bool) -> DataFrame:
    """doc_id, scope, key, at: the different stretches of each text in these lengths, with their places."""
    def found(whole: str) -> Iterator[tuple]:
        view, all_ = _places(whole, loose)[0], {}
        for size in sizes:
            for i in range(len(view) - size + 1):
                all_.setdefault(view[i : i + size], []).append(i)
        return all_.items()

    return _passed(workers.spread(docs.select("doc_id", "scope", "view").where("view IS NOT NULL")), ["view"], found, "key string, at array<int>")


def _cut(hits: DataFrame, loose: bool) -> DataFrame:
    """doc_id, scope, piece, start, end: what stands at the places hit, in the lengths wanted there."""
    def found(whole: str, met: list[dict]) -> Iterator[tuple]:
        view, at = _places(whole, loose)
        wide = [0]  # breaks that are too long, before each character
        for a, b in zip(at, at[1:]):  # noqa: B905, RUF007
            wide.append(wide[-1] + (b - a - 1 > MOST_BLANKS))
        for m in met:
            for i in m["at"]:
                for n in m["sizes"]:
                    if i + n <= len(view) and wide[i] == wide[i + n - 1]:
                        yield view[i : i + n], at[i], at[i + n - 1] + 1

    return _passed(hits, ["view", "met"], found, "piece string, start int, end int")


def occurrences(docs: DataFrame, needles: DataFrame, loose: bool = False) -> DataFrame:
    """doc_id, scope, needle, start, end of every needle (scope, needle; each once) in the texts (doc_id, scope, view) of its scope.

    A needle doesn't overlap itself: of overlapping occurrences the first stays. Where loose, up to MOST_BLANKS blanks or
    line ends may stand after each character of a needle without blanks. doc_id has each text once; empty needles are
    found nowhere, null texts and scopes hold none.
    """
    workers.ship(docs.sparkSession)
    named = needles.where(F.char_length("needle") > 0).select(F.col("scope").alias("__scope"), "needle", F.substring("needle", 1, KEY_CHARS).alias("__key"))
    sizes = sorted(r[0] for r in named.select(F.char_length("__key")).distinct().collect())  # at most KEY_CHARS numbers
    begun = named.groupBy("__scope", "__key").agg(F.collect_set(F.char_length("needle")).alias("sizes"))
    met = _keys(docs, sizes, loose).join(begun, (F.col("scope") == F.col("__scope")) & (F.col("key") == F.col("__key"))).groupBy("doc_id", "scope").agg(F.collect_list(F.struct("at", "sizes")).alias("met"))
    hits = docs.select(F.col("doc_id").alias("__of"), "view").join(met, F.col("doc_id") == F.col("__of"))
    found = _cut(hits, loose).join(named.drop("__key"), (F.col("piece") == F.col("needle")) & (F.col("scope") == F.col("__scope")))
    lists = found.groupBy("doc_id", "scope", "needle").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all"))
    return lists.select("doc_id", "scope", "needle", F.explode(_apart(F.col("all"))).alias("m")).select("doc_id", "scope", "needle", "m.start", "m.end")


def _apart(ordered: Column) -> Column:
    """Of ordered bounds those that begin at or after the end of the last one taken."""
    first = F.struct(F.lit(-1).alias("to"), F.slice(ordered, 1, 0).alias("out"))
    return F.aggregate(ordered, first, lambda a, x: F.when(x["start"] >= a["to"], F.struct(x["end"].alias("to"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
