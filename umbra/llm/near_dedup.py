"""Near-duplicate classes by DartMinHash.

A document is the set of its runs of five words (all its words, if it has fewer), weighted: a shingle that occurs c times
weighs 1 + ln(c) / 16. Each shingle throws darts: a Poisson process over weight and rank that depends on the shingle
alone; a document collects the darts within its weights, up to a rank at which it has some k ln k of them. Each dart
falls on one of k coordinates, and the earliest of each coordinate is kept: documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Bands of ROWS coordinates give candidates: at a similarity of 0.8 a pair
is missed with a probability below 0.0001.

Candidates are checked by their whole texts: a link is a Jaccard similarity of 0.8 or more of the plain sets. A bucket
has a hub, its document with most company in all its buckets, and each document is compared with its hubs. What is then
linked with the hub is of one class. A pair of which one is not linked with the hub can only be a link if both depart
from the hub in the same shingles, and in how many follows from the sizes: with n shingles in the hub, a and b added to it
and r and s taken away, at least (0.8 (n + a + b) - n + r + s) / 1.8 of them. So only departures are joined, by
the rarest of each document that this bound leaves (prefix and position filter, which lose nothing), and what remains is
compared. No bucket gives all pairs, and no link within a bucket is lost.

Equal texts are one document from the start. Classes are connected components; each is named by its least doc_id, and its
row with that doc_id (the first of several) is kept.

Defined results: a null text is alike to nothing; texts without words are alike to equal texts only; each row is a document
by its number (common.numbered), whether its doc_id is null, shared or its own, and equal rows are copies of each other; a
class is null if none of its rows has a doc_id; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import common
from umbra.llm.decontaminate import words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the number of shingles before each text."""
    lower, first, last = words(data, bounds)
    h = mix(common.hashes(lower, first, last))
    upto = np.searchsorted(first, bounds)
    n = np.diff(upto)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(ends[-1]) - ends[text] + upto[text]
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            there = k < n[text]
            out = np.where(there, out * _MIX[0] + h[np.minimum(at + k, max(len(h) - 1, 0))], out) if len(h) else out
        return mix(out + np.minimum(n, size).astype(np.uint64)[text]), ends


def signatures(elements: np.ndarray, ends: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k dart numbers for each set (rows of sets without elements are all ones). Equal elements of a set throw equal darts."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    w = np.ones(len(elements)) if weights is None else weights
    total = np.maximum(np.bincount(owner, w, minlength=n), 1e-300)
    reach = k * (np.log(k) + 3) / total
    table = np.full(n * k, _NONE, np.uint64)
    todo = np.ones(n, bool) & (np.diff(ends) > 0)
    while todo.any():
        live = np.flatnonzero(todo[owner])
        level, low, high = 0, 0.0, 1.0
        while len(live):  # strips of weight: [0, 1), [1, 2), [2, 4), ...
            _throw(elements[live], owner[live], w[live], reach, level, low, high, k, table)
            level, low, high = level + 1, high, 2 * high
            live = live[w[live] > low]
        todo &= (table.reshape(n, k) == _NONE).any(axis=1)
        reach = np.where(todo, 2 * reach, reach)
    return (table & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)


def _throw(e: np.ndarray, owner: np.ndarray, w: np.ndarray, reach: np.ndarray, level: int, low: float, high: float, k: int, table: np.ndarray) -> None:
    """Darts of one strip: ranks are a Poisson process at the strip's width, places in it are uniform."""
    with np.errstate(over="ignore"):
        state = mix(mix(e) + np.uint64(level + 1) * _MIX[0])
        rank, limit = np.zeros(len(e)), reach[owner]
        while len(state):
            state = mix(state + _MIX[0])
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / (high - low)
            keep = rank <= limit
            if not keep.all():
                state, rank, limit, owner, w = state[keep], rank[keep], limit[keep], owner[keep], w[keep]
            dart = mix(state ^ _MIX[1])
            at = owner * k + (dart >> np.uint64(33)).astype(np.int64) % k
            packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (mix(dart) & np.uint64(0xFFFFFFFF))
            if w.min(initial=high) < high:
                place = low + (mix(dart + _MIX[2]) >> np.uint64(11)).astype(np.float64) / 2**53 * (high - low)
                hit = place < w
                at, packed = at[hit], packed[hit]
            np.minimum.at(table, at, packed)


def bands(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The hash of each band of each row."""
    n, k = table.shape
    with np.errstate(over="ignore"):
        out = np.zeros((n, k // rows), np.uint64) + np.arange(k // rows, dtype=np.uint64) * _MIX[0]
        for j in range(rows):
            out = mix(out + _MIX[0]) + table[:, j : k // rows * rows : rows]
        return mix(out)


def weighted(elements: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different elements of each set, their ends, and their weights."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])])) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(order)))
    return elements[new], np.searchsorted(owner[new], np.arange(n + 1)), 1 + np.log(count) / 16


def _signed(rows: DataFrame) -> DataFrame:
    """row, doc_id, h1, h2 (of the text; null for a null text), bands of numbered rows."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            elements, ends, weights = weighted(*shingles(*common.bytes_view(batch.column(1))))
            found = bands(signatures(elements, ends, weights)).view(np.int64)
            some = np.diff(ends) > 0
            size = np.concatenate([[0], np.cumsum(np.where(some, found.shape[1], 0))]).astype(np.int32)
            yield common.record(["row", "doc_id", "h1", "h2", "bands"], [batch.column(0), *batch.columns[2:], pa.ListArray.from_arrays(pa.array(size), pa.array(found[some].ravel()))])

    text = rows.select(F.col(common.ROW).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    text = text.withColumns({"h1": F.when(F.col("text").isNotNull(), F.xxhash64("text")), "h2": F.when(F.col("text").isNotNull(), F.xxhash64(F.lit("again"), F.col("text"), F.octet_length("text")))})
    return text.mapInArrow(common.lean(run), "row long, doc_id long, h1 long, h2 long, bands array<long>")


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of the texts ta and tb of each row, sorted and different."""
    (ea, na), (eb, nb) = [shingles(*common.bytes_view(batch.column(i))) for i in (2, 3)]
    for i in range(batch.num_rows):
        yield np.unique(ea[na[i] : na[i + 1]]), np.unique(eb[nb[i] : nb[i + 1]])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Merge joins at every size: few pairs aren't broadcast, so that plans and their cost follow the input."""
    ta, tb = (texts.select(F.col("row").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.hint("merge").join(ta, "a").hint("merge").join(tb, "b").select("a", "b", "ta", "tb")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with n shingles of a, how many of them b lacks and how many it adds, and their similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(common.steps(batches, "ta"), "tb"):
            rows = []
            for x, y in _sets(batch):
                both = len(np.intersect1d(x, y, assume_unique=True))
                rows.append((len(x), len(x) - both, len(y) - both))
            n, lacks, adds = np.array(rows, np.int64).T
            alike = (n - lacks) / np.maximum(n + adds, 1)
            yield common.record(["a", "b", "n", "lacks", "adds", "alike"], [batch.column(0), batch.column(1), n, lacks, adds, alike])

    return _with_texts(pairs, texts).mapInArrow(common.lean(run), "a long, b long, n long, lacks long, adds long, alike double")


def _departures(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, element: the shingles that one of the two has and the other one has not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(common.steps(batches, "ta"), "tb"):
            found = [np.setxor1d(x, y, assume_unique=True) for x, y in _sets(batch)]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield common.record(["a", "b", "element"], [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), np.concatenate(found).view(np.int64)])

    return _with_texts(pairs, texts).mapInArrow(common.lean(run), "a long, b long, element long")


def _left_over(tested: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs with a hub in common that may yet be links between classes, each once."""
    name = labels.select(F.col("node").alias("b"), F.col("label").alias("of"))
    hub = labels.select(F.col("node").alias("a"), F.col("label").alias("of_hub"))
    named = tested.join(name, "b", "left").join(hub, "a", "left").select("a", "b", "n", "lacks", "adds", (F.col("alike") >= similarity).alias("linked"), F.coalesce("of", "b").alias("label"), F.coalesce("of_hub", "a").alias("hub_label"))
    mixed = named.where(F.col("label") != F.col("hub_label")).select("a").distinct()
    group = common.stored(named.join(mixed, "a", "left_semi").where(F.col("lacks") + F.col("adds") > 0), "groups")
    apart = common.stored(_departures(group.select("a", "b"), texts), "departures")
    shared = apart.groupBy("a", "element").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    # A document's departures from rarest to most frequent; those of its own alone come first and meet nothing.
    rank = apart.join(shared, ["a", "element"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("ranked"))
    t = F.lit(similarity)
    size = F.col("lacks") + F.col("adds")
    least = F.when(F.col("linked"), t * F.col("adds") + F.col("lacks")).otherwise(t * (F.col("n") + F.col("adds")) - F.col("n") + F.col("lacks")) / (1 + t)
    prefix = size - F.greatest(F.lit(1), F.ceil(least - 1e-9)) + 1
    cut = group.join(rank, ["a", "b"]).withColumn("alone", size - F.size("ranked"))
    kept = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), prefix - F.col("alone")).cast("int"))
    rows = cut.select("a", "b", "n", "lacks", "adds", "linked", "label", "alone", F.posexplode(kept).alias("at", "entry"))
    rows = common.stored(rows.select("a", "b", "n", "lacks", "adds", "linked", "label", F.col("entry.element").alias("element"), (size - F.col("alone") - F.col("at") - 1).alias("behind")), "prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    need = F.ceil((t * (F.col("x.n") + F.col("x.adds") + F.col("y.adds")) - F.col("x.n") + F.col("x.lacks") + F.col("y.lacks")) / (1 + t) - 1e-9)
    close = (F.col("x.a") == F.col("y.a")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.b") < F.col("y.b")) & (F.col("x.label") != F.col("y.label")) & ~(F.col("x.linked") & F.col("y.linked")) & (1 + F.least("x.behind", "y.behind") >= need)
    return x.join(y, close).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that it is connected with. Labels pass over edges and then over labels until none changes."""
    both = common.stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("label", "m").alias("mid"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = common.stored(moved.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), "old"), "labels")
        changed = after.where(F.col("label") != F.col("old")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def classified(numbered: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, class_id, kept of numbered rows."""
    spark = numbered.sparkSession
    signed = common.stored(_signed(numbered), "signed")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("lead")
    same = signed.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("row").alias("first"), lead, F.first("bands").alias("bands"))
    same = common.stored(same, "texts")
    rows = same.select(F.col("first").alias("doc"), F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = common.stored(rows.join(buckets, "bucket"), "members")
    company = members.groupBy("doc").agg(F.sum("n").alias("met"))
    hubs = members.join(company, "doc").groupBy("bucket").agg(F.max(F.struct("met", "doc")).alias("hub")).select("bucket", F.col("hub.doc").alias("hub"))
    pairs = members.join(hubs, "bucket").where(F.col("doc") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    needed = members.select(F.col("doc").alias("id")).distinct()
    whole = numbered.select(F.col(common.ROW).alias("row"), F.col("text").cast("string").alias("text"))
    texts = common.stored(whole.join(needed.hint("merge"), whole["row"] == needed["id"], "left_semi"), "compared")
    tested = common.stored(_compared(pairs, texts), "tested")
    links = tested.where(F.col("alike") >= similarity).select("a", "b")
    labels = components(links)
    common.tidy(spark, members)
    more = common.stored(_compared(common.stored(_left_over(tested, labels, texts, similarity), "pairs"), texts), "compared").where(F.col("alike") >= similarity).select("a", "b")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    common.tidy(spark, tested, texts)
    linked = same.select("first", "lead").join(labels.withColumnRenamed("node", "first"), "first")
    leads = linked.join(linked.groupBy("label").agg(F.min("lead").alias("best")), "label").select("first", "best")
    firsts = same.select("h1", "h2", "first", "lead").join(leads, "first", "left").select("h1", "h2", F.coalesce("best", "lead").alias("best"))
    found = signed.select("row", "doc_id", "h1", "h2").join(firsts, ["h1", "h2"], "left")
    class_id = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return found.select("row", "doc_id", class_id.alias("class_id"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for each row of docs."""
    return classified(common.numbered(common.id_text(docs)), similarity).select("doc_id", "class_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs (all columns) with one row of each class: the first with the least doc_id."""
    rows = common.numbered(docs)
    return common.without(rows, classified(rows).where(~F.col("kept")).select("row"))


def op1_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return classified(common.numbered(common.id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))).drop("row")
