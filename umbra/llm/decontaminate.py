"""Benchmark decontamination by an FM-index for each training shard.

A shard is some megabytes of texts, as a sequence of word ids: words of the benchmark have their number, any other word
and any end of a text is a separator. A window has no separator in it, so runs of benchmark words shorter than the
shortest window can hold none and are left out. Over what remains: the suffix order, its last column
in a wavelet matrix with rank counts, and text positions sampled at every eighth place and at starts of runs. All windows are
searched backward at once; occurrences are located by walking to sampled positions, and their spans are merged.

The benchmark goes to the workers in blocks of at most BLOCK_BYTES; each further block is one more pass over the stored
rows, so no broadcast grows with the benchmark.

Defined results: null and empty texts have no words and no hits; an item without words has no window; an item without an
id hits, but has no name to be listed; repeated rows and repeated items count each for itself; an empty benchmark leaves all documents clean. `scan` needs the id and text
columns alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import chunks, common

WINDOW = 10
#: Bytes of benchmark text that a pass searches for.
BLOCK_BYTES = 8 << 20
SAMPLE = 8
#: Bytes of a shard: texts of one index (one longer text is one shard).
STEP_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_BITS = 20


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and where words start and end."""
    data = LOWER[data]
    return data, *chunks.starts(data, bounds, WORD[data])


class Windows:
    """The windows of a block of the benchmark over its own vocabulary; number 0 is the separator."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            lower, first, last = words(data, np.array([0, len(data)]))
            raw = lower.tobytes()
            ids = [self.numbers.setdefault(raw[a:b], len(self.numbers) + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                rows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.size = size
        self.rows = list(rows)
        self.items = [sorted(x) for x in rows.values()]
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.shortest = int(self.lengths.min()) if self.rows else 0
        self.table = np.zeros((len(self.rows), size), np.int64)
        for i, r in enumerate(self.rows):
            self.table[i, size - len(r) :] = r
        known = list(self.numbers)
        ends = np.cumsum([0, *map(len, known)])
        h = common.hashes(np.frombuffer(b"".join(known), np.uint8), ends[:-1], ends[1:]) if known else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def number(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each word's number; words outside the benchmark have 0 (but for one in 2**64, which `check` finds)."""
        h = common.hashes(data, first, last)
        out = np.zeros(len(first), np.int32)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if len(at) and len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[k] == h[at]
            out[at[same]] = self.order[k[same]] + 1
        return out

    def check(self, numbers: np.ndarray, places: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray) -> None:
        """Compare the words at the places by their bytes."""
        get = self.numbers.get
        numbers[places] = [get(raw[a:b], 0) for a, b in zip(first[places].tolist(), last[places].tolist(), strict=True)]


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands in the first i places."""

    def __init__(self, column: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level & 1).astype(np.int8)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]).astype(np.int32))
            self.zeros.append(len(column) - int(self.ones[-1][-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][i]
            low, i = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.bits):
            a = self.ones[k][i]
            one = self.ones[k][i + 1] > a
            out = out << 1 | one
            i = np.where(one, self.zeros[k] + a, i - a)
        return out


class FMIndex:
    """Backward search over a sequence of words with separators (0), the last of them at its end."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        n = len(sequence)
        apart = np.cumsum(sequence == 0)  # separators differ from each other, so a suffix counts up to its separator
        rank, reach = np.where(sequence == 0, apart - 1, apart[-1] + sequence).astype(np.int64), 1
        _, rank = np.unique(rank, return_inverse=True)
        while rank.max() < n - 1:  # ranks of twice the length from ranks of pairs
            _, rank = np.unique(rank * n + np.roll(rank, -reach), return_inverse=True)
            reach *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        column = sequence[self.suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))]).astype(np.int64)
        self.matrix = WaveletMatrix(column.astype(np.int64), symbols)
        self.sampled = (self.suffixes % SAMPLE == 0) | (column == 0)  # no walk passes a separator
        self.position = self.suffixes[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.n, self.counts = n, np.diff(self.before)

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in suffix order of the rows of a table whose patterns stand at its right end."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for k in range(1, table.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (low < high))
            c = table[live, -k]
            low[live] = self.before[c] + self.matrix.rank(c, low[live])
            high[live] = self.before[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows in suffix order, walking back to a sampled one."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows[open_]]
            at = open_[done]
            out[at] = self.position[self.sample_rank[rows[at]]] + steps
            open_ = open_[~done]
            c = self.matrix.access(rows[open_])
            rows[open_] = self.before[c] + self.matrix.rank(c, rows[open_])
            steps += 1
        return out % self.n


def shard_hits(data: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the found occurrences: text, first word (counted in its text), window."""
    lower, first, last = words(data, bounds)
    upto = np.searchsorted(first, bounds)
    count, none = np.diff(upto), np.zeros(0, np.int64)
    if not windows.rows or not len(first):
        return count, none, none, none
    numbers = windows.number(lower, first, last)

    def long_runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = chunks.starts(numbers, upto, numbers > 0)
        keep = b - a >= windows.shortest
        return a[keep], b[keep]

    a, b = long_runs(numbers)
    if not len(a):
        return count, none, none, none
    places = _ranges(a, b)
    windows.check(numbers, places, lower.tobytes(), first, last)
    a, b = long_runs(numbers)
    if not len(a):
        return count, none, none, none
    # Runs in text order, one separator after each; place of each symbol in the shard's words.
    places, size = _ranges(a, b), b - a
    at = np.arange(len(places)) + np.repeat(np.arange(len(a)), size)
    used, local = np.unique(numbers[places], return_inverse=True)
    sequence, source = np.zeros(len(places) + len(a), np.int64), np.zeros(len(places) + len(a), np.int64)
    sequence[at], source[at] = local + 1, places
    index = FMIndex(sequence, len(used) + 1)
    slot = np.searchsorted(used, windows.table)
    slot = np.minimum(slot, len(used) - 1)
    there = (used[slot] == windows.table) | (windows.table == 0)
    able = np.flatnonzero(there.all(axis=1))
    low, high = index.search(np.where(windows.table[able] > 0, slot[able] + 1, 0), windows.lengths[able])
    met = np.flatnonzero(high > low)
    word = source[index.locate(_ranges(low[met], high[met]))]
    text = np.searchsorted(upto, word, side="right") - 1
    return count, text, word - upto[text], np.repeat(able[met], (high - low)[met])


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0] .. b[0]-1, a[1] .. b[1]-1, ..."""
    size = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as (start, end), in order; spans that touch are one."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    begin = np.flatnonzero(new)
    return list(zip(low[begin].tolist(), high[np.append(begin[1:], len(low)) - 1].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded size; one at a time is on the driver."""
    items = benchmark.select(F.col(item_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")).first().b or 0
    if total <= BLOCK_BYTES:
        yield [tuple(r) for r in items.collect()]
        return
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append(tuple(r))
        size += len((r.t or "").encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS, ITEMS, WORDS = "__umbra_spans", "__umbra_items", "__umbra_words"


def _scanned(table: DataFrame, text: str, benchmark: DataFrame, item_column: str, item_text: str, window: int) -> DataFrame:
    """The table with the number of words of its text, hit spans and found items; one pass for each block of the benchmark."""
    spark, out = table.sparkSession, None
    common.ship(spark)
    kind = "array<struct<lo:bigint,hi:bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), f"{WORDS} bigint, {SPANS} {kind}, {ITEMS} array<bigint>"])
    for block in _blocks(benchmark, item_column, item_text):
        shared = spark.sparkContext.broadcast(block)
        before = table.withColumns({WORDS: F.lit(0).cast("long"), SPANS: F.array().cast(kind), ITEMS: F.array().cast("array<bigint>")}) if out is None else common.stored(out, "scan")
        out = before.mapInArrow(_searcher(shared, text, window), schema)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans array<struct<lo, hi>> (hit words, end excluded), items array<long>. No shuffle."""
    found = _scanned(common.id_text(docs, id_column, text_column), "text", benchmark, item_column, item_text, window)
    return found.select("doc_id", F.col(WORDS).alias("n_words"), F.col(SPANS).alias("spans"), F.col(ITEMS).alias("items"))


_made: dict[str, Windows] = {}


def _searcher(shared, text_column: str, window: int):
    key = uuid.uuid4().hex  # of this block, on the driver: workers outlive broadcasts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Windows(shared.value, window)
        windows = _made[key]
        for batch in common.steps(batches, text_column, STEP_BYTES):
            own = batch.num_columns - 3
            count, text, word, which = shard_hits(*common.bytes_view(batch.column(batch.schema.get_field_index(text_column))), windows)
            spans, items = ([x or [] for x in batch.column(own + k).to_pylist()] for k in (1, 2))
            order = np.argsort(text, kind="stable")
            text, word, which = text[order], word[order], which[order]
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
            for a, b in zip(begin, [*begin[1:], len(text)], strict=False):
                t = text[a]
                old = np.array([(x["lo"], x["hi"]) for x in spans[t]], np.int64).reshape(-1, 2)
                low, high = np.concatenate([old[:, 0], word[a:b]]), np.concatenate([old[:, 1], word[a:b] + windows.lengths[which[a:b]]])
                spans[t] = [{"lo": x, "hi": y} for x, y in merged(low, high)]
                items[t] = sorted({*items[t], *(i for w in np.unique(which[a:b]).tolist() for i in windows.items[w] if i is not None)})
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield common.record(batch.schema.names, [*batch.columns[:own], pa.array(count, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))])

    return common.lean(run)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (all columns) with the hit words of each text cut out, from the first one's start to the last one's end; n_chars, where docs has it, follows."""
    return _apply(docs, benchmark, window, whole=False)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (all columns) without contaminated rows: each row is decided by its own text, in one pass."""
    return _apply(docs, benchmark, window, whole=True)


def _apply(docs: DataFrame, benchmark: DataFrame, window: int, whole: bool) -> DataFrame:
    table, keep = common.renamed(docs)
    names = dict(zip(docs.columns, keep, strict=True))
    found = _scanned(table, names["text"][0], benchmark, "item_id", "text", window)
    if whole:
        return found.where(F.size(SPANS) == 0).drop(WORDS, SPANS, ITEMS).toDF(*docs.columns)
    text, own = names["text"][0], [n for n, _ in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            texts = []
            for t, spans in zip(batch.column(own.index(text)).to_pylist(), batch.column(len(own)).to_pylist(), strict=True):
                if spans:
                    raw = np.frombuffer(t.encode(), np.uint8)
                    _, first, last = words(raw, np.array([0, len(raw)]))
                    ends = [0, *(int(x) for s in spans for x in (first[s["lo"]], last[s["hi"] - 1])), len(raw)]
                    t = b"".join(raw[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2], strict=True)).decode()
                texts.append(t)
            columns = list(batch.columns[: len(own)])
            columns[own.index(text)] = pa.array(texts, pa.string())
            yield common.record(own, columns)

    out = found.select(*own, SPANS).mapInArrow(common.lean(run), ", ".join(f"`{n}` {t}" for n, t in keep)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(names["n_chars"][1])) if "n_chars" in docs.columns else out


def op2_fm_index(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(generate_series(1, len(w) - 9), lambda k: w[k : k + 9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b), n AS (SELECT DISTINCT len(g) AS n FROM i),
p AS (SELECT r, k, n, w[k : k + n - 1] AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, n) x), m AS (SELECT r, k, n, item_id FROM p JOIN i USING (g)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM m) y GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
