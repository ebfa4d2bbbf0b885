"""Phrase collocation mining over vertical positional inverted lists.

Documents are put in blocks of a bounded size. In a block, a phrase has the sorted list of its positions; positions skip
a number where a piece ends, so that neighbours in a list of positions are neighbours in a piece. A phrase is extended
by merge-joining the positions after its occurrences with the positions of frequent words; the length of the joined
list is the phrase's exact frequency in the block. Only phrases frequent in the whole corpus are extended further.

Between two lengths, blocks send each different phrase with its frequency to the bucket of its hash, where frequencies
are added up; the bucket gives frequent phrases a number and tells each block that holds them. So a task holds a block
or a bucket, a very common word is one entry of each block, and no list of words or phrases is broadcast.

Defined results: a null text is empty, a null language `und` (as is that language itself); repeated rows count each;
pieces and words are those of the patterns below, whatever else they hold; a piece longer than a block is a block of its
own; phrases with equal score and frequency are in byte order; an empty table gives no rows; columns besides the two
named ones don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import chunks, common

#: Text bytes of a block, and entries that a bucket gets on average.
BLOCK_BYTES, BUCKET_ENTRIES = 8 << 20, 200_000
LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: Parts of a language that are ranked apart before the best of all parts meet.
PARTS = 64

_ENDS, _BLANK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_LOWER[65:91] += 32


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed value."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    whole = b"".join([np.array([len(raw), *map(len, raw)], "<i8").tobytes(), *raw])
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd").compress(whole, asbytes=True)


def unpack(body: bytes) -> list[bytes]:
    whole = memoryview(pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True))
    n = int.from_bytes(whole[:8], "little")
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(whole[8 : 8 * (n + 1)], "<i8")])
    return [bytes(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def longs(part: bytes) -> np.ndarray:
    return np.frombuffer(part, "<i8")


def _short(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences, which compress well."""
    return np.diff(values, prepend=0).astype("<i4").tobytes()


def _full(part: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(part, "<i4").astype(np.int64))


def cut_long(text: bytes) -> list[bytes]:
    """A text in parts of about a block, cut after ends of pieces."""
    if len(text) <= BLOCK_BYTES:
        return [text]
    ends, out, at = np.flatnonzero(_ENDS[np.frombuffer(text, np.uint8)]) + 1, [], 0
    while len(text) - at > BLOCK_BYTES:
        i = int(np.searchsorted(ends, at + BLOCK_BYTES, side="right"))
        to = int(ends[i - 1]) if i and ends[i - 1] > at else int(ends[i]) if i < len(ends) else len(text)
        out.append(text[at:to])
        at = to
    return [*out, text[at:]] if at < len(text) else out


def block(langs: list[str], texts: list[bytes]) -> dict:
    """One block: its words (language in hex, tab, word, line end), their frequencies, and all words by number, -1 where a piece ends."""
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    data, bounds = common.bytes_view(pa.array([texts[i] for i in order], pa.large_binary()))
    data = _LOWER[data]
    ends = _ENDS[data]
    inside = ~(ends | _BLANK[data])
    first, last = chunks.starts(data, bounds, inside)
    words = chunks.binaries(data[inside], np.append(0, np.cumsum(last - first)))
    of = np.searchsorted(bounds, first, side="right") - 1
    piece = np.cumsum(ends)[first] + of if len(first) else first  # a number that changes where a piece or a text ends
    names, starts = np.unique([langs[i] for i in order], return_index=True) if order else (np.zeros(0, str), np.zeros(0, np.int64))
    at = np.append(np.searchsorted(of, starts), len(first))
    codes, listed, size, totals = [], [], 0, []
    for name, a, b in zip(names.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = words.slice(a, b - a).dictionary_encode()
        codes.append(own.indices.to_numpy().astype(np.int32) + np.int32(size))
        mark = name.encode().hex().encode() + b"\t"
        listed += [mark + w + b"\n" for w in own.dictionary.to_pylist()]
        size, totals = len(listed), [*totals, b - a]
    codes = np.concatenate([np.zeros(0, np.int32), *codes])
    gaps = np.append(0, np.cumsum(np.diff(piece) != 0)) if len(piece) else piece
    line = np.full(len(codes) + (int(gaps[-1]) if len(gaps) else 0), -1, np.int32)
    line[np.arange(len(codes)) + gaps] = codes
    return {"words": b"".join(listed), "counts": np.bincount(codes, minlength=size).astype("<i8").tobytes(), "line": line.tobytes(), "langs": names.tolist(), "totals": totals, "n_words": len(codes), "n_listed": size}


def blocks(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Documents as blocks: block, words, counts, line, langs, totals, n_words, n_listed."""
    schema = "block long, words binary, counts binary, line binary, langs array<string>, totals array<bigint>, n_words long, n_listed long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, size, langs, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def made() -> pa.RecordBatch:
            one = {"block": no, **block(langs, texts)}
            return pa.RecordBatch.from_pylist([one], pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in names[1:4]), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("n_words", pa.int64()), ("n_listed", pa.int64())]))

        for batch in common.steps(batches):
            for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                for part in cut_long(text or b""):
                    langs.append(lang)
                    texts.append(part)
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        yield made()
                        no, size, langs, texts = no + 1, 0, [], []
        if size:
            yield made()

    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(common.lean(run), schema)


def _rows(found: list[tuple], names: list[str], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema)


SENT = "bucket long, block long, body binary"
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
#: A block's frequent phrases of a length, or (block null) all of a bucket with their frequencies.
TOLD = "block long, size int, body binary"
_TOLD = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("body", pa.binary())])


def _dealt(block: int, buckets: np.ndarray, body) -> list[tuple]:
    """A row for each bucket; body gives what goes to it from the ascending places of its entries."""
    order = np.argsort(buckets, kind="stable")
    names, starts = np.unique(buckets[order], return_index=True)
    return [(int(n), block, body(order[a:b])) for n, a, b in zip(names, starts, np.append(starts, len(order))[1:], strict=True)]


def send_words(made: DataFrame, buckets: int) -> DataFrame:
    """Each block's different words and their frequencies to buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(words, np.uint8)
                ends = np.append(0, np.flatnonzero(data == 10) + 1)
                column, n = chunks.binaries(data, ends), np.frombuffer(counts, "<i8")
                which = (common.hashes(data, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
                found = _dealt(no, which, lambda i: pack(_short(i), n[i], chunks.data_of(column.take(pa.array(i)))[0].tobytes()))
                yield from _rows(found, ["bucket", "block", "body"], _SENT).to_batches()

    return made.select("block", "words", "counts").mapInArrow(common.lean(run), SENT)


def _told(bucket: int, size: int, sent: list[tuple], of: np.ndarray, totals: np.ndarray, number: np.ndarray, rest) -> pa.Table:
    """Numbers of frequent phrases for each block, and the bucket's totals. of: the phrase of each entry; number: -1 for those that aren't frequent."""
    out, at = [], 0
    for no, local in sent:
        mine = number[of[at : at + len(local)]]
        at += len(local)
        if (mine >= 0).any():
            out.append((no, size, pack(_short(local[mine >= 0]), mine[mine >= 0])))
    if (number >= 0).any():
        which = np.flatnonzero(number >= 0)
        out.append((None, size, pack(number[which], totals[which], *rest(which))))
    return _rows(out, ["block", "size", "body"], _TOLD)


def add_words(sent: DataFrame, least: int) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, parts = key[0].as_py(), [unpack(b) for b in table.column("body").to_pylist()]
        columns = []
        for _, _, words in parts:
            data = np.frombuffer(words, np.uint8)
            columns.append(chunks.binaries(data, np.append(0, np.flatnonzero(data == 10) + 1)))
        words = pa.concat_arrays(columns).dictionary_encode()
        of = words.indices.to_numpy()
        totals = np.bincount(of, np.concatenate([longs(p[1]) for p in parts]), len(words.dictionary)).astype(np.int64)  # exact up to 2^53
        number = np.full(len(totals), -1, np.int64)
        frequent = np.flatnonzero(totals >= least)
        ranked = frequent[pc.sort_indices(words.dictionary.take(pa.array(frequent))).to_numpy()]  # the same numbers in any order of rows
        number[ranked] = (bucket << 32) + np.arange(len(ranked))
        return _told(bucket, 1, list(zip(table.column("block").to_pylist(), (_full(p[0]) for p in parts), strict=True)), of, totals, number, lambda i: [chunks.data_of(words.dictionary.take(pa.array(i)))[0].tobytes()])

    return sent.groupBy("bucket").applyInArrow(run, TOLD)


def add_phrases(sent: DataFrame, size: int, least: int) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, parts = key[0].as_py(), [unpack(b) for b in table.column("body").to_pylist()]
        n, left, right = (np.concatenate([longs(p[k]) for p in parts]) for k in (1, 2, 3))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.append(True, (np.diff(left) != 0) | (np.diff(right) != 0))
        start = np.flatnonzero(new)
        totals = np.add.reduceat(n[order], start)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        number = np.where(totals >= least, (bucket << 32) + np.cumsum(totals >= least) - 1, -1)
        return _told(bucket, size, list(zip(table.column("block").to_pylist(), (_full(p[0]) for p in parts), strict=True)), of, totals, number, lambda i: [left[start[i]], right[start[i]]])

    return sent.groupBy("bucket").applyInArrow(run, TOLD)


def extended(line: np.ndarray, told: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block, the different phrases of `size` words: number of all words but the last as a phrase, number of the last word, frequency.

    told: by length, which of the block's phrases (in the order of this function, ascending) are frequent, and their numbers.
    """
    none = np.zeros(0, np.int64)
    if any(k not in told for k in range(1, size)):
        return none, none, none
    local, word = told[1]
    known = np.full(max(int(line.max(initial=0)), int(local.max(initial=0))) + 2, -1, np.int64)
    known[local] = np.arange(len(local))
    postings = np.flatnonzero(known[line] >= 0)  # the last place of known, for -1, is -1
    term = known[line[postings]]
    places, phrase, numbers = postings, term, word
    for k in range(2, size + 1):
        nxt = np.minimum(np.searchsorted(postings, places + k - 1), len(postings) - 1)
        met = postings[nxt] == places + k - 1 if len(postings) else np.zeros(0, bool)
        if k > 2:  # the phrase without its first word must be frequent too
            later = np.minimum(np.searchsorted(places, places + 1), len(places) - 1)
            met &= places[later] == places + 1 if len(places) else met
        entry = phrase[met] * len(word) + term[nxt[met]]
        if k == size:
            kinds, n = np.unique(entry, return_counts=True)
            return numbers[kinds // len(word)], word[kinds % len(word)], n
        kinds, kind = np.unique(entry, return_inverse=True)
        local, numbers = told[k]
        again = np.full(len(kinds), -1, np.int64)
        again[local] = np.arange(len(local))
        stay = again[kind] >= 0
        places, phrase = places[met][stay], again[kind][stay]
    return none, none, none


def send_phrases(made: DataFrame, told: DataFrame, size: int, buckets: int) -> DataFrame:
    """Each block's different phrases of `size` words, extended from frequent ones, and their frequencies to buckets."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows([], ["bucket", "block", "body"], _SENT)
        no, line = left.column("block")[0].as_py(), np.frombuffer(left.column("line")[0].as_py(), np.int32)
        lists: dict[int, list] = {}
        for length, body in zip(right.column("size").to_pylist(), right.column("body").to_pylist(), strict=True):
            local, number = unpack(body)
            lists.setdefault(length, []).append((_full(local), longs(number)))
        # Rows of buckets come in any order; a block's phrases have one.
        whole = {k: [np.concatenate([x[i] for x in v]) for i in (0, 1)] for k, v in lists.items()}
        known = {k: (local[by], number[by]) for k, (local, number) in whole.items() for by in [np.argsort(local)]}
        first, last, n = extended(line, known, size)
        with np.errstate(over="ignore"):
            mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        which = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        return _rows(_dealt(no, which, lambda i: pack(_short(i), n[i].astype("<i8"), first[i], last[i])), ["bucket", "block", "body"], _SENT)

    return made.select("block", "line").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, SENT)


def _unpacked(told: DataFrame, words: bool) -> DataFrame:
    """The totals of all buckets as rows: id, n and the word with its language, or the numbers of its two parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                number, n, *rest = unpack(body)
                if words:
                    pairs = [w.split(b"\t", 1) for w in rest[0].split(b"\n")[:-1]]
                    yield common.record(["id", "n", "lang", "word"], [longs(number), longs(n), [bytes.fromhex(a.decode()).decode() for a, _ in pairs], [b.decode() for _, b in pairs]])
                else:
                    yield common.record(["id", "n", "left", "right"], [longs(number), longs(n), longs(rest[0]), longs(rest[1])])

    schema = "id long, n long, lang string, word string" if words else "id long, n long, left long, right long"
    return told.where("block IS NULL").select("body").mapInArrow(common.lean(run), schema)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, words: array of word numbers, n) of all phrases of 1 to `longest` words with n >= least, and (lang, n) of all words."""
    spark = docs.sparkSession
    common.ship(spark)
    made = common.stored(blocks(docs, text_column, lang_column), "blocks")
    sums = made.agg(F.sum("n_listed").alias("listed"), F.sum("n_words").alias("words")).first()
    entries = sums.listed or 0
    told = common.stored(add_words(send_words(made, 1 + entries // BUCKET_ENTRIES), least), "words")
    common.tidy(spark)
    words = common.stored(_unpacked(told, True), "frequent-1")
    table = words.select("id", "lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), F.array("id").alias("words"), "n")
    found, lists = [table], [told]
    for size in range(2, longest + 1):
        entries = found[-1].agg(F.sum("n")).first()[0] or 0  # no more occurrences can be extended
        known = lists[0] if size == 2 else lists[0].unionByName(lists[1]) if size == 3 else lists[0].unionByName(lists[1]).unionByName(lists[2])
        told = common.stored(add_phrases(send_phrases(made, known.where("block IS NOT NULL"), size, 1 + entries // BUCKET_ENTRIES), size, least), f"phrases-{size}")
        common.tidy(spark)
        before, last = found[-1].select(F.col("id").alias("left"), "lang", "phrase", "words"), words.select(F.col("id").alias("right"), "word")
        joined = _unpacked(told, False).join(before, "left").join(last, "right")
        grown = joined.select("id", "lang", F.lit(size).alias("size"), F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("words", F.array("right")).alias("words"), "n")
        found.append(common.stored(grown, f"frequent-{size}"))
        lists.append(told)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    totals = made.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    return every.drop("id"), totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words."""
    every, totals = frequent_phrases(docs, longest, least, text_column, lang_column)
    parts = every.select(F.col("words").alias("part"), F.col("n").alias("f"))
    candidates = every.where("size > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    cut = candidates.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    cut = cut.join(parts.toDF("left", "l"), "left").join(parts.toDF("right", "r"), "right")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div CAST(l + r AS DECIMAL(20, 0))")
    lowest = cut.groupBy("words").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = candidates.where(F.size("words") > 2).select(F.explode(inner).alias("words"), F.col("a").alias("f")).groupBy("words").agg(F.max("f").alias("f"))
    over = (F.col("f").cast("decimal(20,0)") * 100) >= (F.col("a").cast("decimal(20,0)") * covered)
    kept = candidates.join(longer, "words", "left").where(~F.coalesce(over, F.lit(False))).join(lowest, "words").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang), m AS (SELECT unnest([1, 2, 3, 4]) AS m),
i AS (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, m), f AS (SELECT lang, w[i : i + m - 1] AS ph, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len(ph) > 1), k AS (SELECT lang, ph, a, unnest(generate_series(1, len(ph) - 1)) AS k FROM c),
s AS (SELECT k.lang, k.ph, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a) // (x.a + y.a) AS score FROM k JOIN f x ON x.lang = k.lang AND x.ph = k.ph[1:k.k] JOIN f y ON y.lang = k.lang AND y.ph = k.ph[k.k + 1 :]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS no FROM s),
h AS (SELECT lang, ph[i : i + m - 1] AS ph, max(a) AS f FROM (SELECT lang, ph, a, m, unnest(generate_series(1, len(ph) - m + 1)) AS i FROM c, m WHERE m > 1 AND m < len(ph)) x GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, l, r, score::BIGINT AS score FROM b LEFT JOIN h ON h.lang = b.lang AND h.ph = b.ph WHERE b.no = 1 AND NOT coalesce(100::HUGEINT * f >= 80::HUGEINT * b.a, false)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
