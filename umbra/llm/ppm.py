"""Language-model scoring by prediction by partial matching over bytes, pretrained on the corpus.

A text is coded as its lower-cased (A-Z) words, a space after each, and one end symbol. A symbol's context is up to ORDER
bytes of the running text before it, over word bounds, back to a space before the text. The byte-context trie holds what
training texts show. The longest context of the trie that fits predicts; a symbol not seen there escapes (its weight:
the discounts of the counts there) to the context one byte shorter, in which the symbols of the longer one are excluded;
below the empty context all other byte values are alike. The score of a text is the sum of its symbols' log10.

Steps: (1) one pass gathers the texts in blocks, small partitions together, and each block lists its different words and
grams (longest context and symbol) with how often training texts hold them; (2) words and grams are counted over the blocks, and shorter contexts
from longer ones; (3) the trie and the grams to be coded are dealt by the last three bytes of a context, and each deal
is coded by itself: each different gram is coded once for the whole corpus; (4) code lengths and word counts go back to
the blocks that list them, in the order grams, words, texts, so that a task holds two columns of a block's grams and sums
its texts as they stream by. Nothing is broadcast, and the driver sees a few dozen counts only.
Contexts of fewer than three bytes go to each deal; a deal of one ending has at most 2^24 grams for each level.

Defined results: null and empty texts are one end; a null doc_id is held out or not as id 0 is; repeated rows count and
are scored each for itself; without training rows the trie is empty and every symbol costs 1/256; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm import chunks, common
from umbra.llm.decontaminate import LOWER

ORDER = 5
#: Grams of the trie in a deal, on average.
PART_GRAMS = 1_000_000
#: Bytes of the context by which grams are dealt.
NEAR = 3
#: Text bytes of a block: the larger, the fewer rows list the same words and grams.
BLOCK_BYTES = 64 << 20
#: Text bytes that a task works on at a time, and grams listed by such steps that it keeps before it adds them up.
STEP_BYTES = 1 << 20
FOLD_GRAMS = 1_000_000
END = b"\xff"  # stands in no UTF-8 text
SPACE = 32
#: Where a gram's number holds the length of its context; the context's bytes and the symbol stand below.
LEVEL = 56


def held_out(ids: np.ndarray, mod: int = 7, rest: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % mod == rest for i in ids.tolist()], bool)


def held_out_column(doc_id: str, mod: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest


def streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What is coded of texts that end in a space and END: one space after each word, none elsewhere; and each text's bounds."""
    data, bounds = common.bytes_view(column)
    data = LOWER[data]
    solid = ~chunks.SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = solid[:-1]
    after[bounds[:-1]] = False
    data[~solid] = SPACE
    keep = solid | after
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words and ends of streams, and the number of tokens before each text."""
    spaces = np.flatnonzero(data == SPACE)
    first, last = np.sort(np.concatenate([bounds[:-1], spaces + 1])), np.sort(np.concatenate([bounds[1:], spaces]))
    ends = np.append(np.stack([first, last], axis=1).ravel(), len(data))
    column = chunks.binaries(data, ends).take(pa.array(np.arange(0, 2 * len(first), 2)))
    return column.dictionary_encode(), np.searchsorted(first, bounds)


def codes(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The gram of each symbol: how many bytes its longest context has, the context, the symbol."""
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    previous = np.where(place == 0, SPACE, np.roll(data, 1)).astype(np.int64)
    context, out = np.zeros(len(data), np.int64), data.astype(np.int64)
    for k in range(1, order + 1):
        fits = place >= k - 1
        context |= np.where(fits, np.roll(previous, k - 1), 0) << 8 * (k - 1)
        out = np.where(fits, k << LEVEL | context << 8 | data, out)
    return out


def blocks(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows of blocks: a word or a gram with its number in training texts (n), or a text as coded (doc_id, held_out, text)."""
    common.ship(docs.sparkSession)
    types = {"word": pa.binary(), "gram": pa.int64(), "n": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "text": pa.binary()}

    def rows(block: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        size = len(next(iter(columns.values())))
        for i in range(0, size, 50_000):
            m = min(50_000, size - i)
            yield common.record(["block", *types], [np.full(m, block), *(columns[k].slice(i, m) if k in columns else pa.nulls(m, t) for k, t in types.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        words: list[tuple[pa.Array, np.ndarray]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            column = pa.chunked_array([w for w, _ in words]).combine_chunks().dictionary_encode()
            words[:] = [(column.dictionary, np.bincount(column.indices.to_numpy(), np.concatenate([n for _, n in words]), len(column.dictionary)))]
            gram, n = (np.concatenate(x) for x in zip(*grams, strict=True))
            by = np.argsort(gram)
            gram = gram[by]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            grams[:] = [(gram[first], np.add.reduceat(n[by], first))]

        def lists() -> Iterator[pa.RecordBatch]:
            fold()
            yield from rows(block, word=words[0][0].cast(pa.binary()), n=pa.array(words[0][1].astype(np.int64)))
            yield from rows(block, gram=pa.array(grams[0][0]), n=pa.array(grams[0][1]))

        for batch in common.steps(batches, "text", STEP_BYTES):
            data, bounds = streams(batch.column(2))
            out = held_out(batch.column(0).to_numpy(zero_copy_only=False))
            column, upto = tokens(data, bounds)
            words.append((column.dictionary, np.bincount(column.indices.to_numpy(), np.repeat(~out, np.diff(upto)), len(column.dictionary))))
            both, n = np.unique(codes(data, bounds, order) << 1 | np.repeat(out, np.diff(bounds)), return_counts=True)
            grams.append((both >> 1, np.where(both & 1, 0, n)))
            yield from rows(block, doc_id=batch.column(1), held_out=pa.array(out), text=chunks.binaries(data, bounds).cast(pa.binary()))
            size += len(data)
            if sum(len(g) for g, _ in grams[1:]) > FOLD_GRAMS:
                fold()
            if size >= BLOCK_BYTES:
                yield from lists()
                block, size = block + 1, 0
                words.clear()
                grams.clear()
        if words:
            yield from lists()

    texts = common.id_text(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = texts.coalesce(-(-size // BLOCK_BYTES) or 1).select(F.coalesce("doc_id", F.lit(0)).alias("key"), "doc_id", F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.lit(b" " + END)).alias("text"))
    return source.mapInArrow(common.lean(run), "block long, word binary, gram long, n long, doc_id long, held_out boolean, text binary")


def trained(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, np.ndarray]:
    """The trie (level, gram, n) from grams (level, gram, n), and the discount of a count of 1, 2 and more for each level.

    The longest context that a place has counts each occurrence; a shorter one counts the different longer ones that it
    ends (updates are excluded where a longer context predicts). Discounts, which an escape collects, are estimated from
    how many counts are 1, 2, 3 and 4.
    """
    seen = grams.where(F.col("n") > 0).select("level", "gram", "n")
    longest = out = seen.where(F.col("level") == order)
    for k in range(order, 0, -1):
        ended = longest.select(F.expr(f"gram & {(1 << 8 * k) - 1}L").alias("gram"), F.lit(1).cast("long").alias("n"))
        both = ended.unionByName(seen.where(F.col("level") == k - 1).select("gram", "n")).groupBy("gram").agg(F.sum("n").alias("n"))
        longest = common.stored(both.select(F.lit(k - 1).alias("level"), "gram", "n"), f"level-{k - 1}")
        out = out.unionByName(longest)
    by = {(r.level, r.n): r["rows"] for r in out.where(F.col("n") <= 4).groupBy("level", "n").agg(F.count(F.lit(1)).alias("rows")).collect()}
    table = np.zeros((order + 1, 4))
    for level in range(order + 1):
        few = [by.get((level, i), 0) + 0.5 for i in range(1, 5)]
        y = few[0] / (few[0] + 2 * few[1])
        table[level, 1:] = [min(max(i - (i + 1) * y * few[i] / few[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
    return out, table


class Trie:
    """Sorted grams for each level with what prediction needs."""

    def __init__(self, level: np.ndarray, gram: np.ndarray, n: np.ndarray, discounts: np.ndarray) -> None:
        self.order = len(discounts) - 1
        self.grams, self.logs, self.contexts, self.fields = [], [], [], []
        for k in range(self.order + 1):
            at = np.flatnonzero(level == k)
            at = at[np.argsort(gram[at])]
            g, count = gram[at], n[at].astype(np.float64)
            cut = discounts[k][np.minimum(n[at], 3)]
            context, first = np.unique(g >> 8, return_index=True)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            total, escape, kinds = add(count), add(cut), np.diff(np.append(first, len(g)))
            down_escape, down_total = np.zeros(len(context)), np.zeros(len(context))
            if k and len(context):
                same = np.searchsorted(below[0], g & (1 << 8 * k) - 1)  # the same symbol after a context one byte shorter
                parent = np.searchsorted(self.contexts[-1], context & (1 << 8 * (k - 1)) - 1)
                more = sums[2][parent] > kinds
                left = np.where(more, sums[0][parent] - add(below[1][same]), 1)
                down_total = np.log10(left)
                down_escape = np.where(more, np.log10(np.where(more, sums[1][parent] - add(below[2][same]), 1) / left), 0.0)
            self.fields.append(np.stack([np.log10(total), np.log10(escape / total), down_escape, down_total], axis=1) if len(context) else np.zeros((0, 4)))
            self.grams.append(g)
            self.logs.append(np.log10(count - cut))
            self.contexts.append(context)
            sums, below = (total, escape, kinds), (g, count, cut)
        self.alphabet = len(self.grams[0])

    def predict(self, level: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its context."""
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        entered = np.zeros(len(gram), bool)
        above = np.zeros((len(gram), 4))
        for k in range(self.order, -1, -1):
            at = np.flatnonzero(open_ & (level >= k))
            if not len(at) or not len(self.contexts[k]):
                continue
            g = gram[at] & (1 << 8 * (k + 1)) - 1
            node = np.minimum(np.searchsorted(self.contexts[k], g >> 8), len(self.contexts[k]) - 1)
            there = self.contexts[k][node] == g >> 8
            at, node, g = at[there], node[there], g[there]
            i = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            seen = self.grams[k][i] == g
            was = entered[at]
            field = self.fields[k][node]
            total, escape = np.where(was, above[at, 3], field[:, 0]), np.where(was, above[at, 2], field[:, 1])
            out[at] += np.where(seen, self.logs[k][i] - total, escape)
            open_[at[seen]] = False
            entered[at] = True
            above[at] = field
        out[open_] -= np.log10(256 - self.alphabet) if self.alphabet < 256 else 0
        return out


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """level, gram, lp, stored: log10 of the probability of each gram (level, gram, n: in training texts) by the trie of those with n > 0.

    A stored table of grams is deleted, as all that comes before the result.
    """
    trie, discounts = trained(grams, order)
    parts = -(-trie.count() // PART_GRAMS) or 1
    near = min(NEAR, order)
    ending = F.pmod(F.hash(F.expr(f"shiftright(gram, 8) & {(1 << 8 * near) - 1}L")), F.lit(parts))
    long = F.col("level") >= near
    every = F.explode(F.when(long, F.array(ending)).otherwise(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = trie.select(F.col("level").alias("known_level"), F.col("gram").alias("known"), "n", every.alias("part"))  # its own names: both sides come from one table
    asked = grams.select("level", "gram", F.when(long, ending).otherwise(F.pmod(F.hash("gram"), F.lit(parts))).alias("part"))

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"level": pa.nulls(0, pa.int32()), "gram": pa.nulls(0, pa.int64()), "lp": pa.nulls(0, pa.float64())})
        level, gram = own.column("level").to_numpy(), own.column("gram").to_numpy()
        trie = Trie(*(held.column(c).to_numpy() if held.num_rows else np.zeros(0, np.int64) for c in ("known_level", "known", "n")), discounts)
        lp = [trie.predict(level[i : i + 200_000], gram[i : i + 200_000]) for i in range(0, len(gram), 200_000)]
        return pa.table({"level": level, "gram": gram, "lp": np.concatenate(lp)})

    coded = asked.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(run, "level int, gram long, lp double")
    coded = common.stored(coded, "coded")
    common.tidy(grams.sparkSession, trie)
    return coded


#: Rows that meet in a block, in this order.
GRAM, WORD, TEXT = 0, 1, 2


class Lookup:
    """Values of different numbers, not below 0, by open addressing: a place or two is read for a number, where a binary search reads twenty."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(numbers)).bit_length())  # half of the places stay free
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at, rest = self.home(numbers), np.arange(len(numbers))
        while len(rest):
            wanted = at[rest]
            free = self.keys[wanted] < 0
            self.keys[wanted[free]] = numbers[rest[free]]  # of several that want a place, one gets it
            got = self.keys[wanted] == numbers[rest]
            self.values[wanted[got]] = values[rest[got]]
            rest = rest[~got]
            at[rest] = self.after(at[rest])

    def home(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def of(self, numbers: np.ndarray) -> np.ndarray:
        at = self.home(numbers)
        rest = np.flatnonzero(self.keys[at] != numbers)
        while len(rest):
            at[rest] = self.after(at[rest])
            met = self.keys[at[rest]]
            if (met < 0).any():
                raise KeyError("a number that isn't listed")
            rest = rest[met != numbers[rest]]
        return self.values[at]


class Block:
    """What a block lists: code lengths of its grams and counts of its words."""

    def __init__(self, no: int | None) -> None:
        self.no, self.parts = no, {GRAM: [], WORD: []}

    def take(self, rows: pa.RecordBatch, kind: int) -> None:
        key = rows.column(2).to_numpy() if kind == GRAM else rows.column(4).cast(pa.large_binary())
        self.parts[kind].append((key, rows.column(3).to_numpy()))

    def close(self) -> None:
        """All rows but texts are here."""
        if self.parts:
            self.lengths = Lookup(*(np.concatenate([x[i] for x in self.parts[GRAM]]) for i in (0, 1)))
            self.words, self.c = pa.concat_arrays([x[0] for x in self.parts[WORD]]), np.concatenate([x[1] for x in self.parts[WORD]])
            self.parts = {}


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    cut = common.stored(blocks(docs, order), "blocks")
    words, listed = cut.where(F.col("word").isNotNull()).select("block", "word", "n"), cut.where(F.col("gram").isNotNull()).select("block", "gram", "n")
    texts = cut.where(F.col("text").isNotNull()).select("block", "doc_id", "text")
    counted = common.stored(words.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    sums = counted.where(F.col("c") > 0).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums.n, sums.v
    low = (1 << LEVEL) - 1
    grams = listed.groupBy("gram").agg(F.sum("n").alias("n")).select(F.shiftright("gram", LEVEL).cast("int").alias("level"), F.expr(f"gram & {low}L").alias("gram"), "n")
    coded = code_lengths(common.stored(grams, "grams"), order).select(F.expr(f"shiftleft(cast(level as long), {LEVEL}) | gram").alias("gram"), "lp")
    row = lambda df, kind, key, value, data: df.select("block", F.lit(kind).cast("byte").alias("kind"), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"), F.col(data).cast("binary").alias("data"))
    nothing = F.lit(None)
    grams_back = row(listed.select("block", "gram").join(coded, "gram").withColumn("no", nothing), GRAM, "gram", "lp", "no")
    words_back = row(words.select("block", "word").join(counted, "word").withColumn("no", nothing), WORD, "no", "c", "word")
    every = grams_back.unionByName(words_back).unionByName(row(texts.withColumn("no", nothing), TEXT, "doc_id", "no", "text"))

    def summed(block: Block, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        add = lambda x, to: np.add.reduceat(x, to[:-1])
        for batch in common.steps([rows], "data", common.STEP_BYTES):
            column, upto = tokens(*common.bytes_view(batch.column(4)))
            at = pc.index_in(column.dictionary, value_set=block.words).to_numpy()[column.indices.to_numpy()]
            lengths = []
            for piece in common.steps([batch], "data", STEP_BYTES // 4):
                data, bounds = common.bytes_view(piece.column(4))
                lengths.append(add(block.lengths.of(codes(data, bounds, order)), bounds))
            c = block.c[at]
            found.append((np.diff(upto), add((c > 0).astype(np.int64), upto), add(np.log10((c + 1) / (n + v + 1)), upto), np.concatenate(lengths)))
        of = [np.concatenate(x) for x in zip(*found, strict=True)]
        ids = rows.column(2)
        out = held_out(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        return common.record(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [ids, out, of[0], of[1], np.full(len(ids), n, np.int64), of[2], of[3]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(None)
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(kind) != 0))) if len(of) else []
            for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True):
                part = batch.slice(a, b - a)
                if of[a] != block.no:
                    block = Block(of[a])
                if kind[a] == TEXT:
                    block.close()
                    yield summed(block, part)
                else:
                    block.take(part, kind[a])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return every.repartition("block").sortWithinPartitions("block", "kind", "key").mapInArrow(common.lean(run), schema)


def op4_ppm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
