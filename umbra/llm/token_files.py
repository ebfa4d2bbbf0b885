"""Token ids in bit-packed binary files.

File: the 8 bytes "UMBRAIDS", then little-endian unsigned 64-bit integers: bits of an id, ids of a block, documents,
ids; then for each document its id and its number of ids (signed 64-bit; a null id is 0 with the number below zero), for each block its byte offset from the start
of the blocks (unsigned 64-bit), then the blocks. A block holds its ids at the fixed width, lowest bit first, padded to
whole bytes, so any id is found from its block's offset alone.

Files hold documents in ascending doc_id order (null first, equal ids in the order of the first pass), rolled over at a bounded
number of ids. They are written under a name of the attempt and then renamed, with the same content in each attempt.

Defined results: null and empty texts have the end id alone; repeated rows are stored as often as they occur; no rows
give no files and no rows; columns besides the id and the text don't matter.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import bpe, chunks, common
from umbra.llm.decontaminate import LOWER

MAGIC = b"UMBRAIDS"
BLOCK_IDS = 4096
#: Ids of a file, unless one document alone has more.
FILE_IDS = 4_000_000


def width(vocabulary: int) -> int:
    """The fewest bits that hold all ids below the vocabulary's size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below 2**32) at a fixed width, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, count: int) -> np.ndarray:
    """`count` ids as unsigned 32-bit integers: each is cut out of the 8 bytes that it starts in."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    if bits in (8, 16, 32):
        return np.frombuffer(raw.tobytes(), f"<u{bits // 8}", count).astype("<u4")
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.arange(count, dtype=np.int64) * bits
    words = np.zeros(count, np.uint64)
    for k in range(5):
        words |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def file_bytes(docs: list[tuple[int, int]], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file: docs has (doc_id, number of ids) in order, (0, -number) without a doc_id."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    head = np.array([bits, block, len(docs), len(ids)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array(docs, "<i8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class File:
    """A reader over the bytes of one file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.bits, self.block, n, self.n_ids = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        self.docs = np.frombuffer(data, "<i8", 2 * n, 40).reshape(n, 2)
        blocks = -(-self.n_ids // self.block) if self.n_ids else 0
        self.offsets = np.frombuffer(data, "<u8", blocks, 40 + 16 * n).astype(np.int64)
        self.raw = np.frombuffer(data, np.uint8, offset=40 + 16 * n + 8 * blocks)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            at = self.offsets[b]
            parts.append(unpack(self.raw[at : at + (count * self.bits + 7) // 8], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class Library:
    """The library's own encoding of a step's different runs, in few calls.

    No token of the library's reaches over white space, so each different run between spaces is encoded once. Runs of
    plain letters with punctuation behind are cut there, as the library's pattern does; their words go to its model
    alone (lower-cased, all letters of one code page, so that its normaliser has nothing else to do), joined by spaces,
    and the tokens that end a word tell where one ends. Other runs go through the whole library, joined by a byte 0, which
    is a token of its own between spaces.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(vocabulary.values()) + 1
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        mark = self._ids(self.whole, "\0")
        self.mark = mark[0] if len(mark) == 1 and self.ends[mark[0]] else None

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different plain words, and where each word's end."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        data, bounds = common.bytes_view(words)
        ids = np.array(self._ids(self.model, b" ".join(words.to_pylist()).decode()), "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(ends) != len(words) + 1:
            raise ValueError("the vocabulary doesn't mark the ends of words")
        return ids, ends

    def others(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any runs."""
        alone = np.array([self.mark is None or b"\0" in r for r in runs], bool)
        joined = [r.decode() for r, a in zip(runs, alone.tolist(), strict=True) if not a]
        parts = []
        for i in range(0, len(joined), 20_000):
            own = joined[i : i + 20_000]
            ids = np.array(self._ids(self.whole, " \0 ".join(own)), "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(own) - 1:
                raise ValueError("a run has the mark's token")
            parts += np.split(np.delete(ids, at), at - np.arange(len(at)))
        each = iter(parts)
        out = [np.array(self._ids(self.whole, r.decode()), "<u4") if a else next(each) for r, a in zip(runs, alone.tolist(), strict=True)]
        return np.concatenate([np.zeros(0, "<u4"), *out]), np.cumsum([0, *map(len, out)])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end."""
        codes, at = chunks.pieces(data, bounds)
        if not len(codes):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        runs, ends = chunks.data_of(codes.dictionary)
        runs = runs[: ends[-1]]
        first, last = ends[:-1], ends[1:]
        core = _last(~chunks.SPACE[runs], first, last)
        stem = _last(~_TAIL[runs], first, core)
        lead = np.concatenate([[0], runs[:-1]])
        plain = _LETTER[runs] | ((runs == 0xC3) & _AFTER[np.append(runs[1:], 0)]) | (_AFTER[runs] & (lead == 0xC3))
        other = np.concatenate([[0], np.cumsum(~plain)])
        easy = (stem > first) & (other[stem] == other[first])
        lower = np.where(_AFTER[runs] & (runs < 0x9F), runs + 32, LOWER[runs])
        # The parts of different runs: plain words, what stands behind them, and all other runs whole.
        heads = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(easy.sum()), [None, pa.py_buffer(_offsets(first[easy], stem[easy])), pa.py_buffer(lower[_within(first[easy], stem[easy])])]).dictionary_encode()
        raw = runs.tobytes()
        tails = pa.array([raw[a:b] for a, b in zip(stem[easy].tolist(), core[easy].tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        rest = [raw[a:b] for a, b in zip(first[~easy].tolist(), core[~easy].tolist(), strict=True)]
        known = [self.words(heads.dictionary), self.others(tails.dictionary.to_pylist()), self.others(rest)]
        base = np.cumsum([0, *(len(e) - 1 for _, e in known)])
        ids = np.concatenate([i for i, _ in known])
        begin = np.concatenate([e[:-1] + o for (_, e), o in zip(known, np.cumsum([0, *(len(i) for i, _ in known)]), strict=False)])
        size = np.concatenate([np.diff(e) for _, e in known])
        part = np.zeros((len(first), 2), np.int64)
        part[easy, 0], part[easy, 1] = heads.indices.to_numpy(), tails.indices.to_numpy() + base[1]
        part[~easy, 0], part[~easy, 1] = np.arange(len(rest)) + base[2], len(size)
        begin, size = np.append(begin, 0), np.append(size, 0)
        of_runs = part[codes.indices.to_numpy()].ravel()
        place = np.concatenate([[0], np.cumsum(size[of_runs])])
        return ids[_within(begin[of_runs], begin[of_runs] + size[of_runs])], place[2 * at]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Second bytes of the letters from U+00C0 to U+00FF.
_AFTER = np.zeros(256, bool)
_AFTER[0x80:0xC0] = True
_AFTER[[0x97, 0xB7]] = False
#: Punctuation that is cut off behind a letter.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True


def _last(holds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Behind the last place of each stretch first..last where `holds` is true; its start if there is none."""
    at = np.arange(1, len(holds) + 1)
    seen = np.concatenate([[0], np.maximum.accumulate(np.where(holds, at, 0))])
    return np.maximum(seen[last], first)


def _offsets(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)


def _within(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0]-1, first[1] .. last[1]-1, ..."""
    size = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    """Once in each worker."""
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]


def vocabulary_size(path: str) -> int:
    """The ids that the tokenizer file knows, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


def encode(docs: DataFrame, path: str, bits: int, end_id: int) -> DataFrame:
    """doc_id, seq, n_tokens, packed: the ids of each whole text and the end id, packed."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = library(path), np.array([end_id], "<u4")
        for batch in common.steps(batches, "text", 8 << 20):
            ids, ends = own.encode(*common.bytes_view(batch.column(1)))
            ends = ends.tolist()
            packed = [pack(np.concatenate([ids[a:b], end]), bits) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield common.record(["doc_id", "n_tokens", "packed"], [batch.column(0), np.diff(ends).astype(np.int64) + 1, pa.array(packed, pa.binary())])

    return common.id_text(docs).mapInArrow(common.lean(run), "doc_id long, n_tokens long, packed binary").withColumn("seq", F.monotonically_increasing_id())


def write(encoded: DataFrame, folder: str, bits: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files of `encoded` (a stored table) into the folder; part, file, path, n_docs, n_ids and base (ids before it) of each."""
    spark = encoded.sparkSession
    total = encoded.agg(F.sum("n_tokens").alias("n")).first().n or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // file_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        part, number, docs, arrays, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/ids-{part:06d}-{number:06d}.bin"
            attempt = f"{root}/.{uuid.uuid4().hex}"
            with place.open_output_stream(attempt) as out:
                out.write(file_bytes(docs, np.concatenate(arrays), bits))
            place.move(attempt, name)
            return common.record(["part", "file", "name", "n_docs", "n_ids"], [pa.array([part], pa.int32()), pa.array([number], pa.int32()), [name.rpartition("/")[2]], pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())])

        for batch in batches:
            for doc, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append((doc, n) if doc is not None else (0, -n))
                arrays.append(unpack(packed.as_buffer(), bits, n))
                held += n
                if held >= file_ids:
                    yield flush()
                    number, docs, arrays, held = number + 1, [], [], 0
        if docs:
            yield flush()

    ordered = encoded.repartitionByRange(parts, "doc_id", "seq").sortWithinPartitions("doc_id", "seq").select("doc_id", "n_tokens", "packed")
    files = common.stored(ordered.mapInArrow(common.lean(run), "part int, file int, name string, n_docs long, n_ids long"), "manifest")
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as partitions
    bases = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0).cast("long"))).join(bases, "part")
    return based.withColumn("base", F.col("base") + F.col("before")).drop("before")


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files."""
    spark = manifest.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with place.open_input_file(f"{root}/{name}") as f:
                    file = File(f.read())
                ends = np.cumsum(np.abs(file.docs[:, 1]))
                for i in range(0, len(ends), 5_000):
                    j = min(len(ends), i + 5_000)
                    first = int(ends[i - 1]) if i else 0
                    ids = file.ids(first, int(ends[j - 1]))
                    at = np.append(first, ends[i:j]) - first
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = [pa.array(file.docs[i:j, 0].copy(), mask=file.docs[i:j, 1] < 0), pa.array(at[:-1] + first + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4"))))
                    yield common.record(["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)], columns)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("name", "base").repartition(parts).mapInArrow(common.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op3_packed_token_files(spark, sf_dir: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    path = path or bpe.vocabulary_file()
    docs, bits = spark.read.parquet(f"{sf_dir}/documents.parquet"), width(vocabulary_size(path))
    encoded = common.stored(encode(docs, path, bits, end_id), "encoded")
    folder = common.scratch(spark, "ids")
    return read(write(encoded, folder, bits), folder)
