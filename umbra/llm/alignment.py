"""Cross-tokenizer alignment by per-byte label strings: which tokens of one tokenizer cover the same bytes as which of another.

Each byte of a space and the text gets a label: none, end of an A token, end of a B token, both. A regular expression
scans the label string for spans up to each `both`; the A and B labels of a span count the tokens of a group.

Texts are cut before a space that follows a character other than white space. Both tokenizers always end a token there
(A's pattern takes a space only in front, and no piece of B holds a space after another character, which is checked),
so each different run is encoded once in a worker's memory, and runs' alignments joined are the text's.

A link is a pair of tokens that end together. One of the two then holds the other's bytes at its end, so the pairs that
can ever occur are bounded by the vocabularies: each token's suffixes that are tokens of the other one, some hundred
thousand pairs. Their counts are therefore summed by Spark and broadcast, whatever the corpus.

Defined results: null and empty texts, and texts that one of the two doesn't give back byte by byte, have zeros and an
empty groups_sha256; rows are independent, so ties, repeated rows and empty tables need nothing special; columns besides
the id and the text don't matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm import bpe, chunks, common

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of new runs that are given to a tokenizer as one string.
CALL_BYTES = 1 << 15
#: The labels of a byte; the scan ends a span at each BOTH.
NONE, A_END, B_END, BOTH = b"nabx"
SPAN = re.compile(b"[^x]*x")
#: Links of which a task sums up the counts at a time.
COUNTED = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """The bytes of each token of a vocabulary, and decimal strings of its ids with what may follow them."""

    def __init__(self, tokens: list[bytes], last: str) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.n = len(tokens)
        self.decimal = pa.array([f"{i}{end}".encode() for end in ("," + last) for i in range(self.n)], pa.large_binary())


class Pair:
    """Both tokenizers, and what a worker remembers of runs."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, strings = byte_alphabet(), {i: t for t, i in known.items()}
        at = Table([bytes(letters.get(c, 63) for c in strings.get(i, "")) for i in range(max(strings) + 1)], "|")
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space after another character: runs can't be encoded one by one")
        single = re.compile("<0x([0-9A-F]{2})>")
        bt = Table([bytes([int(m[1], 16)]) if (m := single.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces], ";")
        self.tables = at, bt
        self.space = self.b.piece_to_id("▁")
        self.known: dict[bytes, tuple] = {}

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of strings that begin with a space."""
        return [e.ids for e in self.a.encode_batch(runs, add_special_tokens=False)], [self.b.encode(r[1:], num_threads=1) if len(r) > 1 else [self.space] for r in runs]

    def joined(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all runs, and which runs come back byte by byte; of the others there are no ids."""
        groups, size = [[]], 0
        for i, r in enumerate(runs):
            if size + len(r) > CALL_BYTES or r.endswith(b" ") or (groups[-1] and runs[i - 1].endswith(b" ")):
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += len(r)
        ids: tuple[list, list] = ([], [])
        good = np.ones(len(runs), bool)
        strings = [b"".join(g) for g in groups if g]
        at = 0
        for g, whole, *both in zip([g for g in groups if g], strings, *self.encode([s.decode() for s in strings]), strict=True):
            if self.same(whole, *both):
                ids[0].extend(both[0])
                ids[1].extend(both[1])
            else:
                for k, (r, *own) in enumerate(zip(g, *self.encode([x.decode() for x in g]), strict=True)):
                    good[at + k] = self.same(r, *own)
                    if good[at + k]:
                        ids[0].extend(own[0])
                        ids[1].extend(own[1])
            at += len(g)
        return np.array(ids[0], np.int64), np.array(ids[1], np.int64), good

    def same(self, whole: bytes, *ids: list[int]) -> bool:
        return all(chunks.data_of(t.tokens.take(pa.array(x, pa.int64())))[0].tobytes() == whole for t, x in zip(self.tables, ids, strict=True))

    def learn(self, runs: list[bytes]) -> None:
        """Remember of each run: its groups as text, numbers of A tokens, B tokens and groups, and its links; None if it doesn't come back."""
        a, b, good = self.joined(runs)
        at, bt = self.tables
        fine = [r for r, ok in zip(runs, good, strict=True) if ok]
        a_end, b_end = np.cumsum(at.sizes[a]), np.cumsum(bt.sizes[b])
        labels = np.full(sum(map(len, fine)), NONE, np.uint8)
        labels[a_end - 1] = A_END
        shared = labels[b_end - 1] == A_END
        labels[b_end - 1] = np.where(shared, BOTH, B_END)
        span_end = np.array([m.end() for m in SPAN.finditer(labels.tobytes())], np.int64)
        # Counts of labels up to each span's end are counts of tokens.
        a_to = np.cumsum((labels == A_END) | (labels == BOTH))[span_end - 1] if len(span_end) else span_end
        b_to = np.cumsum((labels == B_END) | (labels == BOTH))[span_end - 1] if len(span_end) else span_end
        links = a[a_to - 1] * bt.n + b[b_to - 1] if len(span_end) else span_end
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_to - 1], last_b[b_to - 1] = 1, 1
        strings, bounds = chunks.data_of(pa.concat_arrays([at.decimal.take(pa.array(a + at.n * last_a)), bt.decimal.take(pa.array(b + bt.n * last_b))]))
        of = np.concatenate([np.repeat(np.arange(len(a_to)), np.diff(a_to, prepend=0)) * 2, np.repeat(np.arange(len(b_to)), np.diff(b_to, prepend=0)) * 2 + 1])
        text, ends = chunks.data_of(chunks.binaries(strings, bounds).take(pa.array(np.argsort(of, kind="stable"))))
        run_end = np.cumsum([len(r) for r in fine]).astype(np.int64)
        group = np.searchsorted(span_end, run_end, side="right")  # groups up to the end of each run
        tokens_a, tokens_b = np.append(0, a_to)[group], np.append(0, b_to)[group]
        text_end = ends[tokens_a + tokens_b]
        flat, link_bytes = memoryview(text), memoryview(links.astype(self.dtype).tobytes())
        width, found = self.dtype.itemsize, {}
        g0 = t0 = a0 = b0 = 0
        for r, g, t, x, y in zip(fine, group.tolist(), text_end.tolist(), tokens_a.tolist(), tokens_b.tolist(), strict=True):
            found[r] = bytes(flat[t0:t]), x - a0, y - b0, g - g0, bytes(link_bytes[g0 * width : g * width])
            g0, t0, a0, b0 = g, t, x, y
        for r in runs:
            self.known[r] = found.get(r)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u4" if self.tables[0].n * self.tables[1].n < 1 << 32 else "<u8")

    def of(self, runs: list[bytes]) -> list[tuple]:
        if len(self.known) > bpe.MEMORY:
            self.known.clear()
        missing = [r for r in runs if r not in self.known]
        if missing:
            self.learn(missing)
        return [self.known[r] for r in runs]


_loaded: dict[tuple[str, str], Pair] = {}


def loaded(a_path: str, b_path: str) -> Pair:
    """Once in each worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path)
    return _loaded[a_path, b_path]


def forget() -> None:
    for pair in _loaded.values():
        pair.known.clear()


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Each text (with its space in front) cut before spaces that follow no white space, and the number of runs before each text."""
    b1, b2, b3 = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) > k else np.zeros(len(data), np.uint8) for k in (1, 2, 3))
    # Bytes that may end white space of any alphabet; a cut left out only makes a run longer.
    white = (b1 <= 32) | ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80)) | ((b3 == 0xE1) & ((b2 == 0x9A) | (b2 == 0xA0)))
    begins = (data == 32) & ~white
    begins[bounds[:-1]] = True
    at = np.flatnonzero(begins)
    return chunks.binaries(data, np.append(at, len(data))).dictionary_encode(), np.searchsorted(at, bounds)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (a1,a2|b1;...), links (A id * B's vocabulary + B id of each link, little-endian) of each whole text. One pass, no shuffle."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(a_path, b_path)
        for batch in common.steps(batches):
            data, bounds = common.bytes_view(batch.column(1))
            spaced = np.insert(data, bounds[:-1], 32)
            codes, at = runs(spaced, bounds + np.arange(len(bounds)))
            found = pair.of(codes.dictionary.to_pylist())
            which = codes.indices.to_numpy()
            bad = np.array([x is None for x in found], bool)[which]
            none = (np.diff(np.append(0, np.cumsum(bad))[at]) > 0) | (np.diff(bounds) == 0)
            empty = b"", 0, 0, 0, b""
            found = [x or empty for x in found]
            sums = []
            for k in (1, 2, 3):
                total = np.append(0, np.cumsum(np.array([x[k] for x in found], np.int64)[which]))
                sums.append(np.where(none, 0, np.diff(total[at])))
            texts = []
            for k in (0, 4):
                flat, ends = chunks.data_of(pa.array([x[k] for x in found], pa.large_binary()).take(codes.indices))
                first, last = ends[at[:-1]].tolist(), ends[at[1:]].tolist()
                flat = memoryview(flat)
                texts.append([b"" if no else bytes(flat[x : y - (k == 0)]) for no, x, y in zip(none.tolist(), first, last, strict=True)])  # groups without the last ;
            yield common.record(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"], [batch.column(0), *sums, sums[2], pa.array(texts[0], pa.binary()), pa.array(texts[1], pa.binary())])

    return common.id_text(docs, id_column, text_column).mapInArrow(common.lean(run, forget), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, links binary")


def link_counts(found: DataFrame, dtype: np.dtype) -> DataFrame:
    """link, n: how often each pair of tokens is linked in all documents. At most as many rows as the vocabularies allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        totals = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([totals[0], *held])
            n = np.concatenate([totals[1], np.ones(len(keys) - len(totals[0]), np.int64)])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, n, len(unique)).astype(np.int64)  # exact up to 2^53

        for batch in batches:
            data, _ = common.bytes_view(batch.column(0))
            held.append(np.frombuffer(data.tobytes(), dtype).astype(np.int64))
            size += len(held[-1])
            if size >= COUNTED:
                totals, held, size = summed(), [], 0
        totals = summed()
        yield common.record(["link", "n"], list(totals))

    return found.select("links").mapInArrow(common.lean(run), "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def scored(found: DataFrame, counts: DataFrame, b_size: int, dtype: np.dtype) -> DataFrame:
    """found with n_best and count_sum, without links. counts is held by each worker: its size is bounded by the vocabularies."""
    best = F.max("n").over(Window.partitionBy(F.col("link") % b_size))
    table = counts.select("link", "n", (F.col("n") == best).alias("best")).orderBy("link").toArrow()
    shared = found.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("link", "n", "best")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts, is_best = shared.value
        for batch in common.steps(batches, "links"):
            data, bounds = common.bytes_view(batch.column(batch.schema.get_field_index("links")))
            at = np.searchsorted(links, np.frombuffer(data.tobytes(), dtype).astype(np.int64))
            ends = bounds // dtype.itemsize
            sums = [np.diff(np.append(0, np.cumsum(x[at].astype(np.int64)))[ends]) for x in (is_best, counts)]
            yield common.record([*names, "n_best", "count_sum"], [*(batch.column(batch.schema.get_field_index(n)) for n in names), *sums])

    return found.select(*names, "links").mapInArrow(common.lean(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each whole text."""
    paths = a_path or bpe.vocabulary_file(A_FILE), b_path or bpe.vocabulary_file(B_FILE)
    pair = loaded(*paths)
    dtype, b_size = pair.dtype, pair.tables[1].n
    digest = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = common.stored(aligned(docs, *paths, id_column, text_column).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "aligned")
    counts = common.stored(link_counts(found, dtype), "links")
    return scored(found, counts, b_size, dtype).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
