"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands inside no token of the vocabulary can never be merged over: a cut between its two bytes is
certain. Words are cut at all such pairs, the fragments are encoded independently (only the last one of a word carries
the word end), and their ids are joined. Equal runs of text are encoded once in a worker and spread to all occurrences.

Decoding joins the tokens' strings by one space, as the library does for a tokenizer file without a decoder.

Defined results: null and empty texts have no ids and decode to ""; rows are independent, so ties, repeated rows and
empty tables need nothing special; columns besides the id and the text don't matter to `digest`.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm import chunks, common

#: Runs a worker remembers; beyond that it starts anew (speed only).
MEMORY = 400_000


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """bytes -> ids as little-endian 32-bit integers, for runs without white space in front of more text."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def fresh(self, runs: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def ids(self, codes: pa.DictionaryArray) -> list[bytes]:
        runs = codes.dictionary.to_pylist()
        if len(self.known) > MEMORY:
            self.known.clear()
        found = list(map(self.known.get, runs))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self.fresh([runs[i] for i in missing]) if missing else [], strict=True):
            self.known[runs[i]] = found[i] = x
        return found


class ForcedSplit(Remembered):
    """The splitter and encoder for one tokenizer file."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = spec["model"]["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.closing = self.tokenizer.model
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joined = {t[i : i + 2] for t in (t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab) for i in range(len(t) - 1)}
        self.words: dict[str, bytes] = {}
        strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings, default=-1) + 1)]

    def fragments(self, word: str) -> list[str]:
        """A word (in the alphabet of the vocabulary) cut at all pairs that no token holds."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            *inner, last = self.fragments(word)
            ids = [t.id for f in inner for t in self.inner.tokenize(f)] + [t.id for t in self.closing.tokenize(last)]
            if len(self.words) > MEMORY // 2:
                self.words.clear()
            found = self.words[word] = np.asarray(ids, "<u4").tobytes()
        return found

    def plain(self, text: str) -> bytes:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return b"".join([self.word(w) for w, _ in t.pre_tokenizer.pre_tokenize_str(text)])

    def run(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return b"".join([self.special[x].to_bytes(4, "little") if x in self.special else self.plain(x) for x in self.cut.split(text) if x])

    def fresh(self, runs: list[bytes]) -> list[bytes]:
        return [self.run(r.decode()) for r in runs]


class Decimal:
    """Strings by id as an Arrow column, each with one space after it."""

    def __init__(self, strings: list[str]) -> None:
        self.column = pa.array([(s + " ").encode() for s in strings], pa.large_binary())


_loaded: dict[str, tuple[ForcedSplit, Decimal, Decimal]] = {}


def loaded(path: str) -> tuple[ForcedSplit, Decimal, Decimal]:
    """Once in each worker."""
    if path not in _loaded:
        split = ForcedSplit(path)
        _loaded[path] = split, Decimal([str(i) for i in range(len(split.strings))]), Decimal(split.strings)
    return _loaded[path]


def forget() -> None:
    """Drop what was remembered of texts; the vocabulary stays."""
    for split, *_ in _loaded.values():
        split.known.clear()
        split.words.clear()


def _texts(ids: list[bytes], strings: Decimal, codes: pa.DictionaryArray) -> tuple[memoryview, np.ndarray]:
    """The strings of the ids of all pieces, joined, and each piece's bounds."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([0, *map(len, ids)]) // 4
    data, bounds = chunks.data_of(strings.column.take(pa.array(flat)))
    out, at = chunks.data_of(chunks.binaries(data, bounds[ends]).take(codes.indices))
    return memoryview(out), at


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids array<int> of each whole text. One pass, no shuffle."""
    common.ship(docs.sparkSession)
    path = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = loaded(path)[0]
        for batch in common.steps(batches):
            codes, at = chunks.pieces(*common.bytes_view(batch.column(1)))
            data, bounds = chunks.spread(split.ids(codes), codes)
            flat = np.frombuffer(data.tobytes(), "<i4")
            yield common.record(["doc_id", "ids"], [batch.column(0), pa.ListArray.from_arrays(pa.array((bounds[at] // 4).astype(np.int32)), pa.array(flat))])

    return common.id_text(docs, id_column, text_column).mapInArrow(common.lean(run, forget), "doc_id long, ids array<int>")


def decode(table: DataFrame, ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """The table's doc_id with the text of its ids; null has the empty text, an id outside the vocabulary an empty string in its place."""
    common.ship(table.sparkSession)
    path = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = loaded(path)[0].strings
        for batch in batches:
            texts = [" ".join([strings[i] if i is not None and 0 <= i < len(strings) else "" for i in x or []]) for x in batch.column(1).to_pylist()]
            yield common.record(["doc_id", "text"], [batch.column(0), pa.array(texts, pa.string())])

    return table.select("doc_id", ids_column).mapInArrow(common.lean(run, forget), "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    common.ship(docs.sparkSession)
    path = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, decimal, strings = loaded(path)
        for batch in common.steps(batches):
            codes, at = chunks.pieces(*common.bytes_view(batch.column(1)))
            ids = split.ids(codes)
            count = np.cumsum(np.append(0, (np.array([len(x) for x in ids], np.int64) // 4)[codes.indices.to_numpy()] if len(codes) else []).astype(np.int64))
            out = []
            for table in (decimal, strings):
                data, bounds = _texts(ids, table, codes)
                ends = bounds[at].tolist()
                out.append([hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)])  # without the last space
            yield common.record(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [batch.column(0), np.diff(count[at]), *out])

    return common.id_text(docs).mapInArrow(common.lean(run, forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_forced_split_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
