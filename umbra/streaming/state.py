"""Streams with state by key: replies that come in chunks, and sessions whose placeholders stay the same.

Both are StatefulProcessors: a key's state is in the state store (RocksDB), a timer by processing time ends it, and the
mapping that a job begins with is the initial state. Rows of a micro-batch are taken in the order of their numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from umbra import workers
from umbra.functions import patterns, scan

#: The beginning of a placeholder at the end of a chunk, which waits for the next one.
HELD = re.compile(r"<[A-Z0-9_]*\Z")
PLACEHOLDER = re.compile(patterns.PLACEHOLDER)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Characters of a reply that the guard sees again with the next chunk.
WINDOW = 1024
DAY_MS = 24 * 3_600_000


def advance(rest: str, text: str, done: bool) -> tuple[str, str]:
    """(what may go out now, what waits) when `text` follows what waited."""
    whole = rest + text
    held = None if done else HELD.search(whole)
    return (whole[: held.start()], whole[held.start() :]) if held else (whole, "")


def leaks(text: str) -> bool:
    """Whether a text holds a key of a known format or a private key's marker."""
    spans, error = scan.rules(text, SECRETS)
    return bool(error or spans)


SECRETS = [r for r in patterns.RULES if r.label == "CREDENTIAL" and r.rule_id != "token_like"] + [patterns.PRIVATE_KEY]


class _Timed(StatefulProcessor):
    """State that ends `ttl_ms` after its last use."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def used(self, timer_values) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def close(self) -> None:
        pass


class Reply(_Timed):
    """A reply's chunks with placeholders filled in, watched by a guard over chunk ends."""

    COLUMNS = ("stream_id", "chunk_no", "status", "text")

    def __init__(self, ttl_ms: int, guarded: bool) -> None:
        super().__init__(ttl_ms)
        self.guarded = guarded

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.at = handle.getValueState("at", "rest string, tail string, last long, blocked boolean")
        self.values = handle.getMapState("values", "placeholder string", "original_value string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for p, v in zip(initialState["placeholder"], initialState["original_value"], strict=True):
            self.values.updateValue((p,), (v,))
        self.used(timerValues)

    def filled(self, text: str) -> str:
        return PLACEHOLDER.sub(lambda m: self.values.getValue((m[0],))[0] if self.values.containsKey((m[0],)) else m[0], text)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, tail, last, blocked = self.at.get() if self.at.exists() else ("", "", None, False)
        every = pd.concat(list(rows))
        out = []
        for no, text, done in sorted(zip(every["chunk_no"].tolist(), every["text"].tolist(), every["done"].tolist(), strict=True), key=lambda r: r[0]):
            if last is not None and no <= last:
                out.append((key[0], no, "repeated", None))
                continue
            last = no
            if not blocked:
                safe, rest = advance(rest, text or "", bool(done))
                blocked = self.guarded and leaks(tail + safe)
                tail = (tail + safe)[-WINDOW:]
            out.append((key[0], no, "blocked" if blocked else "ok", None if blocked else self.filled(safe)))
        self.at.update((rest, tail, last, blocked))
        self.used(timerValues)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, _, last, blocked = self.at.get() if self.at.exists() else ("", "", None, False)
        self.at.clear()
        self.values.clear()
        out = [] if last is None else [(key[0], last, "expired", None if blocked else self.filled(rest))]
        yield pd.DataFrame(out, columns=self.COLUMNS)


def _ready(spark) -> None:
    """Give executors this package and keep state in RocksDB, which state of this kind needs."""
    workers.ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def refill_stream(chunks: DataFrame, mapped: DataFrame, ttl_ms: int = DAY_MS, guarded: bool = True) -> DataFrame:
    """stream_id, chunk_no, status, text of a stream of chunks (stream_id, chunk_no, text, done).

    The start of a placeholder at a chunk's end waits for the next chunk, unless `done` is true. Unknown placeholders stay
    as they are. status: ok; repeated (a number not above the last one of an earlier row: nothing goes out again); blocked
    (the guard saw a secret, over chunk ends too: from there on nothing goes out); expired (no chunk came for ttl_ms: what
    waited goes out under the last number, and the state ends). mapped: stream_id, placeholder, original_value, a table.
    """
    _ready(chunks.sparkSession)
    rows = chunks.select("stream_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("text").cast("string").alias("text"), F.col("done").cast("boolean").alias("done"))
    kind = chunks.schema["stream_id"].dataType.simpleString()
    start = mapped.select("stream_id", "placeholder", "original_value").groupBy("stream_id")
    return rows.groupBy("stream_id").transformWithStateInPandas(Reply(ttl_ms, guarded), f"stream_id {kind}, chunk_no long, status string, text string", "append", "processingTime", start)


class Session(_Timed):
    """Texts of a namespace with the same placeholder for the same value in all of them."""

    COLUMNS = ("namespace", "seq", "masked_text", "late", "placeholders")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.names = handle.getMapState("names", "prefix string, value string", "placeholder string, label string")
        self.counts = handle.getMapState("counts", "prefix string", "n long")
        self.last = handle.getValueState("last", "seq long")

    def count(self, prefix: str) -> int:
        return self.counts.getValue((prefix,))[0] if self.counts.containsKey((prefix,)) else 0

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for p, label, v in zip(initialState["placeholder"], initialState["label"], initialState["original_value"], strict=True):
            prefix, _, number = p[1:-1].rpartition("_")
            self.names.updateValue((prefix, v), (p, label))
            self.counts.updateValue((prefix,), (max(self.count(prefix), int(number)),))
        self.used(timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {tuple(k): tuple(v) for k, v in self.names.iterator()}
        last = self.last.get()[0] if self.last.exists() else None
        every = pd.concat(list(rows))
        out = []
        for seq, text in sorted(zip(every["seq"].tolist(), every["text"].tolist(), strict=True), key=lambda r: r[0]):
            late = last is not None and seq <= last
            if isinstance(text, str):
                found, error = scan.rules(text, (*patterns.RULES, patterns.PRIVATE_KEY))
                again = [scan.Span(m.start(), m.end(), label, 1.0, "session_mapping", canonical_value=v) for (_, v), (_, label) in known.items() if len(v) >= 2 for m in re.finditer(re.escape(v), text)]
                spans = [] if error else scan.fuse(text, [*found, *again])
                puts = []
                for s in spans:
                    owner = patterns.PREFIXES.get(s.label, s.label), text[s.start : s.end]
                    if owner not in known:
                        n = self.count(owner[0]) + 1
                        self.counts.updateValue((owner[0],), (n,))
                        known[owner] = f"<{owner[0]}_{n:03d}>", s.label
                        self.names.updateValue(owner, known[owner])
                    puts.append((s.start, s.end, known[owner][0]))
                out.append((key[0], seq, None if error else scan.replaced(text, puts), late, len({p for _, _, p in puts})))
            else:
                out.append((key[0], seq, None, late, 0))
            last = seq if last is None else max(last, seq)
        self.last.update((last,))
        self.used(timerValues)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.names, self.counts, self.last):
            state.clear()
        yield pd.DataFrame([], columns=self.COLUMNS)


class Values(_Timed):
    """Placeholders of values that a namespace declares one by one."""

    COLUMNS = ("namespace", "seq", "surface", "placeholder", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.names = handle.getMapState("names", "prefix string, value string", "placeholder string")
        self.counts = handle.getMapState("counts", "prefix string", "n long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = self.last.get()[0] if self.last.exists() else None, []
        every = pd.concat(list(rows))
        for seq, label, value in sorted(zip(every["seq"].tolist(), every["label"].tolist(), every["surface"].tolist(), strict=True), key=lambda r: r[0]):
            prefix = patterns.PREFIXES.get(label, label)
            if not self.names.containsKey((prefix, value)):
                n = (self.counts.getValue((prefix,))[0] if self.counts.containsKey((prefix,)) else 0) + 1
                self.counts.updateValue((prefix,), (n,))
                self.names.updateValue((prefix, value), (f"<{prefix}_{n:03d}>",))
            out.append((key[0], seq, value, self.names.getValue((prefix, value))[0], last is not None and seq <= last))
            last = seq if last is None else max(last, seq)
        self.last.update((last,))
        if self.ttl_ms:
            self.used(timerValues)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.names, self.counts, self.last):
            state.clear()
        yield pd.DataFrame([], columns=self.COLUMNS)


def mask_values(values: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """namespace, seq, surface, placeholder, late of a stream of values (namespace, seq, label, surface); without ttl_ms sessions don't end."""
    _ready(values.sparkSession)
    kind = values.schema["namespace"].dataType.simpleString()
    rows = values.select("namespace", F.col("seq").cast("long").alias("seq"), "label", "surface")
    return rows.groupBy("namespace").transformWithStateInPandas(Values(ttl_ms or 0), f"namespace {kind}, seq long, surface string, placeholder string, late boolean", "append", "processingTime" if ttl_ms else "none")


def mask_sessions(texts: DataFrame, persisted: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """namespace, seq, masked_text, late, placeholders of a stream of texts (namespace, seq, text).

    Rules and values that the namespace already knows are replaced; a value has one placeholder as long as the session
    lives, that is until ttl_ms pass without a text. late: a seq not above the last one; the text is masked all the same. A
    text with a badly framed private key, and a null one, give none. persisted (namespace, placeholder, label,
    original_value), a table checked by sessions.hydrate, is what sessions begin with.
    """
    _ready(texts.sparkSession)
    rows = texts.select("namespace", F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
    kind = texts.schema["namespace"].dataType.simpleString()
    start = persisted.select("namespace", "placeholder", "label", "original_value").groupBy("namespace")
    return rows.groupBy("namespace").transformWithStateInPandas(Session(ttl_ms), f"namespace {kind}, seq long, masked_text string, late boolean, placeholders int", "append", "processingTime", start)
