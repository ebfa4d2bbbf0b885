"""Streams against batches and folds by hand: chunked replies, a guard over chunk ends, sessions, timers that end both."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from umbra.streaming import sessions, state

CHUNK = "stream_id string, chunk_no long, text string, done boolean"
MAPPED = "stream_id string, placeholder string, original_value string"


def folded(rows, values):
    """stream_id, chunk_no, text by a loop over each stream's chunks."""
    out = {}
    for s in {r[0] for r in rows}:
        rest, own = "", sorted(r for r in rows if r[0] == s)
        for i, (_, no, text, *_) in enumerate(own):
            safe, rest = state.advance(rest, text or "", i == len(own) - 1)
            out[s, no] = re.sub(r"<[A-Z][A-Z0-9_]*_\d{3,}>", lambda m: values.get((s, m[0]), m[0]), safe)  # noqa: B023
    return out


def collected(spark, frame, tmp_path, enough, name, seconds=90):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        until = time.time() + seconds
        while time.time() < until:
            rows = spark.table(name).collect()
            assert query.exception() is None
            if enough(rows):
                return rows
            time.sleep(0.3)
        raise AssertionError(f"{len(rows)} rows after {seconds} s")
    finally:
        query.stop()


def stream_of(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_chunks_by_hand(spark):
    rng = random.Random(1)
    parts = ["<", "<ORG", "_001>", "<ORG_001>", "G_00", "x ", ">", "<P_", "002", "A", "", "<<", "é<O"]
    rows = [(f"s{s}", n * 3, rng.choice(parts) + rng.choice(parts), None) for s in range(60) for n in range(rng.randint(1, 9))] + [("null", 1, None, None), ("null", 2, "<ORG_001", None)]
    values = {(f"s{s}", p): v for s in range(60) for p, v in (("<ORG_001>", "甲"), ("<P_002>", "<ORG_001>")) if s % 3}
    mapped = spark.createDataFrame([(s, p, v) for (s, p), v in values.items()], MAPPED)
    got = {(r.stream_id, r.chunk_no): r.text for r in sessions.refill_chunks(spark.createDataFrame(rows, CHUNK).repartition(3), mapped).collect()}
    assert got == folded(rows, values)


def test_stream_equals_batch_over_conversations(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12").select(F.col("conv_id").cast("string"), "turn", "text").collect()
    rows, values = [], {}
    for conv in sorted({r.conv_id for r in turns}):
        whole = " ".join(f"{r.text or ''} <ORG_{r.turn % 3 + 1:03d}>!" for r in sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.turn))
        values |= {(conv, f"<ORG_{k:03d}>"): f"名{conv}-{k}" for k in (1, 2)}
        cut = [whole[i : i + 7] for i in range(0, len(whole), 7)]
        rows += [(conv, i, c, i == len(cut) - 1) for i, c in enumerate(cut)]
    mapped = spark.createDataFrame([(s, p, v) for (s, p), v in values.items()], MAPPED)
    third = max(r[1] for r in rows) // 3 + 1
    batches = [[r for r in rows if r[1] // third == k] for k in range(3)]
    batches[2] += [r for r in rows if r[1] == 1]  # come again
    random.Random(2).shuffle(batches[0])
    out = collected(spark, state.refill_stream(stream_of(spark, tmp_path, batches, CHUNK), mapped), tmp_path, lambda got: len(got) >= sum(map(len, batches)), "replies")
    got = {(r.stream_id, r.chunk_no): r.text for r in out if r.status == "ok"}
    assert got == folded(rows, values) == {(r.stream_id, r.chunk_no): r.text for r in sessions.refill_chunks(spark.createDataFrame(rows, CHUNK), mapped).collect()}
    again = [r for r in out if r.status == "repeated"]
    assert len(again) == len({r[0] for r in rows}) and all(r.text is None for r in again)


def test_guard_over_chunk_ends_and_expiry(spark, tmp_path):
    batches = [[("a", 1, "key AKIAABCDEF", None), ("b", 1, "x <ORG_0", None)], [("a", 2, "GHIJKLMNOP end", None), ("a", 3, "more", None)]]
    mapped = spark.createDataFrame([("b", "<ORG_001>", "甲")], MAPPED)
    frame = state.refill_stream(stream_of(spark, tmp_path, batches, CHUNK), mapped, ttl_ms=6000)
    out = collected(spark, frame, tmp_path, lambda got: sum(r.status == "expired" for r in got) == 2, "guarded")
    assert {(r.stream_id, r.chunk_no, r.status, r.text) for r in out} == {("a", 1, "ok", "key AKIAABCDEF"), ("a", 2, "blocked", None), ("a", 3, "blocked", None), ("a", 3, "expired", None), ("b", 1, "ok", "x "), ("b", 1, "expired", "<ORG_0")}


def test_sessions(spark, tmp_path):
    schema = "namespace string, seq long, text string"
    batches = [[("n", 1, "电话13812345678，找甲方公司"), ("n", 2, "又13812345678"), ("m", 1, "甲方公司")], [("n", 4, "a@b.example 与 13812345678"), ("n", 3, "甲方公司 c@d.example"), ("n", 5, None), ("n", 6, "-----BEGIN PRIVATE KEY-----")], [("n", 2, "a@b.example")]]
    persisted = spark.createDataFrame([("n", "<ORG_007>", "ORG", "甲方公司"), ("n", "<CONTACT_004>", "CONTACT", "x@y.example")], "namespace string, placeholder string, label string, original_value string")
    out = collected(spark, state.mask_sessions(stream_of(spark, tmp_path, batches, schema), persisted), tmp_path, lambda got: len(got) == 8, "sessions")
    got = {(r.namespace, r.seq, r.late): r.masked_text for r in out}
    assert got == {
        ("n", 1, False): "电话<CONTACT_005>，找<ORG_007>", ("n", 2, False): "又<CONTACT_005>", ("m", 1, False): "甲方公司",
        ("n", 3, False): "<ORG_007> <CONTACT_006>", ("n", 4, False): "<CONTACT_007> 与 <CONTACT_005>", ("n", 5, False): None, ("n", 6, False): None, ("n", 2, True): "<CONTACT_007>",
    }


def test_sessions_end(spark, tmp_path):
    schema = "namespace string, seq long, text string"
    none = spark.createDataFrame([], "namespace string, placeholder string, label string, original_value string")
    spark.createDataFrame([("n", 5, "a@b.example c@d.example")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = state.mask_sessions(stream, none, ttl_ms=1500).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 60
        while spark.table("ended").count() < 1 and time.time() < until:
            time.sleep(0.3)
        time.sleep(6)  # no text comes for longer than the session lives
        spark.createDataFrame([("n", 1, "c@d.example")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        while spark.table("ended").count() < 2 and time.time() < until:
            time.sleep(0.3)
        assert query.exception() is None
        assert {(r.seq, r.masked_text, r.late) for r in spark.table("ended").collect()} == {(5, "<CONTACT_001> <CONTACT_002>", False), (1, "<CONTACT_001>", False)}
    finally:
        query.stop()
