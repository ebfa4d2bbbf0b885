from __future__ import annotations

import hashlib
import hmac
import json
import random
import re

from pyspark.sql import functions as F

from umbra.functions import patterns, text
from umbra.operators import detect, guard, placeholders, policy, spans
from umbra.plans import queries as plans
from umbra.sources import readers
from umbra.streaming import sessions


def test_keyed_hash(spark):
    got = spark.createDataFrame([("abc",), ("甲方",), ("",)], "v string").select("v", text.keyed_hash("v", b"key").alias("h")).collect()
    assert all(r.h == hmac.new(b"key", r.v.encode(), hashlib.sha256).hexdigest()[:16] for r in got)


def test_half_width_keeps_offsets(spark):
    r = spark.createDataFrame([("电话：１３８，邮箱ａ＠ｂ．ｃｏｍ。",)], "v string").select(text.half_width("v").alias("h"), "v").first()
    assert r.h == "电话:138，邮箱a@b.com。" and len(r.h) == len(r.v)


def test_rules_find_what_the_patterns_find(spark):
    cases = ["电话 13812345678。", "x13812345678", "写信到 a_é.b@ex.com 或 c@d.org", "合同编号：HT-2024-001", "token=abcdefghijklmnop1234", 'token = "abcdefghijklmnop1234"', "￥1,200万元 和 3.5亿元", "面积3万平方米", "2024-01-02 与 2024-01.02", "https://a.b/c?d，完", "", "😀 13912345678 😀"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.label) for r in detect.rule_spans(docs).collect()}
    want = set()
    for i, t in enumerate(cases):
        for r in patterns.RULES:
            for m in re.finditer(r.pattern, t.translate(str.maketrans(text.FULL, text.HALF))):
                want.add((i, m.start(r.group), m.end(r.group), r.label))
    assert got == want and len(want) > 8


def test_clip_equals_fold(spark):
    rng = random.Random(3)
    rows = [(d, s, s + rng.randint(1, 9), rng.choice("AB"), rng.randint(0, 2), rng.random(), f"s{k}") for d in range(60) for k in range(rng.randint(1, 8)) for s in [rng.randint(0, 20)]]
    got = {(r.doc_id, r.start, r.end, r.source) for r in spans.clip(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, priority int, confidence double, source string")).collect()}
    want = set()
    for d in range(60):
        owner: dict[int, str] = {}
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], -r[5], r[1] - r[2], r[1], r[2], r[3], r[6])):
            for c in range(r[1], r[2]):
                owner.setdefault(c, r[6])
        for c in owner:
            if owner.get(c - 1) != owner[c]:
                e = c
                while owner.get(e) == owner[c]:
                    e += 1
                want.add((d, c, e, owner[c]))
    assert got == want


def test_profiles(spark):
    rows = spark.createDataFrame([("CREDENTIAL", "critical"), ("AMOUNT", "medium"), ("ORG", None), ("LEGAL_STRATEGY", "high"), ("ADDRESS", "high")], "label string, risk_level string")
    by = lambda p: {r.label: r.a for r in rows.select("label", policy.decide(p).alias("a")).collect()}
    assert by(policy.PROFILES["contract"]) == {"CREDENTIAL": "redact", "AMOUNT": "pass", "ORG": "redact", "LEGAL_STRATEGY": "block", "ADDRESS": "generalize"}
    assert by(policy.resolve("strict", min_risk="high")) == {"CREDENTIAL": "redact", "AMOUNT": "pass", "ORG": "redact", "LEGAL_STRATEGY": "redact", "ADDRESS": "redact"}
    assert policy.PROFILES["file_workbench"].reversible and not policy.PROFILES["contract"].reversible


def test_altered_and_refill(spark):
    texts = spark.createDataFrame([(1, "<ORG_001> met <ORG_002>"), (2, "<ORG_001> and < org_002>"), (3, "ORG_001 <ORG_001> <ORG_002>"), (4, "<ORG_001><ORG_001><ORG_002>")], "doc_id long, reply string")
    mapped = spark.createDataFrame([(d, f"<ORG_00{k}>", f"<ORG_00{3 - k}>", 1) for d in range(1, 5) for k in (1, 2)], "doc_id long, placeholder string, original_value string, n int")
    got = {r.doc_id: (r.status, r.text, r.error_types) for r in placeholders.refill(texts, mapped).collect()}
    assert got == {1: ("ok", "<ORG_002> met <ORG_001>", []), 2: ("blocked", None, ["missing", "altered"]), 3: ("blocked", None, ["altered"]), 4: ("blocked", None, ["count_mismatch"])}


def test_samples(spark, tmp_path):
    rows = [{"sample_id": "a", "text": "甲乙丙", "gold_spans": [{"start": 1, "end": 2, "label": "ORG", "text": "乙"}]}, {"sample_id": "b", "text": "xyz", "gold_spans": [{"start": 0, "end": 2, "label": "ORG", "text": "yz"}]}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    good, bad = readers.samples(spark, str(tmp_path / "s.jsonl"))
    assert [r.sample_id for r in good.collect()] == ["a"] and [r.sample_id for r in bad.collect()] == ["b"]


def test_remap(spark):
    blocks = spark.createDataFrame([(1, 1, "abc"), (1, 2, "defg")], "doc_id long, block int, text string")
    joined, places = readers.paragraphs(blocks)
    assert joined.first().text == "abc\n\ndefg"
    got = readers.remap(spark.createDataFrame([(1, 6, 8), (1, 2, 7)], "doc_id long, start int, end int"), places).orderBy("start").collect()
    assert [(r.block, r.local_start, r.local_end) for r in got] == [(None, None, None), (2, 1, 3)]


def test_mask_stream(spark, tmp_path):
    rows = [("n1", 1, "ORG", "a"), ("n1", 2, "ORG", "b"), ("n2", 1, "ORG", "b"), ("n1", 3, "ORG", "a")]
    schema = "namespace string, seq long, label string, surface string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.mask_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), hours=None)
    q = stream.writeStream.format("memory").queryName("masked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(45)
    got = {(r.namespace, r.seq): r.placeholder for r in spark.table("masked").collect()}
    assert got == {("n1", 1): "<ORG_001>", ("n1", 2): "<ORG_002>", ("n1", 3): "<ORG_001>", ("n2", 1): "<ORG_001>"}
    batch = {(r.namespace, r.seq): r.placeholder for r in sessions.mask_values(spark.createDataFrame(rows, schema)).collect()}
    assert batch == got


def test_rolling(spark):
    chunks = spark.createDataFrame([(1, 1, "pass"), (1, 2, "word=Zx9LmN4vBtQ7"), (1, 3, "!")], "stream_id long, chunk_no long, text string")
    got = [r.seen for r in sessions.rolling(chunks, 6).orderBy("chunk_no").collect()]
    assert got == ["pass", "password=Zx9LmN4vBtQ7", "4vBtQ7!"]
    assert F.col("x") is not None


def test_private_keys(spark):
    a, b, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\nMIIEpAIBAAKCAQEA 13812345678 a@b.org\n"
    bare = f"-----begin  PRIVATE\tKEY-----{body}-----END PRIVATE KEY-----"
    good = {0: f"😀 key: {a}{body}{b} tel 13912345678", 1: f"{bare} and {a}{body}{b}", 2: "no key, only PRIVATE words"}
    bad = {10: f"x {a}{body}", 11: f"{a}{body}{a}{body}{b}", 12: f"{bare[:30]}{body}{b}", 13: f"{a} \n {b}", 14: f"{body}{b}", 15: f"---BEGIN PRIVATE KEY-----{body}-----END PRIVATE KEY-----", 16: f"-----BEGIN PRIVATE{body}"}
    docs = spark.createDataFrame([*good.items(), *bad.items(), (20, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in plans.redacted(docs).collect()}
    assert got[0].redacted_text == "😀 key: <CREDENTIAL_001> tel <CONTACT_001>" and got[1].redacted_text == "<CREDENTIAL_001> and <CREDENTIAL_002>" and got[2].redacted_text == good[2]
    assert all(got[i].error is None for i in (*good, 20)) and all(got[i].redacted_text is None for i in bad)
    words = {10: "incomplete", 11: "nested", 12: "mismatched", 13: "empty", 14: "mismatched", 15: "incomplete", 16: "incomplete"}
    assert {i: got[i].error for i in bad} == {i: f"{w} private key block" for i, w in words.items()}
    keys = {(r.doc_id, r.surface, r.confidence, r.risk_level) for r in detect.rule_spans(docs).where("rule_id = 'private_key_block'").collect()}
    assert keys == {(0, f"{a}{body}{b}", 1.0, "critical"), (1, bare, 1.0, "critical"), (1, f"{a}{body}{b}", 1.0, "critical")}
    found = {(r.doc_id, r.pattern_id) for r in guard.secrets(docs).collect() if r.pattern_id.startswith("private_key")}
    assert found == {(i, "private_key_block") for i in (0, 1)} | {(i, "private_key_malformed") for i in bad}
