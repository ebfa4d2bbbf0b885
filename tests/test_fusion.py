"""The detection run against folds by hand: sweeps, alternatives, priorities, what is turned away, needles dealt by key."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from umbra.functions import patterns, scan
from umbra.functions.scan import Span
from umbra.operators import detect, fusion, matcher, policy, spans

STRICT, LIGHT, OPEN = policy.PROFILES["strict"], policy.PROFILES["light"], policy.PROFILES["file_workbench"]
NONE = "doc_id long, start int, end int, label string, score double"


def owners(bounds):
    owner = {}
    for i, (a, b) in enumerate(bounds):
        for c in range(a, b):
            owner.setdefault(c, i)
    out = []
    for c in sorted(owner):
        if out and out[-1][1] == c and out[-1][2] == owner[c]:
            out[-1] = out[-1][0], c + 1, owner[c]
        else:
            out.append((c, c + 1, owner[c]))
    return out


def test_sweep():
    rng = random.Random(1)
    for _ in range(300):
        bounds = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 25) for _ in range(rng.randint(0, 12)))]
        assert scan.sweep(bounds) == owners(bounds)


def test_sweep_of_very_many():
    rng = random.Random(2)
    bounds = [(a, a + rng.randint(1, 3000)) for a in (rng.randint(0, 400_000) for _ in range(50_000))]
    began = time.time()
    pieces = scan.sweep(bounds)
    assert time.time() - began < 10 and all(x[1] <= y[0] for x, y in zip(pieces, pieces[1:], strict=False))


def by_pairs(ranked):
    """Every model span against every other one."""
    held = [s for s in ranked if s.source == "model" and any(o.source == "model" and o.label != s.label and o.start <= s.start and o.end >= s.end and o.end - o.start >= s.end - s.start + 2 for o in ranked)]
    kept = []
    for s in ranked:
        if s in held:
            continue
        if s.source == "model" and any(k.source == "model" and k.label == s.label and (k.start <= s.start and k.end >= s.end or s.start <= k.start and s.end >= k.end) for k in kept):
            continue
        kept.append(s)
    return kept


def test_alternatives():
    rng = random.Random(3)
    for _ in range(400):
        made = {Span(a, a + rng.randint(1, 8), rng.choice("AB"), rng.choice([0.5, 0.9]), rng.choice(["model", "model", "rule"])) for a in (rng.randint(0, 12) for _ in range(rng.randint(0, 10)))}
        ranked = sorted(made, key=scan.rank)
        assert scan.alternatives(ranked) == by_pairs(ranked)


def test_fuse():
    text = "上海示例置业有限公司 于 2.5万平方米"
    given = [Span(0, 10, "ORG", 0.9, "model", canonical_value="上海示例置业有限公司"), Span(0, 6, "PROJECT", 0.99, "dictionary"), Span(10, 13, "DATE", 0.99, "manual"), Span(13, 17, "AMOUNT", 0.85, "model")]
    got = scan.fuse(text, given)
    assert [(s.start, s.end, s.label, s.clipped) for s in got] == [(0, 6, "PROJECT", False), (11, 12, "DATE", True)]  # 有限公司 alone is no name, an area no amount
    got = scan.fuse("甲 乙丙丁戊", [Span(0, 6, "PERSON", 0.5, "model", canonical_value="甲乙丙丁戊"), Span(1, 3, "DATE", 0.9, "manual"), Span(1, 2, "X", 1.0, "manual")])
    assert [(s.start, s.end, s.label, s.clipped, s.canonical_value) for s in got] == [(0, 1, "PERSON", True, "甲"), (2, 3, "DATE", True, None), (3, 6, "PERSON", True, "丙丁戊")]
    sure, unsure = Span(0, 5, "A", 0.95, "rule"), Span(0, 6, "B", 0.94, "public_context_rule")
    assert scan.rank(sure) < scan.rank(unsure) and scan.rank(Span(0, 1, "A", 0, "other")) > scan.rank(Span(0, 1, "A", 0, "model"))


KEY = "-----BEGIN PRIVATE KEY-----\nQUJD\n-----END PRIVATE KEY-----"


def test_run_is_fail_closed(spark):
    rows = [(1, "电话13812345678。"), (2, "x" * 200_001), (3, "见<ORG_001>"), (4, KEY[:40]), (5, None), (6, ""), (7, f"a {KEY} b"), (8, "短")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(detect.ModelRequired):
        fusion.run(docs, STRICT)
    model = spark.createDataFrame([(1, 0, 2, "PERSON", 0.9), (1, 0, 99, "PERSON", 0.9), (77, 0, 1, "PERSON", 0.9)], NONE)
    manual = spark.createDataFrame([(8, 0, 5, "ORG", "manual"), (6, 0, 1, "ORG", "manual")], "doc_id long, start int, end int, label string, source string")
    got = {r.doc_id: r for r in fusion.redacted(fusion.run(docs, STRICT, model, [manual])).collect()}
    assert {i: got[i].error for i in got if got[i].error} == {2: "text_too_long", 3: "reserved_placeholder", 4: "incomplete private key block", 6: "span_out_of_bounds", 8: "span_out_of_bounds"}
    assert all(got[i].redacted_text is None and got[i].mapping is None for i in (2, 3, 4, 5, 6, 8))
    assert got[1].redacted_text == "<PERSON_001><CONTACT_001>。" and not got[1].degraded
    assert got[7].redacted_text == "a <CREDENTIAL_001> b"
    assert [(m.placeholder, m.original_value, m.n) for m in got[7].mapping] == [("<CREDENTIAL_001>", KEY, 1)]
    loose = {r.doc_id: r for r in fusion.run(docs, OPEN).collect()}
    assert loose[1].degraded and len(loose) == len(rows)
    assert fusion.run(docs.limit(0), OPEN).count() == 0


def test_whole_key_is_never_left(spark):
    docs = spark.createDataFrame([(1, f"a {KEY} token=abcdefghijklmnop1")], "doc_id long, text string")
    only = policy.Profile("only", only=("CONTACT",), use_model=False)
    r = fusion.redacted(fusion.run(docs, only)).first()
    assert r.redacted_text == "a <CREDENTIAL_001> token=abcdefghijklmnop1"
    found = detect.rule_spans(docs)
    assert [s.rule_id for s in policy.apply(found, only).collect()] == ["private_key_block"]
    blocking = policy.Profile("b", only=("CONTACT",), actions={"CREDENTIAL": "block"})
    assert [r.blocked for r in policy.blocked_labels(found, blocking).collect()] == [["CREDENTIAL"]]


def test_profiles_of_a_run(spark):
    docs = spark.createDataFrame([(1, "甲方：宏远建设，乙方：宏图地产。江苏省人民政府批复，宏远建设付人民币500元。")], "doc_id long, text string")
    names = spark.createDataFrame([(1, 3, 7, "ORG", "dictionary"), (1, 11, 15, "ORG", "dictionary"), (1, 26, 30, "ORG", "dictionary")], "doc_id long, start int, end int, label string, source string")
    no_model = spark.createDataFrame([], NONE)
    r = fusion.redacted(fusion.run(docs, policy.PROFILES["contract"], no_model, [names])).first()
    assert r.redacted_text == "甲方：<PARTYA_001>，乙方：<PARTYB_001>。江苏省人民政府批复，<PARTYA_001>付人民币500元。"
    clear = policy.Profile("clear", deny=("PUBLIC_REGION", "PUBLIC_AUTHORITY"))
    assert [x.rule_id for x in fusion.wanted_rules(clear)][-2:] == ["public_region", "public_authority"]
    # A public authority, left in clear, takes its characters from the model.
    model = spark.createDataFrame([(1, 17, 24, "ORG", 0.9)], NONE)
    assert "江苏省人民政府" in fusion.redacted(fusion.run(docs, clear, model)).first().redacted_text
    assert "江苏省人民政府" not in fusion.redacted(fusion.run(docs, STRICT, model)).first().redacted_text
    coarse = fusion.redacted(fusion.run(docs, policy.PROFILES["pre_investment"], no_model)).first()
    assert coarse.redacted_text.endswith("付10亿元以下。") and all(m.label != "AMOUNT" for m in coarse.mapping)


def test_registered_detector(spark):
    fusion.register(fusion.Detector("test_digits", lambda d: d.select("doc_id", F.explode(detect.matches(F.col("text"), r"\d+")).alias("m")).select("doc_id", "m.start", "m.end", F.lit("NUMBER").alias("label"), F.lit(0.5).alias("confidence"))))
    with pytest.raises(ValueError, match="registered already"):
        fusion.register(fusion.DETECTORS["test_digits"])
    docs = spark.createDataFrame([(1, "a12 电话13812345678。")], "doc_id long, text string")
    assert fusion.redacted(fusion.run(docs, OPEN, detectors=["test_digits"])).first().redacted_text == "a<NUMBER_001> 电话<CONTACT_001>。"
    del fusion.DETECTORS["test_digits"]


def test_no_exchange_within_documents(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("电话13812345678。").alias("text"))
    plan = fusion.redacted(fusion.run(docs, LIGHT))._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.rindex("MapInArrow")]  # what stands above the scan: the plan is printed from its end
    assert "Exchange" not in after and after.count("MapInArrow") == 1
    assert plan.count("Exchange") == 1  # these rows are spread over the cores before it


def test_clip_of_very_many_spans_of_a_document(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 7 % 90_001).cast("int").alias("start"), (F.col("id") * 7 % 90_001 + 1 + F.col("id") % 900).cast("int").alias("end"), F.lit("A").alias("label"), (F.col("id") % 5).cast("int").alias("priority"), (F.col("id") % 97 / 97).alias("confidence"), F.lit("s").alias("source"))
    began = time.time()
    got = spans.clip(rows).select("start", "end").orderBy("start").collect()
    assert time.time() - began < 30 and all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))
    covered = {c for r in rows.select("start", "end").collect() for c in range(r.start, r.end)}
    assert sum(r.end - r.start for r in got) == len(covered)


def test_matcher(spark):
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("ab中") for _ in range(rng.randint(a, b)))
    texts = [(i, rng.choice("xy"), word(0, 60)) for i in range(60)] + [(60, "x", None), (61, None, "abab")]
    needles = sorted({(rng.choice("xy"), word(1, 9)) for _ in range(150)} | {("x", "")})
    docs = spark.createDataFrame(texts, "doc_id long, scope string, view string").repartition(3)
    got = sorted(tuple(r) for r in matcher.occurrences(docs, spark.createDataFrame(needles, "scope string, needle string")).collect())
    want = [(i, s, n, m.start(), m.end()) for i, s, t in texts for z, n in needles if s == z and n and t for m in re.finditer(re.escape(n), t)]
    assert got == sorted(want) and len(want) > 500


def test_loose_matcher(spark):
    rng = random.Random(5)
    texts = [(i, 0, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 40)))) for i in range(80)]
    needles = sorted({(0, "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))) for _ in range(60)})
    got = sorted(tuple(r) for r in matcher.occurrences(spark.createDataFrame(texts, "doc_id long, scope int, view string"), spark.createDataFrame(needles, "scope int, needle string"), loose=True).collect())
    want = [(i, 0, n, m.start(), m.end()) for i, _, t in texts for _, n in needles for m in re.finditer(r"[ \t\r\n]{0,2}".join(n), t)]
    assert got == sorted(want) and len(want) > 300


def test_very_many_needles(spark):
    """The plan joins by key, without a broadcast of needles, and finds each of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        needles = spark.range(300_000).select(F.lit(0).alias("scope"), F.format_string("Firma Nr. %07d", "id").alias("needle"))
        docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("scope"), F.format_string("von Firma Nr. %07d und Firma Nr. %07d", F.col("id") * 997, F.col("id") + 400_000).alias("view"))
        found = matcher.occurrences(docs, needles)
        assert found.count() == 200
        assert found.where("needle <> format_string('Firma Nr. %07d', doc_id * 997)").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_public_rules_by_hand():
    assert {s.rule_id for s in scan.rules("江苏省人民政府", patterns.PUBLIC)[0]} == {"public_region", "public_authority"}
