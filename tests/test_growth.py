"""Work that grows with the input: one pass over a text, and parts for all cores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from umbra.functions import patterns, scan
from umbra.operators import fusion, policy
from umbra.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


def passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_joined_rows_are_dealt_to_all_cores(spark):
    docs = spark.createDataFrame([(i, f"电话{13800000000 + i}。") for i in range(40)] + [(None, "空13900000000")], "doc_id long, text string")
    given = spark.createDataFrame([(1, 0, 2, "ORG", 0.9), (None, 0, 1, "ORG", 0.9)], "doc_id long, start int, end int, label string, score double")
    ran = fusion.run(docs, policy.PROFILES["strict"], given)
    assert ran.rdd.getNumPartitions() >= 16
    got = {r.doc_id: [(s.start, s.label) for s in r.spans] for r in ran.collect()}
    assert len(got) == 41
    assert got[0] == [(2, "CONTACT")]
    assert got[1] == [(0, "ORG"), (2, "CONTACT")]
    assert got[None] == [(0, "ORG"), (1, "CONTACT")]


def test_audit_and_values_run_once(spark):
    assert passes(plans.QUERIES["audit_events"](spark, FOLDER)) == 2  # the run and the redaction
    assert passes(plans.QUERIES["inspection_values"](spark, FOLDER)) == 2


def test_lists_of_structs():
    rows = [[(1, 2, "a")], None, [], [(3, 4, None), (5, 6, "b")]]
    types = {"start": "int", "end": "int", "label": "string"}
    assert scan.lists(scan.column(rows, types)) == rows
    assert scan.lists(scan.column(rows, types).slice(2, 2)) == rows[2:]
    batch = pa.RecordBatch.from_arrays([scan.column(rows * 100, types)], ["a"])
    assert [x for part in scan.slices(batch, 7) for x in scan.lists(part.column(0))] == rows * 100


def test_findings_read_the_masked_text_once(spark):
    assert passes(plans.QUERIES["inspection_findings"](spark, FOLDER)) == 3  # the run, the redaction, the search
    masked = spark.createDataFrame([(1, "<CONTACT_001> 电话13800000001。"), (None, "<CONTACT_001>"), (2, None)], "doc_id long, redacted_text string")
    assert [tuple(r) for r in fusion.findings(masked).collect()] == [(1, "CONTACT", "rule", 1)]


def test_windows_are_cut_in_one_walk(spark):
    from umbra.operators import detect

    docs = spark.createDataFrame([(1, "x" * 1000), (2, "a" * 250 + "。" + "b" * 300), (3, "a" * 200 + "\n" + "b" * 100 + "；" + "c" * 200), (4, ""), (5, None), (6, "y")], "doc_id long, text string")
    cut = detect.cut_windows(docs)
    assert passes(cut) == 1
    got = [(r.doc_id, r.window, r.start, r.end) for r in cut.orderBy("doc_id", "window").collect()]
    assert got == [(1, 0, 0, 384), (1, 1, 320, 704), (1, 2, 640, 1000), (2, 0, 0, 251), (2, 1, 187, 551), (3, 0, 0, 201), (3, 1, 137, 502), (6, 0, 0, 1)]


def test_diff_by_row(spark):
    assert passes(plans.QUERIES["placeholder_diff"](spark, FOLDER)) == 2
    from umbra.operators import placeholders

    kind = "doc_id long, reply string, mapping array<struct<placeholder:string,label:string,original_value:string,n:bigint>>"
    rows = spark.createDataFrame([(1, "<A_001><A_001><B_009>", [("<A_001>", "A", "x", 1), ("<A_002>", "A", "y", 2)]), (2, None, [("<A_001>", "A", "x", 1)]), (3, "<A_001>", None)], kind)
    got = sorted((r.doc_id, r.placeholder, r.expected, r.seen, r.kind) for r in placeholders.diff_rows(rows).collect())
    assert got == [(1, "<A_001>", 1, 2, "duplicated"), (1, "<A_002>", 2, 0, "missing"), (1, "<B_009>", 0, 1, "unknown"), (2, "<A_001>", 1, 0, "missing"), (3, "<A_001>", 0, 1, "unknown")]


def test_inspection_by_row(spark):
    assert passes(plans.QUERIES["inspection_snapshot"](spark, FOLDER)) == 2
    from umbra.operators import ledger

    kind = "doc_id long, redacted_text string, mapping array<struct<placeholder:string,label:string,original_value:string,n:bigint>>"
    rows = spark.createDataFrame([(1, "<A_001><A_002><A_001><C_009>", [("<A_001>", "A", "x", 2), ("<A_002>", "A", "y", 1), ("<B_001>", "B", "z", 1)]), (2, "<A_001>", [("<A_001>", "A", "y", 1)]), (3, None, None)], kind)
    assert [tuple(r) for r in ledger.inspection_rows(rows).collect()] == [("A", 4, 2, 2)]


def test_model_names_are_dealt_to_all_cores(spark):
    from umbra.operators import model_spans

    docs = spark.createDataFrame([(i, f"企业{i}集团的，") for i in range(40)], "doc_id long, text string")
    given = spark.createDataFrame([(i, 0, 2, "ORG", 0.9) for i in range(40)], "doc_id long, start int, end int, label string, score double")
    found = model_spans.spans(given, docs)
    assert found.rdd.getNumPartitions() >= 16
    assert found.count() == 40


def test_joins_of_measures_and_sessions_have_parts_by_size(spark, monkeypatch):
    from umbra import workers

    monkeypatch.setattr(workers, "parts", lambda rows: 37)
    for name in ("session_refill", "review_queue", "risk_levels"):
        plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert ", 37), REPARTITION_BY_NUM" in plan


def test_strict_streams_join_twice(spark):
    from umbra.streaming import sessions

    plan = plans.QUERIES["strict_stream_refill"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
    chunks = spark.createDataFrame([(1, 0, "a <ORG"), (1, 1, "_001>"), (2, 0, "<ORG_001><ORG_009>"), (3, 0, "none"), (4, 0, "<ORG_001>"), (5, 0, "plain"), (6, 0, "<ORG_001>"), (7, 0, "<ORG_001>"), (8, 0, "[ORG_001] <ORG_001>")], "stream_id long, chunk_no long, text string")
    given = [(1, "<ORG_001>", "A"), (2, "<ORG_001>", "B"), (3, "<ORG_001>", "C"), (4, "<ORG_001>", None), (6, "<ORG_001>", "D"), (6, None, "E"), (8, "<ORG_001>", "F"), (None, "<ORG_001>", "G")]
    got = sorted(tuple(r) for r in sessions.strict_streams(chunks, spark.createDataFrame(given, "stream_id long, placeholder string, original_value string")).collect())
    assert [r[2:] for r in got[:7]] == [("ok", "a "), ("ok", "A"), ("unknown_or_altered", None), ("missing", None), ("ok", "<ORG_001>"), ("ok", "plain"), ("missing", None)]
    assert got[7][2:] == ("unknown_or_altered", None)


def test_markdown_tables_in_one_pass(spark):
    from umbra.sources import readers

    plan = plans.QUERIES["markdown_tables"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0
    kind = "doc_id long, block_id string, `order` int, text string, kind string, level int, table_id string, row int, col int"
    cells = [(1, "a", 5, "x|y", 2, 1), (1, "b", 6, None, 2, 3), (1, "c", 7, "p \n q", 4, 0), (2, "a", 1, "z", 0, 0)]
    tree = spark.createDataFrame([(d, b, o, t, "cell", None, "t", r, c) for d, b, o, t, r, c in cells] + [(1, "w", 9, "end", None, None, None, None, None)], kind)
    text, lines = readers.block_tree(tree)
    empty = "|  |  |  |  |"
    assert {r.doc_id: r.markdown for r in text.collect()} == {1: "\n".join([empty, "| --- | --- | --- | --- |", empty, r"|  | x\|y |  |  |", empty, "| p<br>q |  |  |  |", "", "end", ""]), 2: "| z |\n| --- |\n"}
    assert sorted(tuple(r) for r in lines.collect()) == [(1, "a", 1, 6), (1, "b", 1, 6), (1, "c", 1, 6), (1, "w", 8, 8), (2, "a", 1, 2)]


def test_parts_stay_small_as_tables_grow(spark, tmp_path, monkeypatch):
    from umbra import workers

    assert workers.parts(spark.range(100)) == 16
    assert workers.parts(spark.range(100_000_000)) == 800_000_000 >> 22
    # A table of many splits is dealt too: a worker's batches hold what a part does.
    spark.range(300).selectExpr("id AS doc_id", "concat('电话', 13800000000 + id) AS text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(workers, "parts", lambda rows: 37)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = plans.QUERIES["redact_documents"](spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() == 37
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.doc_id, r.redacted_text) for r in rows.collect()} == {(i, "电话<CONTACT_001>") for i in range(300)}


def test_carriers_group_tables_in_parts_by_size(spark, monkeypatch):
    from umbra import workers
    from umbra.plans import carriers

    monkeypatch.setattr(workers, "parts", lambda rows: 37)
    gold = carriers.spark_sql(spark, FOLDER, carriers.GOLD)
    assert gold.rdd.getNumPartitions() == 37
    assert carriers.spark_sql(spark, FOLDER, carriers.FOUND).rdd.getNumPartitions() == 74
    assert carriers.spark_sql(spark, FOLDER, carriers.OVERLAPS).rdd.getNumPartitions() == 37
    plain = spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg({"l_partkey": "min", "l_suppkey": "min"})
    assert {(r.doc_id, r.start // 40, r.part, r.supp) for r in gold.collect()} == {tuple(r) for r in plain.select("l_orderkey", "l_linenumber", "min(l_partkey)", "min(l_suppkey)").collect()}
    assert gold.count() == plain.count()


def test_joined_rows_have_parts_of_a_few_megabytes(spark):
    docs = spark.range(100_000_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    given = spark.createDataFrame([(1, 0, 1, "ORG", 0.9)], "doc_id long, start int, end int, label string, score double")
    plan = fusion.run(docs, policy.PROFILES["strict"], given)._jdf.queryExecution().executedPlan().toString()
    assert f", {800_000_000 >> 22}), REPARTITION_BY_NUM" in plan


def test_slices_hold_few_bytes_however_long_texts_are():
    texts = [None if i % 11 == 0 else "长" * 100_000 if i == 5 else "y" * 2_000_000 if i == 8 else "é" * (i * 150) for i in range(700)]
    spans = [None if i % 7 == 0 else [(j, "L" * j) for j in range(i % 5)] for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), scan.column(spans, {"start": "int", "label": "string"})], ["text", "given"])
    parts = list(scan.slices(batch, size=1_000_000))
    assert all(p.nbytes <= 1_000_000 or p.num_rows == 1 for p in parts)
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert [x for p in parts for x in scan.lists(p.column(1))] == spans
    assert max(p.nbytes for p in scan.slices(batch.slice(400))) <= 1 << 22
    short = pa.RecordBatch.from_arrays([pa.array(range(600))], ["n"])
    assert [p.num_rows for p in scan.slices(short)] == [256, 256, 88]
    assert not list(scan.slices(batch.slice(0, 0)))


def test_risk_summary_by_row(spark):
    from umbra.operators import placeholders

    plan = plans.QUERIES["risk_summary"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.count("Join ") == 1  # texts and predictions; their spans stay in a row
    kind = "doc_id long, spans array<struct<start:int,label:string,role:string,surface:string,coarse:string>>"
    rows = spark.createDataFrame([(1, [(0, "ORG", "LEAD", "a", None), (2, "ORG", None, "a", None), (4, "ORG", None, "a", None), (6, "DATE", None, "d", "2020Q1"), (8, "DEPARTMENT", None, "a", None)]), (2, []), (3, None)], kind)
    got = sorted(tuple(r) for r in placeholders.risk_summary_rows(rows).collect())
    assert got == [(1, "DATE", 1, 1, 1), (1, "DEPARTMENT", 1, 1, 0), (1, "ORG", 3, 2, 0)]
    each = rows.selectExpr("doc_id", "inline(spans)")
    assert sorted(tuple(r) for r in placeholders.risk_summary(placeholders.number(each)).collect()) == got


def test_numbering_broadcasts_nothing(spark):
    from umbra.operators import placeholders

    # By its files the table is small; its spans are a thousand times as many.
    spans = spark.range(20).selectExpr("id AS doc_id", "explode(sequence(1, 1000)) AS start").selectExpr("doc_id", "start", "'ORG' AS label", "concat('v', start % 7) AS surface")
    named = placeholders.number(spans)
    assert named.count() == 20_000
    assert "Broadcast" not in named._jdf.queryExecution().executedPlan().toString()
    assert {r.placeholder for r in named.where("surface = 'v3'").collect()} == {"<ORG_003>"}


def test_round_trip_runs_once_by_row(spark):
    from umbra.operators import measure

    plan = plans.QUERIES["round_trip"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Join ")) == (2, 0)
    rows = [(1, "a", "ok", "a"), (2, "b", "ok", "x"), (3, "c", "blocked", None), (None, "d", "ok", "d"), (4, None, "ok", None)]
    refilled = spark.createDataFrame(rows, "doc_id long, whole string, status string, text string")
    assert tuple(measure.round_trip_rows(refilled).first()) == (5, 2, 1)


def test_findings_are_counted_by_row(spark):
    masked = spark.createDataFrame([(1, "<CONTACT_001> 电话13800000001，13800000002。2020年1月2日"), (2, "<A_13800000003>"), (3, "nothing")], "doc_id long, redacted_text string")
    found = fusion.findings(masked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(1, "CONTACT", "rule", 2), (1, "DATE", "rule", 1)]


def test_spans_outside_of_places():
    spans = [scan.Span(a, b, "X", 1.0, "rule") for a, b in ((0, 2), (2, 5), (5, 6), (6, 9), (8, 9), (9, 12))]
    assert [s[:2] for s in scan.outside(spans, [(2, 3), (6, 8)])] == [(0, 2), (5, 6), (8, 9), (9, 12)]
    assert scan.outside(spans, []) == spans


def test_columns_as_lists():
    for values in (pa.array(["a", None, "长"]), pa.array([1, 2, 3]), pa.array([1, None]), pa.array([True, False]), pa.array([0.5, None]), pa.array([None, None]), pa.array([[1], None]), pa.array(["x", "y", None, ""]).slice(1, 2)):
        assert scan.plain(values) == values.to_pylist()
        assert [type(x) for x in scan.plain(values)] == [type(x) for x in values.to_pylist()]


def test_word_files_are_opened_by_row(spark):
    from umbra.sources import office

    plan = plans.QUERIES["docx_round_trip"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # files and the spans of their paragraphs
    assert plan.count("MapInPandas") + plan.count("MapInArrow") == 8  # one of each step; files are written in both sides' plan, but dealt once
    texts = [(1, "a 13800000001\n\n13800000002 13800000001"), (None, "13800000003"), (2, "nothing"), (3, "<ORG_001> 13800000004")]
    made = office.write_docx(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = made.unionByName(spark.createDataFrame([(4, bytearray(b"no file")), (5, None)], "doc_id long, content binary"))
    masked = office.redact_docx(rows, policy.PROFILES["file_workbench"])
    got = {r.doc_id: r for r in office.docx_texts(masked, "content", "mapping", "error").collect()}
    assert {i: (r.error, r.content is None) for i, r in got.items()} == {1: (None, False), None: (None, False), 2: (None, False), 3: ("reserved_placeholder", True), 4: ("not_docx", True), 5: (None, True)}
    assert [tuple(b) for b in got[1].blocks] == [(1, "word/document.xml", 0, "a <CONTACT_001>"), (2, "word/document.xml", 2, "<CONTACT_002> <CONTACT_001>")]
    assert [tuple(m) for m in got[1].mapping] == [("<CONTACT_001>", "CONTACT", "13800000001", 2), ("<CONTACT_002>", "CONTACT", "13800000002", 1)]
    assert got[None].blocks[0].text == "<CONTACT_001>" and got[2].blocks[0].text == "nothing" and got[2].mapping == []
    back = office.refill_docx_rows(masked.where("content IS NOT NULL"), "error")
    whole = {r.doc_id: [b.text for b in r.blocks] for r in office.docx_texts(back).collect()}
    assert whole == {1: ["a 13800000001", "13800000002 13800000001"], None: ["13800000003"], 2: ["nothing"]}
    blocked = office.redact_docx(rows, policy.Profile("b", actions={"CONTACT": "block"}, use_model=False))
    assert {r.doc_id: r.error for r in blocked.collect()} == {1: "blocked", None: "blocked", 2: None, 3: "reserved_placeholder", 4: "not_docx", 5: None}


def test_xml_as_before():
    from xml.etree import ElementTree

    from umbra.sources import office

    root = ElementTree.fromstring('<a xmlns:w="urn:x"><w:b c="&quot;&#10;">长 &lt;é&amp;\n\r</w:b>z</a>')
    assert office._xml(root) == ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def test_spans_in_clear_are_told_alike_in_tasks_and_columns(spark):
    labels = sorted({r.label for r in patterns.RULES} | {k for p in policy.PROFILES.values() for k in (*p.deny, *p.only, *p.generalize, *p.actions)} | {"OTHER"})
    rows = spark.createDataFrame([(a, b, k) for a in labels for b in (None, "low", "medium", "high", "critical", "odd") for k in (False, True)], "label string, risk_level string, whole boolean")
    odd = policy.Profile("odd", deny=("DATE",), only=("ORG", "DATE", "AMOUNT"), generalize={"AMOUNT": "amount_bucket", "DATE": "quarter"}, actions={"DATE": "warn", "CREDENTIAL": "block"}, min_risk="high")
    for p in (*policy.PROFILES.values(), odd):
        for r in rows.withColumn("action", policy.decide(p, whole_key=F.col("whole"))).collect():
            assert policy.kept(p, r.label, r.risk_level, r.whole) == (r.action in ("redact", "generalize", "block")), (p.name, r)
