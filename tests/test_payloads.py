"""Chat payloads, batches, samples, dictionaries, block trees and mappings, by hand."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra.operators import chat, dictionary, fusion, policy, store
from umbra.sources import office, readers

OPEN = policy.PROFILES["file_workbench"]
TEL, MAIL = "13812345678", "a@b.example"


def test_chat_shapes(spark):
    payload = {
        "model": TEL, "system": f"s {TEL}", "tools": [{"name": TEL, "description": f"d {MAIL}", "schema": {"properties": {"description": {"type": TEL, "description": f"p {TEL}"}}}}],
        "messages": [
            {"role": "system", "content": f"sys {TEL}"}, {"role": "user", "content": f"u {TEL}"}, "odd", {"role": "user", "content": None},
            {"role": "assistant", "content": [{"type": "text", "text": f"t {MAIL}"}, {"type": "image", "text": TEL}, {"type": "tool_use", "id": TEL, "input": {TEL: [f"i {TEL}", 5, None]}}, {"type": "tool_result", "content": [{"type": "output_text", "text": f"r {TEL}"}]}, 7], "reasoning_content": f"think {TEL}"},
            {"role": "assistant", "tool_calls": [{"function": {"name": TEL, "arguments": json.dumps({"to": TEL})}}, {"function": {"arguments": {"to": [TEL]}}}, {"id": 1}, 3]},
        ],
    }
    rows = [(1, json.dumps(payload)), (2, "not json"), (3, "[1]"), (4, None), (5, json.dumps({"messages": [{"role": "user", "content": "has <ORG_001>"}]})), (6, json.dumps({"messages": [{"role": "user", "content": ""}]}))]
    done, mapped = chat.masked(spark.createDataFrame(rows, "doc_id long, payload string"), OPEN)
    got = {r.doc_id: r for r in done.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "invalid_json", 3: "invalid_json", 4: "invalid_json", 5: "reserved_placeholder", 6: "ok"}
    assert got[5].payload is None and json.loads(got[6].payload) == json.loads(rows[5][1])
    t, m = "<CONTACT_002>", "<CONTACT_001>"
    want = json.loads(json.dumps(payload))
    want["tools"][0]["description"], want["tools"][0]["schema"]["properties"]["description"]["description"] = f"d {m}", f"p {t}"
    want["messages"][1]["content"] = f"u {t}"
    blocks = want["messages"][4]["content"]
    blocks[0]["text"], blocks[2]["input"], blocks[3]["content"][0]["text"] = f"t {m}", {TEL: [f"i {t}", 5, None]}, f"r {t}"
    want["messages"][4]["reasoning_content"] = f"think {t}"
    want["messages"][5]["tool_calls"][0]["function"]["arguments"] = json.dumps({"to": t})
    want["messages"][5]["tool_calls"][1]["function"]["arguments"] = {"to": [t]}
    assert json.loads(got[1].payload) == want
    assert {(r.doc_id, r.placeholder, r.original_value, r.n) for r in mapped.collect()} == {(1, m, MAIL, 2), (1, t, TEL, 7)}
    system = json.loads(chat.masked(spark.createDataFrame(rows[:1], "doc_id long, payload string"), OPEN, system_too=True)[0].first().payload)
    assert system["system"] == "s <CONTACT_001>" and system["messages"][0]["content"] == "sys <CONTACT_001>"


def test_null_ids_leak_nothing(spark):
    payload = json.dumps({"messages": [{"role": "user", "content": TEL}]})
    done, _ = chat.masked(spark.createDataFrame([(None, payload)], "doc_id long, payload string"), OPEN)
    assert TEL not in done.first().payload
    docs = spark.createDataFrame([(None, f"甲 {TEL}")], "doc_id long, text string")
    given = spark.createDataFrame([(None, 0, 1, "ORG", "manual")], "doc_id long, start int, end int, label string, source string")
    assert fusion.redacted(fusion.run(docs, OPEN, spans=[given])).first().redacted_text == "<ORG_001> <CONTACT_001>"


def test_batches(spark):
    rows = [("a", 1, f"x {TEL}"), ("a", 2, f"y {MAIL} {TEL}"), ("b", 1, TEL), ("b", 1, TEL), ("c", 1, TEL), ("c", 2, "<ORG_001>"), ("d", 1, None), (None, 1, TEL)]
    items = spark.createDataFrame(rows, "batch_id string, item_id int, text string")
    got = {(r.batch_id, r.item_id): (r.status, r.redacted_text) for r in fusion.redact_batches(items, OPEN, shared=True).collect()}
    assert got == {("a", 1): ("ok", "x <CONTACT_001>"), ("a", 2): ("ok", "y <CONTACT_002> <CONTACT_001>"), ("b", 1): ("ids_not_unique", None), ("c", 1): ("reserved_placeholder", None), ("c", 2): ("reserved_placeholder", None), ("d", 1): ("ok", None), (None, 1): ("ok", "<CONTACT_001>")}
    each = {(r.batch_id, r.item_id): r.redacted_text for r in fusion.redact_batches(items, OPEN).collect()}
    assert each["a", 2] == "y <CONTACT_001> <CONTACT_002>"
    blocking = policy.Profile("b", actions={"CONTACT": "block"}, use_model=False)
    assert {r.status for r in fusion.redact_batches(items.where("batch_id = 'a'"), blocking).collect()} == {"blocked"}


def test_samples_have_their_line_number(spark, tmp_path):
    good = {"sample_id": "s", "text": "甲乙丙", "gold_spans": [{"start": 1, "end": 2, "text": "乙", "label": "ORG", "category": "known"}]}
    lines = [json.dumps(good, ensure_ascii=False), "", "{broken", json.dumps(good | {"gold_spans": [{"start": 0, "end": 2, "text": "乙"}]}), json.dumps({"sample_id": "n"}), "  ", json.dumps({"sample_id": "t", "text": "x"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # a line number goes over parts of a file
    try:
        ok, bad = readers.numbered_samples(spark, str(tmp_path / "a.jsonl"))
        assert [(r.line_no, r.sample_id) for r in ok.orderBy("line_no").collect()] == [(1, "s"), (7, "t")]
        assert [(r.line_no, r.reason) for r in bad.orderBy("line_no").collect()] == [(3, "malformed"), (4, "span_mismatch"), (5, "no_text")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dictionaries_in_order(spark, tmp_path):
    for name, values in (("b", ["一"]), ("a", ["二", "三"])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"entry_id": v, "canonical_value": v, "label": "ORG"} for v in values], ensure_ascii=False), encoding="utf-8")
    paths = [str(tmp_path / "b.json"), str(tmp_path / "a.json")]
    entries, version = readers.merged_dictionary(spark, *paths)
    assert [r.entry_id for r in entries.orderBy("file_no", F.monotonically_increasing_id()).collect()] == ["一", "二", "三"]
    assert version.first().version == "sha256:" + hashlib.sha256(b"".join((tmp_path / f"{n}.json").read_bytes() for n in "ba")).hexdigest()
    assert readers.content_version(spark, *reversed(paths)).first().version != version.first().version


def test_issues(spark):
    rows = [("e1", "ORG", "经江城公司", None, "active"), ("e1", "ORG", "土地管理部门", ["甲，乙", " "], None), ("e2", "PERSON", "张，三", None, "active"), ("e3", "ORG", "公司", None, "retired"), ("e4", "ADDRESS", "长" * 81, ["土地管理部门"], "active")]
    got = {(r.code, r.entry_id, r.label, r.field) for r in dictionary.issues(spark.createDataFrame(rows, "entry_id string, label string, canonical_value string, aliases array<string>, status string")).collect()}
    assert got == {("context_prefix", "e1", "ORG", "canonical_value"), ("generic_fragment", "e1", "ORG", "canonical_value"), ("sentence_punctuation", "e1", "ORG", "aliases[0]"), ("value_too_long", "e4", "ADDRESS", "canonical_value"), ("entry_id_duplicate", "e1", None, None), ("label_conflict", "e1,e4", "ADDRESS,ORG", None)}


def test_block_tree(spark):
    rows = [(1, "b2", 1, "two", None, None, None, None, None), (1, "b1", 1, "one\nmore", "paragraph", None, None, None, None), (1, "h", 0, " A\n B ", "heading", 9, None, None, None), (1, "x", 0, "\t", "paragraph", None, None, None, None), (1, "n", 2, "note", "ancillary", None, None, None, None),
            (1, "c1", 3, "a|b", "cell", None, "t", 0, 0), (1, "c2", 4, None, "cell", None, "t", 2, 1), (1, "z", 3, "end", "paragraph", None, None, None, None), (2, "q", 1, "", None, None, None, None, None)]
    tree = spark.createDataFrame(rows, "doc_id int, block_id string, order int, text string, kind string, level int, table_id string, row int, col int")
    text, lines = readers.block_tree(tree)
    assert {r.doc_id: r.markdown for r in text.collect()} == {1: "###### A B\n\none\nmore\n\ntwo\n\n| a\\|b |  |\n| --- | --- |\n|  |  |\n|  |  |\n\nend\n"}
    assert {(r.block_id, r.first_line, r.last_line) for r in lines.collect()} == {("h", 1, 1), ("b1", 3, 4), ("b2", 6, 6), ("c1", 8, 11), ("c2", 8, 11), ("z", 13, 13)}
    assert "note" in readers.block_tree(tree, ancillary=True)[0].first().markdown
    assert readers.block_tree(tree.limit(0))[0].count() == 0


def test_mapping_sink(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"{TEL} {MAIL} {TEL}")], "doc_id long, text string")
    mapped = fusion.mapping(fusion.redacted(fusion.run(docs, OPEN)))
    store.write_mapping(mapped, str(tmp_path / "m"))
    assert sorted(map(str, store.read_mapping(spark, str(tmp_path / "m")).collect())) == sorted(map(str, mapped.select("doc_id", "placeholder", "label", "original_value", "text_hash", "n").collect()))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.write_mapping(mapped, str(tmp_path / "m"))


def word_file(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{"".join(f"<w:p>{p}</w:p>" for p in paragraphs)}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"\x89PNG")
    return out.getvalue()


def run_of(text: str, bold: bool = False) -> str:
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t xml:space=\"preserve\">{text.replace('<', '&lt;')}</w:t></w:r>"


def test_docx_refill(spark):
    files = {
        1: word_file(run_of("to <ORG_001> and ") + run_of("<ORG_002>!", True), run_of("<ORG_001>")), 2: word_file(run_of("to <ORG") + run_of("_001>", True)), 3: word_file(run_of("<ORG_009> <org 1> ORG_001")), 4: word_file(run_of("nothing")), 5: b"no file",
    }
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "doc_id int, content binary")
    mapped = spark.createDataFrame([(i, p, v) for i in (1, 2, 3) for p, v in (("<ORG_001>", "甲 <ORG_002> & co"), ("<ORG_002>", "乙"))], "doc_id int, placeholder string, original_value string")
    got = {r.doc_id: r for r in office.refill_docx(table, mapped).collect()}
    assert {i: (r.status, r.restored, r.unknown, r.altered, r.split) for i, r in got.items()} == {1: ("ok", 3, [], [], []), 2: ("blocked", 0, [], [], ["<ORG_001>"]), 3: ("blocked", 0, ["<ORG_009>"], ["<org 1>", "ORG_001"], []), 4: ("ok", 0, [], [], []), 5: ("refused", 0, [], [], ["not_docx"])}
    back = {(r.paragraph, r.text) for r in office.docx_blocks(spark.createDataFrame([(1, bytearray(got[1].content))], "doc_id int, content binary")).collect()}
    assert back == {(0, "to 甲 <ORG_002> & co and 乙!"), (1, "甲 <ORG_002> & co")}
    assert zipfile.ZipFile(io.BytesIO(got[1].content)).read("word/media/image1.png") == b"\x89PNG" and got[2].content is None


def test_docx_ledger(spark):
    table = spark.createDataFrame([(1, bytearray(word_file(run_of("abc") + run_of("def", True) + run_of("ghi", True))))], "doc_id int, content binary")
    rows = [(0, 0, 2), (0, 1, 3), (0, 2, 5), (0, 4, 8), (0, 8, 12), (0, 9, 9), (1, 0, 1)]
    replaced = spark.createDataFrame([(1, "word/document.xml", *r, "x") for r in rows], "doc_id int, part string, paragraph int, start int, end int, replacement string")
    got = [(r.paragraph, r.start, r.end, r.first_node, r.last_node, r.format_mixed, r.problem) for r in office.docx_ledger(table, replaced).collect()]
    assert sorted(got, key=lambda r: r[:3]) == [(0, 0, 2, 0, 0, False, None), (0, 1, 3, 0, 0, False, "overlap"), (0, 2, 5, 0, 1, True, "overlap"), (0, 4, 8, 1, 2, False, "overlap"), (0, 8, 12, 2, 2, False, "out_of_range"), (0, 9, 9, None, None, False, "empty"), (1, 0, 1, None, None, None, "no_such_paragraph")]


def test_normalize(spark):
    key = "-----BEGIN PRIVATE KEY-----\nQUJD\n-----END PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"甲方公司 {key} z"), (2, "短"), (3, key[:40])], "doc_id long, text string")
    given = spark.createDataFrame([(1, 0, 4, "ORG", "manual"), (1, 0, 4, "ORG", "manual"), (1, 2, 30, "PERSON", "dictionary"), (2, 0, 9, "ORG", "manual")], "doc_id long, start int, end int, label string, source string")
    got = {r.doc_id: r for r in fusion.normalize(docs, given).collect()}
    assert [(s.start, s.end, s.label, s.clipped) for s in got[1].spans] == [(0, 4, "ORG", False), (5, 5 + len(key), "CREDENTIAL", False)]
    assert got[1].spans[1].text_hash == "sha256:" + hashlib.sha256(key.encode()).hexdigest()
    assert (got[2].error, got[3].error) == ("span_out_of_bounds", "incomplete private key block")


def test_audit_lines(spark, tmp_path):
    rows = spark.createDataFrame([(i, "mask") for i in range(5)], "n long, event string")
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    store.append_audit(rows, str(tmp_path), "calls", now)
    store.append_audit(rows, str(tmp_path), "calls", now)
    lines = spark.read.text(str(tmp_path / "stream=calls")).collect()
    assert len(lines) == 10 and all(json.loads(r.value)["event"] == "mask" and json.loads(r.value)["at"].startswith("2024-01-02T03:04:05") for r in lines)
    with pytest.raises(ValueError, match="bad stream name"):
        store.append_audit(rows, str(tmp_path), "../calls", now)


def test_ingested_files(spark, tmp_path):
    book = office.write_xlsx(spark.createDataFrame([(1, [["a", None], ["b & c", "d"]])], "doc_id int, rows array<array<string>>")).first().content
    hidden = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(hidden, "w") as new:
        for item in old.infolist():
            new.writestr(item.filename, old.read(item.filename).replace(b"<sheetData>", b'<cols><col min="2" max="2" hidden="1"/></cols><sheetData>'))
    contents = {"a.txt": "一\n\n二x".encode(), "copy/a.md": "一\n\n二x".encode(), "b.docx": word_file(run_of("para")), "c.xlsx": book, "d.xlsx": hidden.getvalue(), "e.pdf": b"%PDF", "f.csv": b" \n", "g.docx": word_file("<w:ins/>")}
    for name, raw in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r for r in office.ingested(spark, str(tmp_path)).collect()}
    assert {k: (r.blocks, r.chars, r.warnings, r.error) for k, r in got.items()} == {
        "a.txt": (2, 3, [], None), "a.md": (2, 3, [], None), "b.docx": (1, 4, [], None), "c.xlsx": (3, 7, [], None), "d.xlsx": (3, 7, ["hidden_columns"], None), "e.pdf": (0, 0, [], "unsupported_format"), "f.csv": (0, 0, ["empty"], None), "g.docx": (0, 0, [], "tracked_changes"),
    }
    assert got["a.txt"].source_uid == got["a.md"].source_uid != got["b.docx"].source_uid and got["a.txt"].sha256 == hashlib.sha256(contents["a.txt"]).hexdigest()
