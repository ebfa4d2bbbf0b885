"""Driver-side parts and file formats that no table query reaches."""

from __future__ import annotations

import io
import zipfile

import pytest

from umbra.operators import detect, policy, store
from umbra.sources import office


def test_profiles_by_name_and_dimensions():
    assert policy.declared({}).name == "strict"
    assert policy.declared({"sensitivity": "light", "scenario": "contract"}).name == "contract"
    assert policy.declared({"profile": {"base": "kb", "min_risk": "high"}, "scenario": "contract"}).min_risk == "high"
    with pytest.raises(ValueError, match="unknown profile"):
        policy.declared({"profile": "nothing"})
    for p in policy.PROFILES.values():
        assert policy.from_dimensions(policy.dimensions(p)) == p
    parts = policy.dimensions(policy.PROFILES["strict"])
    parts["mapping"]["mode"] = "namespace"
    with pytest.raises(ValueError, match="namespace"):
        policy.from_dimensions(parts)
    versions = {policy.version(p) for p in policy.PROFILES.values()}
    assert len(versions) == len(policy.PROFILES) and all(v.startswith("sha256:") for v in versions)


def test_declared_labels():
    policy.check_declared_labels(policy.PROFILES["strict"], ("PROJECT_NAME",))
    with pytest.raises(ValueError, match="AMOUNT"):
        policy.check_declared_labels(policy.PROFILES["contract"], ("AMOUNT",))


def test_required_model_fails_closed(spark):
    docs = spark.createDataFrame([(1, "电话13812345678")], "doc_id long, text string")
    with pytest.raises(detect.ModelRequired):
        detect.detect(docs, policy.PROFILES["strict"])
    assert detect.detect(docs, policy.PROFILES["file_workbench"]).count() == 1
    found = spark.createDataFrame([(1, 0, 2, "ORG", 0.9), (1, 0, 99, "ORG", 0.9)], "doc_id long, start int, end int, label string, score double")
    assert detect.detect(docs, policy.PROFILES["strict"], found).count() == 2


def test_docx_patch_and_probe(spark):
    docs = spark.createDataFrame([(1, "first line\n\nthe second")], "doc_id long, text string")
    made = office.write_docx(docs)
    change = spark.createDataFrame([(1, "word/document.xml", 2, 4, 10, "<ORG_001>")], "doc_id long, part string, paragraph int, start int, end int, replacement string")
    assert [(r.paragraph, r.text) for r in office.docx_blocks(office.patch_docx(made, change)).collect()] == [(0, "first line"), (2, "the <ORG_001>")]
    raw = io.BytesIO(bytes(made.first().content))
    with zipfile.ZipFile(raw, "a") as z:
        z.writestr("word/comments.xml", "<c/>")
    bad = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"no zip"))], "doc_id long, content binary")
    assert {r.doc_id: (r.part, r.text) for r in office.docx_blocks(bad).collect()} == {1: ("comments", None), 2: ("not_docx", None)}


def test_files_by_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two\n", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(bytes(office.write_docx(spark.createDataFrame([(1, "p")], "doc_id long, text string")).first().content))
    good, bad = office.files(spark, str(tmp_path))
    assert sorted((r.format, r.locator, r.text) for r in good.collect()) == [(".docx", "word/document.xml#p0", "p"), (".txt", "line1", "one"), (".txt", "line3", " two")]
    assert [r.reason for r in bad.collect()] == ["unsupported_format"]


def test_sealed_values_are_bound_to_their_name(spark):
    rows = spark.createDataFrame([(1, "<ORG_001>", "ORG", "v", "h")], "doc_id long, placeholder string, label string, original_value string, text_hash string")
    sealed = store.seal(rows, bytes(32))
    assert store.unseal(sealed, bytes(32)).first().original_value == "v"
    with pytest.raises(Exception, match="(?i)aes|tag|decrypt"):
        store.unseal(sealed.selectExpr("doc_id", "'other' AS name", "sealed"), bytes(32)).collect()
