"""The pipeline's stages on tables with nulls, empty and repeated rows, ties, shared ids and columns with clashing names, and on empty tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from test_llm import LOW, WORDS, components_by_hand, library, prose

import corpus_pipeline

BAD = " you stupid idiot! pathetic scum, you worthless moron"
LEAK = prose(30, 501)
SHARED = prose(60, 502)
KIND = "doc_id long, text string, lang string, source string, n_chars long, row int, score string, spans string, __of int"


def fixture_rows() -> list[tuple]:
    texts = {}
    for i in range(300):
        texts[i] = prose(40, 600 + i) + (BAD if i % 5 == 0 else "")
    base = prose(150, 503)
    texts |= {300: base, 301: base, 302: base + " more", 303: "start " + base, 310: None, 311: "", 312: "  \n", 313: "ok"}
    texts |= {320: prose(50, 504) + " " + LEAK + " " + prose(20, 505), 321: prose(50, 506)}
    texts |= {330: prose(50, 507) + " " + SHARED + " " + prose(50, 508), 331: prose(70, 509) + " " + SHARED + " " + prose(60, 510)}
    rows = [(i, t) for i, t in texts.items()] + [(None, prose(45, 511)), (None, None), (300, prose(45, 512)), (301, base)]
    return [(i, t, "en", "s", len(t) if t is not None else None, 7, "x", "y", 1) for i, t in rows]


def tables(spark, folder, rows, labels, bench) -> str:
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def hit(text: str | None) -> bool:
    words, bench = (WORDS.findall((t or "").encode().translate(LOW)) for t in (text, LEAK))
    windows = {tuple(bench[k : k + 10]) for k in range(len(bench) - 9)}
    return any(tuple(words[k : k + 10]) in windows for k in range(len(words) - 9))


def cut(texts: list[str | None]) -> list[str | None]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for t, b in zip(texts, raw, strict=True):
        gone = set()
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        out.append(t if not gone else "".join(x.decode("utf-8", "ignore") for x in _runs(b, gone)))
    return out


def _runs(b: bytes, gone: set[int]) -> list[bytes]:
    out, run = [], bytearray()
    for k, x in enumerate(b):
        if k in gone:
            out, run = [*out, bytes(run)], bytearray()
        else:
            run.append(x)
    return [*out, bytes(run)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)]
    return tables(spark, tmp_path_factory.mktemp("tables"), fixture_rows(), labels, [(1, LEAK), (2, None), (None, "")])


def test_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_array_dedup", "decontamination", "bpe"]
    left = docs
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    want = sorted((r.asDict() for r in docs.collect()), key=key)
    want = [r for r in want if BAD not in (r["text"] or "")]
    for name in ("toxicity", "near_dedup", "suffix_array_dedup", "decontamination"):
        if name == "near_dedup":
            texts = [r["text"] or "" for r in want]
            group = components_by_hand(texts)
            first: dict[object, int] = {}
            kept = []
            for i, r in enumerate(want):
                same = ("null", i) if r["text"] is None else next((("text", j) for j in range(i) if texts[j] == texts[i] and want[j]["text"] is not None), ("class", group[i]))
                same = ("class", group[same[1]]) if same[0] == "text" else same
                if same not in first:
                    first[same] = i
                    kept.append(r)
            want = kept
        if name == "suffix_array_dedup":
            for r, t in zip(want, cut([r["text"] for r in want]), strict=True):
                if t != r["text"]:
                    r["text"], r["n_chars"] = t, len(t)
            want = sorted(want, key=key)
        if name == "decontamination":
            want = [r for r in want if not hit(r["text"])]
        left = stages[name](spark, left, folder)
        assert left.columns == columns, name
        got = sorted((r.asDict() for r in left.collect()), key=key)
        assert [(r["doc_id"], r["text"], r["n_chars"]) for r in got] == [(r["doc_id"], r["text"], r["n_chars"]) for r in want], name
        assert all((r["row"], r["score"], r["spans"], r["__of"]) == (7, "x", "y", 1) for r in got), name
    t = library()
    digests = []
    for r in want:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        digests.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(out) == sorted(digests)


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
