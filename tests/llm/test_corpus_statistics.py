"""Phrases, source mixes and token alignments against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import alignment, bpe, collocations, mixing


def prose(n: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return "".join(r.choice(["Ab ", "ba\t", "Ço, ", "du ", "el\n", "fi! ", "  "], n))


PHRASES = ["we saw New York; ", "x y z w v. ", "New York ", "a a a a a a "]
TEXTS = [(1, None, "en"), (2, "", None), (3, " \t ", "und"), (4, "".join(PHRASES) * 12, "en"), (4, "".join(PHRASES) * 12, "en"), (5, PHRASES[1] * 40, None), (6, prose(4000, 1), "de"), (7, prose(300, 2), "en"), (8, "no-ends " * 300, "a\tb\nc")]


def mined(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, of in f.items():
        kept = []
        for p, a in of.items():
            if len(p) < 2 or a < least:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and b >= least and inside(q) and 100 * b >= 80 * a for q, b in of.items()):
                continue
            score, _, l, r = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), l, r))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


@pytest.mark.parametrize(("block", "entries"), [(8 << 20, 200_000), (300, 5)])
def test_collocations(spark, monkeypatch, block, entries):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "BUCKET_ENTRIES", entries)
    docs = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, lang string, n long, words string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=10, top=7).collect())
    assert got == mined(TEXTS, 10, 7)
    assert any(r[2] == "new york" for r in got) and any(r[0] == "a\tb\nc" for r in got)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "one two", None)], "doc_id long, text string, lang string")).count() == 0


def test_blocks_are_told_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_ENTRIES", 3)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 60)) + " w1 w2 w3 w4 w5", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    send = collocations.send_phrases
    monkeypatch.setattr(collocations, "send_phrases", lambda made, told, *a: send(made, told.repartition(5, F.rand(1)), *a))
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=300).collect()) == mined(rows, 4, 300)


def test_long_text_is_cut_after_ends(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 10)
    for text in (b"", b"abc", b"abcdefghijklmnop", b"ab.cd,ef;ghijklmnopqrstuvwxyz.a", b"........................"):
        parts = collocations.cut_long(text)
        assert b"".join(parts) == text and all(p[-1:] in b".,;" for p in parts[:-1])


def by_hand(rows: list[tuple]) -> dict:
    """source: (size, target) by resharing until nothing is over."""
    size: dict = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, live = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), list(names)
    while left > 1e-9 and live:
        whole = sum(weight[s] for s in live)
        for s in live:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - 2 * size[s]) for s in live)
        full = [s for s in live if target[s] >= 2 * size[s]]
        for s in full:
            target[s] = 2.0 * size[s]
        live = [s for s in live if s not in full]
    return {s: (size[s], target[s]) for s in names}


MIXED = [(1, None, "a"), (2, "", "a"), (3, "x " * 500, "a"), (3, "x " * 500, "a"), (4, "one\x0btwo three", "é"), (5, "y z", None), (6, "p q r", None), (7, "  ", "empty"), (None, "w " * 40, "b"), (None, "w " * 40, "b"), (None, "v", "b")]


@pytest.mark.parametrize("rows", [MIXED, [(i, "word " * (i % 90), f"s{i % 7 if i % 3 else 0}") for i in range(900)], [(1, "a b c", "x")], [(1, None, None)]])
def test_mix(spark, rows):
    docs = spark.createDataFrame([(*r, 9, 1.5) for r in rows], "doc_id long, text string, source string, size long, target double").repartition(3)
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in mixing.mix(docs.repartition(2)).collect())))
    want = by_hand(rows)
    assert len(got) == len(rows)
    for source, (size, target) in want.items():
        own = [r for r in got if r[1] == source]
        assert {r[3] for r in own} == {size} and all(math.isclose(r[4], target, abs_tol=1e-6) for r in own)
        assert sum(r[5] for r in own) == math.floor(own[0][4])
        assert all(0 <= r[5] <= 2 * r[2] for r in own)
        if size:  # whole epochs and a rest, for all but one row
            epochs = math.floor(own[0][4]) // size
            assert sum(r[5] not in (epochs * r[2], (epochs + 1) * r[2]) for r in own) <= 1


def test_mix_of_nothing_and_sql(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    rows = [r for r in MIXED if r[0] is not None]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", made.toPandas())
    want = sorted(con.execute(mixing.SQL).fetchall())
    assert want == sorted(tuple(r) for r in mixing.mix(made).drop("source").collect())


def test_materialized_mix(spark):
    docs = spark.createDataFrame([(i, f" w{i} \n b  c d ", "abc"[i % 3], 1) for i in range(30)], "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs).select("doc_id", "size", "taken")
    out = mixing.materialized(docs, mixed).collect()
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert set(mixing.materialized(docs, mixed).columns) == {*docs.columns, "epoch"}


ALIGNED = [(1, "a b  c "), (2, None), (3, ""), (4, " "), (5, "  x\n\n y　 z   q"), (6, "a▁b c"), (7, "<|endoftext|> hi <s> </s>"), (8, "x" * 3000 + " é" * 50), (9, "\x00 \t\t a\r\n b "), (10, "漢字 かな 한국어 👩‍👩‍👧 it's o'clock"), (11, "the cat " * 9000), (11, "a b  c "), (None, "we don't  know")]


def encoded(rows: list[tuple]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_file(alignment.A_FILE))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_file(alignment.B_FILE))
    letters, found, count = alignment.byte_alphabet(), [], Counter()
    for i, x in rows:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        a_bytes = [bytes(letters[c] for c in t.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [sp.id_to_piece(k)]]
        if not x or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + x).encode():
            found.append((i, [], [], [], []))
            continue
        ends = {e: k for k, e in enumerate(np.cumsum([len(y) for y in a_bytes]).tolist())}
        groups, links, la, lb = [], [], 0, 0
        for k, e in enumerate(np.cumsum([len(y) for y in b_bytes]).tolist()):
            if e in ends:
                groups.append(",".join(map(str, a[la : ends[e] + 1])) + "|" + ",".join(map(str, b[lb : k + 1])))
                links.append((a[ends[e]], b[k]))
                la, lb = ends[e] + 1, k + 1
        count.update(links)
        found.append((i, a, b, groups, links))
    best: dict = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, len(a), len(b), len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, ls in found]


def test_alignment(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ALIGNED], "doc_id long, text string, n_a int, links string").repartition(3)
    assert sorted(map(str, (tuple(r) for r in alignment.align(docs).collect()))) == sorted(map(str, encoded(ALIGNED)))
    assert alignment.align(docs.limit(0)).count() == 0


def test_runs_remembered_anew(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    monkeypatch.setattr(alignment, "CALL_BYTES", 4)
    pair = alignment.Pair(bpe.vocabulary_file(alignment.A_FILE), bpe.vocabulary_file(alignment.B_FILE))
    runs = [b" the", b" cat", b"  x", b" ", " a▁b".encode(), b" it's", b" \n"]
    first = pair.of(runs)
    assert first[4] is None and first == [pair.of([r])[0] for r in runs]
