"""Cases at the edge that other tests leave out: null and repeated keys in a ring, long toxic texts, clashing names, texts beyond a limit."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from umbra.llm import bpe, media, phrases, ppm, sharding, substrings, toxicity


def test_ring_with_null_and_repeated_keys(spark):
    rows = [(None, 3)] * 40 + [(7, 1)] * 70 + [(i, i % 5) for i in range(91)] + [(None, None)] * 3
    got = [tuple(r) for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, size long").repartition(5), "doc_id", 16).collect()]
    assert Counter(r[:2] for r in got) == Counter(rows)
    counts = Counter(r[2] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    assert {(s, k) for _, _, s, k in got} == {(s, k) for s in counts for k in range(counts[s])}
    assert sharding.assign(spark.createDataFrame([], "doc_id long, size long"), "doc_id", 16).count() == 0


def test_long_and_repeated_toxic_texts(spark):
    insult = " you stupid idiot, pathetic scum!"
    rows = [(i, f"words {i} about nothing at all" + (insult if i % 4 == 0 else "")) for i in range(200)]
    rows += [(900, insult * 20_000), (901, "quiet words " * 60_000), (901, "quiet words " * 60_000), (None, insult * 5), (902, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, held_out string, __score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 900] == [1] and [r.predicted for r in got if r.doc_id == 901] == [0, 0]
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 901").count() == 2 and left.where("doc_id IS NULL").count() == 0


def test_decode_and_probe_with_clashing_names(spark):
    table = spark.createDataFrame([(1, "own text", [320, 1125], "own ids"), (2, "x", None, "y"), (3, "z", [49406, -1, 999999], "w")], "doc_id long, text string, tokens array<int>, ids string")
    back = {r.doc_id: r.text for r in bpe.decode(table, "tokens").collect()}
    strings = bpe.loaded(bpe.vocabulary_file())[0].strings
    assert back == {1: f"{strings[320]} {strings[1125]}", 2: "", 3: "<|startoftext|>  "}
    stream = media.pack(media.padded(b"abc"))
    made = spark.createDataFrame([(1, bytearray(stream), "mine", 4.5), (2, None, "mine", None), (3, bytearray(b"junk"), "mine", 0.0)], "doc_id long, sound binary, seconds string, media double")
    got = {r.doc_id: r for r in media.probe(made, "sound").collect()}
    assert got[1].n_frames == len(media.parse(stream)["offsets"]) > 0 and got[1].seconds > 0 and got[1].media == 4.5
    assert got[2].n_frames == got[3].n_frames == 0 and got[3].junk_bytes == 4


def test_text_beyond_the_limit_is_refused(monkeypatch):
    monkeypatch.setattr(phrases, "MOST", 500)
    data = np.frombuffer(b"abcdefghij" * 100, np.uint8)
    with pytest.raises(ValueError, match="a text of 1000 bytes is too long"):
        phrases.phrases(phrases.Rolling(data), np.array([0, 1000]), 200, 16)


def test_lookup():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        numbers = np.unique(np.concatenate([rng.integers(0, 1 << 60, n), np.arange(n) << 40]))
        table = ppm.Lookup(numbers, numbers / 3.0)
        asked = rng.choice(numbers, 3 * n) if n else numbers
        assert (table.of(asked) == asked / 3.0).all()
    with pytest.raises(KeyError):
        ppm.Lookup(np.arange(5), np.arange(5.0)).of(np.array([3, 9]))


def test_repeats_are_cut_in_every_step_of_a_batch():
    own = [[{"lo": 0, "hi": 1}], [{"lo": 2, "hi": 2}, {"lo": 6, "hi": 6}], [], [{"lo": 1, "hi": 3}], None, [{"lo": 4, "hi": 4}]]
    for some in (own, [x or [] for x in own]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abcdefghij"] * 6), pa.array(some, pa.list_(pa.struct({"lo": pa.int64(), "hi": pa.int64()})))], ["row", "text", "own"])
        want = [[(0, 4)], [(2, 5), (6, 9)], [], [(1, 6)], [], [(4, 7)]]
        for at in range(6):
            for n in range(1, 7 - at):
                assert [list(zip(a.tolist(), b.tolist(), strict=True)) for _, a, b in substrings._cut(batch.slice(at, n), 3)] == want[at : at + n]
