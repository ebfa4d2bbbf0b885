"""The training-data operators against brute force on a small fixture with nulls, empty texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from umbra.llm import bpe, decontaminate, html_text, media, near_dedup, ppm, sharding, substrings, token_files, toxicity

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(n: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(["an", "be", "ço", "du", "El", "fi"], r.integers(1, 4))) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [None, "", " \n", "Ä", BASE, BASE, BASE + " one more", prose(80, 2) + " " + BASE[:300] + " " + prose(50, 3), "a" * 700, prose(6000, 4), "bad <|endoftext|> İ ǰ́ ǰ don't 12", prose(30, 5)]
ROWS = [(i, t, "x", 5, i) for i, t in enumerate(TEXTS)] + [(4, BASE, "x", 5, 99)]
BENCH = [(1, " ".join(BASE.split()[5:30])), (2, "Ä"), (3, None), (4, ""), (5, " ".join(BASE.split()[5:30]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_words int, seq int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_dedup(spark, docs, none):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    sets = {}
    for i, t, *_ in ROWS:
        w = WORDS.findall((t or "").encode().translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)}
    for i in got:
        near = [j for j in sets if j == i or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
        assert got[i] == min(near)
    assert near_dedup.classes(none).count() == 0
    assert sorted(near_dedup.without_copies(docs).columns) == sorted(docs.columns)


def test_rounds_of_a_mixed_bucket():
    e = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = e[:300], e[60:360]
    s = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 300, 600]), k=1200)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.06
    w = np.concatenate([np.full(300, 2.0), np.full(300, 1.0)])
    s = near_dedup.signatures(np.concatenate([a, a]), np.array([0, 300, 600]), w, k=1200)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.06


def components_by_hand(texts: list[str], similarity: float = 0.8) -> list[int]:
    sets = []
    for t in texts:
        w = WORDS.findall(t.encode().translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)})
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [0, 1])
def test_near_dedup_of_groups_around_the_threshold(spark, seed):
    """Copies with 1 to 14 words changed: many are linked with the group only through some other copy."""
    r = np.random.default_rng(seed)
    texts = []
    for g in range(4):
        base = prose(130 + 40 * g, 90 + g).split()
        for _ in range(60):
            own = list(base)
            for at in r.integers(0, len(own), r.integers(1, 15)):
                own[at] = f"x{r.integers(0, 9 if g % 2 else 10**6)}"
            texts.append(" ".join(own) + (" tail" * int(r.integers(0, 30)) if g == 3 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    want = components_by_hand(texts)
    assert len(set(want)) > 10 and sum(got[i] == want[i] for i in range(len(texts))) == len(texts)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_decontamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), tuple(r["items"])) for r in decontaminate.scan(docs, bench).collect())
    windows = {}
    for i, t in BENCH:
        w = WORDS.findall((t or "").encode().translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t, *_ in ROWS:
        w, hit, items = WORDS.findall((t or "").encode().translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        want.append((i, len(w), len(hit), tuple(sorted(items))))
    assert got == sorted(want)


def test_cut_spans(spark, docs):
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    left = decontaminate.cut_spans(docs, bench)
    assert left.columns == docs.columns
    got = {(r.doc_id, r.seq): r.text for r in left.collect()}
    part = BENCH[0][1]
    assert got == {(i, q): t and t.replace(part, "") for i, t, _, _, q in ROWS}


def test_empty_benchmark(spark, docs):
    assert decontaminate.without_spans(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_file())


def test_bpe(docs, none):
    t = library()
    for r in bpe.digest(docs).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(none).count() == 0


@pytest.mark.parametrize("text", ["", "  a  b ", "İ ǰ́ ǰ don't 12", "ÀÉ× ÷ß Ÿ, x!? 'tis l'eau\0 \0 a\0b", "<|endoftext|>x <|endoftext|>", "café.'s word.'t ok!s É", "áb é́ ", "naïve…, ñ!? ª º µ", "A" * 5000 + ", " + "é" * 3000, "x" * 300 + "\u3000y"])
def test_library_runs(text):
    own = token_files.library(bpe.vocabulary_file())
    data = (text + prose(5, 1)).encode()
    ids, ends = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(text.encode()), len(data)]))
    want = library().encode_batch([text, prose(5, 1)], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in want]
    assert token_files.vocabulary_size(bpe.vocabulary_file()) == 49408


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 1001) == ids).all()
    file = token_files.File(token_files.file_bytes([(7, 400), (9, 601)], ids, bits, 64))
    assert (file.ids(130, 700) == ids[130:700]).all() and file.docs.tolist() == [[7, 400], [9, 601]]


def test_token_files(spark, docs, none):
    from umbra.llm import common

    encoded, folder = common.stored(token_files.encode(docs, bpe.vocabulary_file(), 16, 2), "encoded"), common.scratch(spark, "ids")
    got = token_files.read(token_files.write(encoded, folder, 16, file_ids=3000), folder).orderBy("start").collect()
    t, start = library(), 0
    assert [r.doc_id for r in got] == sorted(r[0] for r in ROWS)
    for r in got:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def ppm_by_hand(coded: list[tuple[bytes, bool]], order: int) -> list[float]:
    """log10 of each stream (bytes, held out) by PPM with nested dictionaries, a symbol at a time."""
    places = lambda x: [((b" " + x)[max(0, i + 1 - order) : i + 1], x[i]) for i in range(len(x))]
    counts = [{} for _ in range(order + 1)]
    for x, out in coded:
        for context, symbol in places(x) if not out else []:
            node = counts[len(context)].setdefault(context, Counter())
            node[symbol] += 1
    for k in range(order, 0, -1):  # a shorter context counts the different longer ones that it ends
        for context, node in counts[k].items():
            for symbol in node:
                counts[k - 1].setdefault(context[1:], Counter())[symbol] += 1
    cut = []
    for level in counts:
        few = [sum(x == i for node in level.values() for x in node.values()) + 0.5 for i in range(1, 5)]
        y = few[0] / (few[0] + 2 * few[1])
        cut.append([0] + [min(max(i - (i + 1) * y * few[i] / few[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)])
    out = []
    for x, _ in coded:
        total = 0.0
        for context, symbol in places(x):
            excluded = set()
            while True:
                left = {s: c for s, c in counts[len(context)].get(context, {}).items() if s not in excluded}
                weights = cut[len(context)]
                if symbol in left:
                    total += np.log10((left[symbol] - weights[min(left[symbol], 3)]) / sum(left.values()))
                    break
                if left:
                    total += np.log10(sum(weights[min(c, 3)] for c in left.values()) / sum(left.values()))
                    excluded |= set(left)
                if not context:
                    total -= np.log10(256 - len(excluded))
                    break
                context = context[1:]
        out.append(total)
    return out


@pytest.mark.parametrize(("order", "part_grams"), [(5, 1_000_000), (5, 300), (2, 50)])
def test_ppm(docs, none, monkeypatch, order, part_grams):
    monkeypatch.setattr(ppm, "PART_GRAMS", part_grams)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW)) + [b"\xff"]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    assert any(out.values())
    c = Counter(w for i, t, *_ in ROWS if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = dict(zip([r[0] for r in ROWS], ppm_by_hand([(b" ".join(tokens(t)), out[i]) for i, t, *_ in ROWS], order), strict=True))
    got = ppm.score(docs, order).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = tokens(TEXTS[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score == pytest.approx(want[r.doc_id])
    assert ppm.score(none, order).count() == 0


def test_ppm_blocks_and_untrained(spark, docs, monkeypatch):
    """Small blocks give the same scores; without training texts each symbol costs 1/256."""
    want = sorted((r.doc_id, round(r.score, 6)) for r in ppm.score(docs).collect())
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1000)
    assert sorted((r.doc_id, round(r.score, 6)) for r in ppm.score(docs).collect()) == want
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ppm.score(spark.createDataFrame([(held, " A  b\t")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == pytest.approx(-5 * np.log10(256))


def test_trie_sums_to_one():
    """Over all byte values, the probabilities after any context are 1."""
    data = np.frombuffer(b"abra cadabra ab \xff", np.uint8)
    pairs = Counter()
    for order in range(4):
        pairs.update(ppm.codes(data, np.array([0, len(data)]), order)[max(order - 1, 0) :].tolist())
    code, n = np.array(list(pairs)), np.array(list(pairs.values()))
    low = (1 << ppm.LEVEL) - 1
    trie = ppm.Trie(code >> ppm.LEVEL, code & low, n, np.full((4, 4), 0.4))
    for context in (b"abr", b"rab", b"zzz", b"zab"):
        gram = np.array([int.from_bytes(bytes([b]) + context[::-1], "little") for b in range(256)])
        assert (10 ** trie.predict(np.full(256, 3), gram)).sum() == pytest.approx(1)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substrings.spans, "__defaults__", (200, 48, hot))
    raw = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    c = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if c[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        want.append((i, len(b), sum(mark), sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    assert sorted(tuple(r) for r in substrings.digest(docs).collect()) == sorted(want)
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_substrings_tell_rows_of_an_id_apart(spark):
    """Many texts with one doc_id or none: each loses its own repeats."""
    long = prose(110, 40)
    texts = [prose(3, 1000 + i) + f" {i} " + (long if i % 2 else "") + str(i) * 3 for i in range(700)]
    # Texts with one id that also share 16 bits of their hash.
    low = spark.createDataFrame([(t,) for t in (f"{i} {long[: 300 + i % 40]}" for i in range(1500))], "text string").selectExpr("text", "xxhash64(text) & 65535 AS mark")
    by = {}
    for r in low.collect():
        by.setdefault(r.mark, []).append(r.text)
    clash = [t for ts in by.values() if len(ts) > 1 for t in ts]
    assert clash
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)] + [(None, t) for t in clash] + [(8, t) for t in clash]
    c = Counter(t[k : k + 200] for _, t in ((i, x.encode()) for i, x in rows) for k in range(len(t) - 199))
    want = []
    for i, t in rows:
        b = t.encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if c[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        want.append((i, bytes(x for x, m in zip(b, mark, strict=True) if not m)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_bytes - r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect()]
    assert sorted(got, key=key) == sorted(((i, len(b), hashlib.sha256(b).hexdigest()) for i, b in want), key=key)
    got = [(r.doc_id, r.text) for r in substrings.without_repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(((i, b.decode("utf-8", "ignore")) for i, b in want), key=key)


def test_suffix_order():
    data = np.random.default_rng(0).integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 380)
    order, new = substrings.suffix_order(data, starts, 20)
    cut = [data[s : s + 20].tobytes() for s in starts[order]]
    assert cut == sorted(cut) and new[1:].tolist() == [x != y for x, y in zip(cut, cut[1:], strict=False)]


def test_sharding(docs, none):
    rows = docs.selectExpr("doc_id", "cast(length(text) as long) AS size")
    got = sharding.assign(rows, "doc_id", 4, 16).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == len(ROWS) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())
    assert sharding.assign(none.selectExpr("doc_id", "1L AS size"), "doc_id", 4, 16).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu</a></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div><article><h1>On &amp; on</h1><p>Some   text, with <b>bold<br>words.<p>More &copy text.</article><div class=comments><p>I liked it, thank you.</p></div><footer>&copy; me</footer><script>var a='</p>';</script></body></html>"
    rows = spark.createDataFrame([(1, page, "old"), (2, None, "x"), (3, "", "x")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got == {1: "On & on Some text, with bold words. More © text.", 2: "", 3: ""}
    chain = html_text.Chain.fit(html_text.labelled_pages(300))
    test = html_text.labelled_pages(100, seed=5)
    assert sum(chain.decode(html_text.features(html_text.blocks(p))) == y for p, y in test) >= 90


#: Pages written by hand, and their main text.
PAGES = [
    ("<html><body><header><h1>The Daily</h1><p>News for all</p></header><nav><a href=/>Home</a></nav><article><h1>Rates rise</h1><p>The bank raised its rate, and markets fell.</p><p>More is to come.</p></article><div><p>Copyright 2024 The Daily. All rights reserved.</p></div></body></html>", "Rates rise The bank raised its rate, and markets fell. More is to come."),
    ("<html><body><div><h1>Our trip</h1><p>We went to the sea, and it was good.</p><p>Then we went home.</p></div><div><h3>Comments</h3><div>Ann: I liked it, thank you.</div><div>Bob: Me too!</div></div></body></html>", "Our trip We went to the sea, and it was good. Then we went home."),
    ("<head><title>x</title><p>Plain page text, nothing more.<p>And <math><mi>x</mi></math> stays.", "Plain page text, nothing more. And x stays."),
    ("<body><main><h1>How to bake</h1><p>Mix it, bake it.</p><ul><li>Flour, two cups.</li><li>Salt.</li></ul></main><aside class=related><h3>More</h3><p><a href=/a>Cakes</a></p></aside><form class=newsletter><label>Mail</label><button>Join</button></form><footer>&copy; Bakers</footer></body>", "How to bake Mix it, bake it. Flour, two cups. Salt."),
    ("<div id=cookie-consent><p>We use cookies on this site.</p><button>Accept</button></div><article><p>A short note, no more.</article><div class=ad-box>Buy now!</div>", "A short note, no more."),
]


def test_pages_by_hand():
    chain = html_text.Chain.fit(html_text.labelled_pages())
    assert [html_text.main_text(p, chain) for p, _ in PAGES] == [t for _, t in PAGES]


def test_html_clashes_and_empty(spark):
    rows = spark.createDataFrame([(1, "<article><p>Some words, and a stop.</p></article>", "kept")], "page_id long, html string, words string")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "kept", "Some words, and a stop.")]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, prose(40, i) + (" you stupid idiot! pathetic scum" if i % 5 == 0 else ""), 1) for i in range(400)] + [(400, None, 1), (401, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400)) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 402
    assert toxicity.score(docs, labels.limit(0)).where("score <> 0").count() == 0


@pytest.mark.parametrize("size", [0, 1, 64, 895, 896, 897, 5000])
def test_media_round_trip(size):
    data = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    stream = media.pack(media.padded(data))
    found = media.parse(stream)
    assert media.unpack(stream, found) == media.padded(data) and found["crc_good"] == found["crc_checked"] > 0 and found["junk"] == 0
    damaged = b"junk\xff\xfb" + stream[found["offsets"][0] :] + b"TAG".ljust(128, b"\0")
    assert len(media.parse(damaged)["offsets"]) == len(found["offsets"])


def test_media_table(docs):
    got = media.digest(media.store_text(docs)).collect()
    for r in got:
        payload = media.padded((TEXTS[r.doc_id] or "").encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


#: A null id, an id shared by two texts, and a row that is repeated.
SHARED = [(None, "first"), (1, "first"), (1, "second"), (2, "second"), (2, "second")]


def by_rows(spark, texts):
    return spark.createDataFrame([(i, texts[t]) for i, t in SHARED], "doc_id long, text string").repartition(2)


def seen(df, texts):
    names = {t: k for k, t in texts.items()}
    return sorted(((r.doc_id, names[r.text]) for r in df.collect()), key=str)


def test_near_dedup_decides_by_row(spark):
    texts = {"first": prose(60, 70), "second": prose(60, 71)}
    docs = by_rows(spark, texts)
    assert seen(near_dedup.without_copies(docs), texts) == [(1, "first"), (1, "second")]
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()), key=str) == [(1, 1), (1, 1), (2, 1), (2, 1), (None, 1)]
    lone = spark.createDataFrame([(None, texts["first"]), (None, texts["first"] + " end"), (None, texts["second"]), (None, None)], "doc_id long, text string")
    assert near_dedup.without_copies(lone).count() == 3


def test_decontamination_decides_by_row(spark):
    texts = {"first": prose(60, 72), "second": prose(60, 73)}
    bench = spark.createDataFrame([(1, " ".join(texts["first"].split()[5:30]))], "item_id long, text string")
    assert seen(decontaminate.without_spans(by_rows(spark, texts), bench), texts) == [(1, "second"), (2, "second"), (2, "second")]


def test_toxicity_decides_by_row(spark):
    bad = " you stupid idiot! pathetic scum"
    texts = {"first": prose(40, 74) + bad, "second": prose(40, 75)}
    rows = [(i, prose(40, i) + (bad if i % 5 == 0 else "")) for i in range(1000, 1400)]
    docs = by_rows(spark, texts).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000, 1400)], "doc_id long, toxic int")
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert seen(left.where("doc_id IS NULL OR doc_id < 1000"), texts) == [(1, "second"), (2, "second"), (2, "second")]


def test_token_files_without_ids(spark):
    from umbra.llm import common

    texts = {"first": prose(20, 76), "second": prose(20, 77)}
    docs = by_rows(spark, texts).unionByName(spark.createDataFrame([(-(1 << 63), texts["first"]), (None, texts["second"]), (0, "")], "doc_id long, text string"))
    encoded, folder = common.stored(token_files.encode(docs, bpe.vocabulary_file(), 16, 2), "encoded"), common.scratch(spark, "ids")
    got = [(r.doc_id, r.ids_crc32) for r in token_files.read(token_files.write(encoded, folder, 16), folder).collect()]
    t = library()
    crc = lambda x: zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted(got, key=str) == sorted(((r.doc_id, crc(r.text)) for r in docs.collect()), key=str)


def _crc_by_division(bits: str) -> int:
    """The checksum as the remainder of a long division, the first 16 bits turned over."""
    work = [int(b) for b in bits + "0" * 16]
    work[:16] = [1 - b for b in work[:16]]
    for k in range(len(bits)):
        if work[k]:
            for j, p in enumerate("11000000000000101"):
                work[k + j] ^= int(p)
    return int("".join(map(str, work[-16:])), 2)


def frame(second: int, third: int, fourth: int, body: bytes, covered: int) -> bytes:
    h = media.Header.read(0xFF, second, third, fourth)
    head = bytes([0xFF, second, third, fourth])
    bits = "".join(f"{b:08b}" for b in head[2:] + body)[: 16 + covered]
    return (head + _crc_by_division(bits).to_bytes(2, "big") + body).ljust(h.size, b"\0")[: h.size]


def test_checksums_of_layers():
    body = bytes(range(1, 200))
    one = frame(0xFE, 0x94, 0xC0, body, 128)  # layer I, mono
    two = frame(0xFC, 0x94, 0x00, bytes(120), 11 * 8 + 12 * 6 + 4 * 4)  # layer II, stereo, nothing allocated
    got = media.parse(one * 3)
    assert (len(got["offsets"]), got["crc_checked"], got["crc_good"]) == (3, 3, 3)
    got = media.parse(two * 3)
    assert (len(got["offsets"]), got["crc_checked"], got["crc_good"]) == (3, 3, 3)
    bad = bytearray(one * 3)
    bad[8] ^= 1
    assert media.parse(bytes(bad))["crc_good"] == 2
    mixed = media.parse(one * 3 + b"damage" + two * 4)
    assert (len(mixed["offsets"]), mixed["junk"], mixed["resyncs"]) == (7, 6, 1)
    assert mixed["seconds"] == media.Fraction(3 * 384, 48000) + media.Fraction(4 * 1152, 48000)


def test_tables_and_free_format():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, stereo, no checksum
    size = media.Header.read(*head).size
    plain = head.ljust(size, b"\0")
    vbri = head + bytes(32) + b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (9000).to_bytes(4, "big") + (7).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\0\1\0\2\1\0"
    got = media.parse(vbri.ljust(size, b"\0") + plain * 4)
    assert (got["table"], got["table_bytes"], got["table_frames"], got["toc"], len(got["offsets"])) == ("VBRI", 9000, 7, [2, 4, 512], 4)
    xing = head + bytes(32) + b"Xing" + (7).to_bytes(4, "big") + (4).to_bytes(4, "big") + (5 * size).to_bytes(4, "big") + bytes(range(100))
    got = media.parse(xing.ljust(size, b"\0") + plain * 4)
    assert (got["table"], got["table_frames"], got["table_bytes"], got["toc"]) == ("Xing", 4, 5 * size, list(range(100)))
    free = bytes([0xFF, 0xFB, 0x00, 0x00]).ljust(500, b"\1")
    got = media.parse(free * 4)
    assert got["offsets"] == [0, 500, 1000, 1500] and got["seconds"] == media.Fraction(4 * 1152, 44100)


def test_tags():
    text = b"TXXX" + (8).to_bytes(4, "big") + b"\0\0" + b"\0key\0\xff\0\xe0b"
    body = (6).to_bytes(4, "big") + bytes(6) + text  # an extended header in front, bytes 0 put in behind 0xFF
    tag = b"ID3\3\0\xc0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    frames = bytes([0xFF, 0xFB, 0x90, 0x00]).ljust(417, b"\0") * 3
    got = media.parse(tag + tag + frames + b"TAG".ljust(128, b"x"))
    assert len(got["offsets"]) == 3 and got["offsets"][0] == 2 * len(tag) and got["junk"] == 0 and "key" in got["tags"]


def test_probe(spark):
    stream = media.pack(media.padded(b"abc" * 700))
    rows = spark.createDataFrame([(1, bytearray(stream), "x"), (2, None, "y"), (3, bytearray(b"noise"), "z")], "id long, media binary, rate string")
    got = {r.id: r for r in media.probe(rows).collect()}
    by_hand = [k for k in range(len(stream) - 3) if stream[k : k + 2] == b"\xff\xfa" and media.Header.read(*stream[k : k + 4])]
    assert got[1].seek_offsets == by_hand[1:] and got[1].n_frames == len(by_hand) - 1 and got[1].seconds == pytest.approx(1152 * got[1].n_frames / 48000)
    assert got[1].table_frames == got[1].n_frames and got[1].crc_good == got[1].crc_checked
    assert got[2].n_frames == got[3].n_frames == 0 and got[2].seconds is None and got[3].seek_offsets == []
    assert media.probe(rows.limit(0)).count() == 0


def test_ring_by_hand(spark):
    import xxhash

    def spark_hash(word: str, number: int) -> int:
        return xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(word.encode(), 42))

    shards, virtual, n = 5, 8, 1000
    nodes: dict[int, int] = {}
    for i in range(shards * virtual):
        at = spark_hash("ring", i) >> 48
        nodes[at] = min(nodes.get(at, shards), i % shards)
    ring = sorted(nodes.items())
    arc_of = {i: next((a for a, (at, _) in enumerate(ring) if at >= spark_hash("key", i) >> 48), 0) for i in range(n)}
    free = [n // shards + (s < n % shards) for s in range(shards)]
    want: Counter = Counter()
    for arc in range(len(ring)):
        left = sum(a == arc for a in arc_of.values())
        for s in dict.fromkeys(s for _, s in ring[arc:] + ring[:arc]):
            take = min(left, free[s])
            left, free[s] = left - take, free[s] - take
            want[arc, s] += take
    got = Counter((arc_of[r.id], r.shard) for r in sharding.assign(spark.range(n), "id", shards, virtual).collect())
    assert +got == +want


def test_toxicity_reads_whole_words(spark):
    """A word that only begins like one of the lexicon isn't one."""
    data = "worthlessness garbagebag w0rthless".encode()
    read, first, last = toxicity.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [bool(x) for x in np.isin(toxicity.common.hashes(read, first, last), toxicity._hashed(toxicity.INSULTS))] == [False, False, True]
    docs = spark.createDataFrame([(None, "a b"), (1, "c d")], "doc_id long, text string")
    assert {r.doc_id: r.held_out for r in toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}[None] is False
    assert toxicity.score(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_bpe_encode_and_decode(spark, docs):
    t = library()
    ids = bpe.encode(docs)
    for r in ids.collect():
        assert r.ids == t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    for r in bpe.decode(ids).collect():
        assert r.text == t.decode(t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_long_texts(spark):
    """A text of some megabytes beside short ones, with its own repeats."""
    long = prose(200, 800) + " " + " ".join(f"w{i}" for i in range(400_000)) + " " + prose(200, 800)
    rows = spark.createDataFrame([(1, long), (2, "short"), (3, long[:3000])], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in substrings.digest(rows).collect()}
    n = len(prose(200, 800).encode())
    assert got[1].n_removed >= 2 * n and got[3].n_removed == 3000 + len(long[:3000].encode()) - 3000 and got[2].n_removed == 0
    assert {r.doc_id: r.class_id for r in near_dedup.classes(rows).collect()} == {1: 1, 2: 2, 3: 3}
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(399_980, 399_999)))], "item_id long, text string")
    hits = {r.doc_id: sum(s.hi - s.lo for s in r.spans) for r in decontaminate.scan(rows, bench).collect()}
    assert hits == {1: 19, 2: 0, 3: 0}
    assert {r.doc_id: r.n_tokens for r in ppm.score(rows).collect()}[1] == len(long.split()) + 1
    t = library()
    assert {r.doc_id: r.n_tokens for r in bpe.digest(rows).collect()}[1] == len(t.encode(long, add_special_tokens=False).ids)
