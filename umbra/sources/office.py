"""Files as blocks: text, Word, spreadsheets (zip and XML of the standard library), and the lines of a PDF's characters."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra import workers
from umbra.functions import patterns, scan
from umbra.operators import fusion, policy

# Formats by file name, name spaces, and parts that an export must not carry along.
TEXT = (".txt", ".md", ".csv", ".json", ".yaml", ".yml")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REFUSED_PARTS = {"word/comments.xml": "comments", "word/footnotes.xml": "notes", "word/endnotes.xml": "notes", "_xmlsignatures/": "signed", "word/embeddings/": "embedded_objects", "word/diagrams/": "diagrams"}
REFUSED_TAGS = {"ins": "tracked_changes", "del": "tracked_changes", "moveFrom": "tracked_changes", "moveTo": "tracked_changes"}


class UnsupportedFormat(ValueError):
    """No reader for this kind of file."""


def _parts(raw: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return None


def _docx_opened(raw: bytes) -> tuple[list[str], zipfile.ZipFile | None, ElementTree.Element | None]:
    """Why a Word file is turned away (empty if it isn't), its parts, and its body."""
    if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return ["encrypted"], None, None
    parts = _parts(raw)
    names = parts.namelist() if parts else []
    if "word/document.xml" not in names:
        return ["not_docx"], None, None
    found = {why for part, why in REFUSED_PARTS.items() if any(n.startswith(part) for n in names)}
    root = ElementTree.fromstring(parts.read("word/document.xml"))
    return sorted(found | {why for tag, why in REFUSED_TAGS.items() if root.find(f".//{W}{tag}") is not None}), parts, root


def _docx_probe(raw: bytes) -> list[str]:
    """Why a Word file is turned away; empty if it isn't."""
    return _docx_opened(raw)[0]


def _docx_paragraphs(raw: bytes, opened: tuple | None = None) -> list[tuple[str, int, str]]:
    """part, paragraph, text of body, headers and footers."""
    _, parts, body = opened or ([], _parts(raw), None)
    out = []
    for name in sorted(n for n in parts.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)):
        root = body if name == "word/document.xml" and body is not None else ElementTree.fromstring(parts.read(name))
        for i, p in enumerate(root.iter(W + "p")):
            out.append((name, i, "".join(t.text or "" if t.tag == W + "t" else "\t" for t in p.iter() if t.tag in (W + "t", W + "tab"))))
    return out


def _xml(root: ElementTree.Element) -> bytes:
    """As ElementTree.tostring in UTF-8 with a declaration, which takes longer as it encodes each piece by itself."""
    return ("<?xml version='1.0' encoding='utf-8'?>\n" + ElementTree.tostring(root, encoding="unicode")).encode("utf-8", "xmlcharrefreplace")


def _docx_patched(raw: bytes, replaced: dict[tuple[str, int], list[tuple[int, int, str]]], opened: tuple | None = None) -> bytes:
    """The file with stretches (start, end, text) of paragraphs replaced: the first run of a stretch takes the text, the others lose theirs."""
    _, parts, body = opened or ([], _parts(raw), None)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in parts.infolist():
            data = parts.read(item.filename)
            if any(part == item.filename for part, _ in replaced):
                root = body if item.filename == "word/document.xml" and body is not None else ElementTree.fromstring(data)
                for i, p in enumerate(root.iter(W + "p")):
                    for start, end, text in sorted(replaced.get((item.filename, i), []), reverse=True):
                        at = 0
                        for t in [t for t in p.iter() if t.tag in (W + "t", W + "tab")]:
                            own = (t.text or "") if t.tag == W + "t" else "\t"
                            a, b = max(start, at), min(end, at + len(own))
                            if a < b and t.tag == W + "t":
                                t.text = own[: a - at] + (text if a == start else "") + own[b - at :]
                            at += len(own)
                data = _xml(root)
            target.writestr(item.filename, data)
    return out.getvalue()


def files(spark: SparkSession, path: str, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, refused) of all files under a path: path, format, sha256, block, locator, text; and path, reason of those without a reader or with content that an export can't carry."""
    workers.ship(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("format"), F.sha2("content", 256).alias("sha256"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, kind, sha, raw in frame.itertuples(index=False):
                found, reason = [], None
                if kind in TEXT:
                    found = [(f"line{i + 1}", t) for i, t in enumerate(raw.decode("utf-8-sig", "replace").splitlines()) if t.strip()]
                elif kind == ".docx":
                    reason = ",".join(_docx_probe(raw)) or None
                    found = [] if reason else [(f"{part}#p{i}", t) for part, i, t in _docx_paragraphs(raw) if t.strip()]
                elif kind in (".xlsx", ".xlsm"):
                    found = [(f"sheet{s:03d}-cell-{c}", v) for s, c, v in _xlsx_values(raw)] if _parts(raw) else []
                    reason = None if _parts(raw) else "not_xlsx"
                else:
                    reason = "unsupported_format"
                out += [(file, kind, sha, i, loc, t, None) for i, (loc, t) in enumerate(found)] if reason is None else [(file, kind, sha, None, None, None, reason)]
            yield pd.DataFrame(out, columns=["path", "format", "sha256", "block", "locator", text_column, "reason"]).astype({"block": "Int32"})

    read = rows.mapInPandas(run, f"path string, format string, sha256 string, block int, locator string, {text_column} string, reason string")
    return read.where("reason IS NULL").drop("reason"), read.where("reason IS NOT NULL").select("path", "format", "reason")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """path, format, sha256, source_uid, blocks, chars, warnings, error of all files under a path.

    source_uid begins with the content's hash, so that a file is the same source wherever it lies. warnings: what a person
    should look at (hidden_columns of spreadsheets, empty: no text at all); error: why there is no reader, or no export.
    """
    good, refused = files(spark, path)
    counted = good.groupBy("path", "format", "sha256").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("text")).cast("long").alias("chars"))
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("format"), F.sha2("content", 256).alias("sha256"), "content")
    sheets = every.where(F.col("format").isin(".xlsx", ".xlsm")).select(F.col("path").alias("doc_id"), "content")
    hidden = xlsx_cells(sheets).where("hidden").groupBy(F.col("doc_id").alias("__path")).agg(F.count(F.lit(1)).alias("hidden"))
    rows = every.drop("content").join(counted.select(F.col("path").alias("__of"), "blocks", "chars"), F.col("path") == F.col("__of"), "left").drop("__of")
    rows = rows.join(refused.select(F.col("path").alias("__bad"), F.col("reason").alias("error")), F.col("path") == F.col("__bad"), "left").drop("__bad").join(hidden, F.col("path") == F.col("__path"), "left").drop("__path")
    warnings = F.array_compact(F.array(F.when(F.col("hidden") > 0, "hidden_columns"), F.when(F.col("error").isNull() & F.col("blocks").isNull(), "empty")))
    return rows.select("path", "format", "sha256", F.concat(F.lit("src-"), F.substring("sha256", 1, 16)).alias("source_uid"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("chars", F.lit(0)).alias("chars"), warnings.alias("warnings"), "error")


def write_docx(docs: DataFrame) -> DataFrame:
    """doc_id, content: each text as a plain Word file, a paragraph a line."""
    workers.ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def one(text: str) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
            z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": frame["text"].map(one)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, content binary")


_BLOCK = {"block": "int", "part": "string", "paragraph": "int", "text": "string"}


def docx_texts(table: DataFrame, *keep: str) -> DataFrame:
    """doc_id, blocks of Word files (doc_id, content): as docx_blocks, an array in each file's row; null without content. keep: further columns, which stay."""
    workers.ship(table.sparkSession)
    schema = ", ".join([f"doc_id {dict(table.dtypes)['doc_id']}, blocks {scan.ddl(_BLOCK)}", *(f"`{c}` {dict(table.dtypes)[c]}" for c in keep)])

    def one(raw: bytes | None) -> list[tuple] | None:
        if raw is None:
            return None
        opened = _docx_opened(raw)
        if opened[0]:
            return [(0, ",".join(opened[0]), 0, None)]
        return [(n + 1, *x) for n, x in enumerate(x for x in _docx_paragraphs(raw, opened) if x[2].strip(" \t"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), scan.column([one(raw) for raw in batch.column(1).to_pylist()], _BLOCK), *batch.columns[2:]], ["doc_id", "blocks", *keep])

    return table.select("doc_id", "content", *keep).mapInArrow(run, schema)


def docx_blocks(table: DataFrame) -> DataFrame:
    """doc_id, block, part, paragraph, text of Word files (doc_id, content) without blank paragraphs; a refused file gives one row with text null and the reasons as part."""
    return docx_texts(table).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


_PUT = ("start", "end", "label", "role", "surface", "coarse")


def redact_docx(table: DataFrame, profile: policy.Profile) -> DataFrame:
    """doc_id, content, mapping, error of Word files (doc_id, content; ids each once): paragraphs redacted under a profile, values numbered by file.

    A refused file, and one with a paragraph that the run turns away or whose label the profile blocks, has an error and no
    content. Files and the spans of their paragraphs meet in one join; the mapping stays in its file's row.
    """
    kind, n = dict(table.dtypes)["doc_id"], workers.parts(table)
    # Both uses of the files read all of these columns, so that Spark deals them once.
    keyed = table.select("doc_id", "content", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("doc_id").isNull().alias("__null")).repartition(n, "__id", "__null")
    blocks = docx_texts(keyed, "__id", "__null").select("__id", "__null", F.explode("blocks").alias("b")).where("b.text IS NOT NULL")
    ran = fusion.run(blocks.select(F.to_json(F.struct("__id", "__null", "b.part", "b.paragraph")).alias("doc_id"), "b.text"), profile)
    found = ran.select(F.from_json("doc_id", "__id string, __null boolean, part string, paragraph int").alias("k"), "error", F.size("blocked").alias("blocked"), F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in _PUT])).alias("s"))
    found = found.where("error IS NOT NULL OR size(s) > 0 OR blocked > 0").select("k.*", "error", "blocked", "s").repartition(n, "__id", "__null")
    why = F.coalesce(F.min("error"), F.when(F.max("blocked") > 0, "blocked"))
    # Sorted by part and paragraph; a paragraph's spans come by place.
    lists = found.groupBy("__id", "__null").agg(why.alias("error"), F.sort_array(F.collect_list(F.struct("part", "paragraph", "s"))).alias("all"))
    joined = keyed.join(lists.hint("merge"), ["__id", "__null"], "left")
    flat = F.flatten(F.transform("all", lambda b: F.transform(b["s"], lambda s: F.struct(b["part"].alias("part"), b["paragraph"].alias("paragraph"), *[s[c].alias(c) for c in _PUT]))))

    def one(raw: bytes | None, error: str | None, spans: list[tuple] | None) -> tuple[bytes | None, list[tuple] | None, str | None]:
        opened = _docx_opened(raw) if raw is not None and not error else ([], None, None)
        error = error or ",".join(opened[0]) or None
        if error or raw is None:
            return None, None, error
        values, mapped = scan.put_in(s[4:] for s in spans or ())
        replaced: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
        for (part, paragraph, start, end, *_), value in zip(spans or (), values, strict=True):
            replaced.setdefault((part, paragraph), []).append((start, end, value))
        return _docx_patched(raw, replaced, opened) if replaced else raw, mapped, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            done = [one(*r) for r in zip(batch.column(1).to_pylist(), scan.plain(batch.column(2)), scan.lists(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.binary()), scan.column([d[1] for d in done], scan.MAPPED), pa.array([d[2] for d in done], pa.string())], ["doc_id", "content", "mapping", "error"])

    return joined.select("doc_id", "content", "error", flat.alias("spans")).mapInArrow(run, f"doc_id {kind}, content binary, mapping {scan.ddl(scan.MAPPED)}, error string")


def patch_docx(table: DataFrame, replaced: DataFrame) -> DataFrame:
    """doc_id, content: Word files with stretches of their paragraphs replaced. replaced: doc_id, part, paragraph, start, end, replacement."""
    workers.ship(table.sparkSession)
    kind = dict(table.dtypes)["doc_id"]
    lists = replaced.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("part", "paragraph", "start", "end", "replacement")).alias("own"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, raw, own in zip(frame["doc_id"], frame["content"], frame["own"], strict=True):
                by: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
                for r in own if own is not None else ():
                    by.setdefault((r["part"], r["paragraph"]), []).append((r["start"], r["end"], r["replacement"]))
                out.append((doc, _docx_patched(raw, by) if by else raw))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    joined = table.join(lists, F.col("doc_id") == F.col("of"), "left").select("doc_id", "content", "own")
    return joined.mapInPandas(run, f"doc_id {kind}, content binary")


def _nodes(p: ElementTree.Element) -> list[tuple[ElementTree.Element, int, int, bytes]]:
    """The text nodes of a paragraph with their bounds in its text (a tab is one character) and the format of their run."""
    out, at = [], 0
    for r in p.iter(W + "r"):
        form = r.find(W + "rPr")
        for t in r.iter():
            if t.tag == W + "t":
                out.append((t, at, at + len(t.text or ""), b"" if form is None else ElementTree.tostring(form)))
                at += len(t.text or "")
            elif t.tag == W + "tab" and form is not t:
                at += 1
    return out


def docx_ledger(table: DataFrame, replaced: DataFrame) -> DataFrame:
    """doc_id, part, paragraph, start, end, first_node, last_node, format_mixed, problem of each stretch that patch_docx would replace.

    problem: no_such_paragraph, out_of_range, empty, overlap, no_text; a patch must not be made where one has a problem.
    format_mixed: the stretch goes over runs of different formats, of which only the first one's stays.
    """
    workers.ship(table.sparkSession)
    kind = dict(table.dtypes)["doc_id"]
    lists = replaced.groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("part", "paragraph", "start", "end"))).alias("own"))

    def one(raw: bytes, wanted: list) -> Iterator[tuple]:
        parts = _parts(raw)
        paragraphs = {n: list(ElementTree.fromstring(parts.read(n)).iter(W + "p")) for n in {r["part"] for r in wanted} & set(parts.namelist())}
        last: tuple = (None, None, 0)
        for r in wanted:
            part, no, start, end = (r[c] for c in ("part", "paragraph", "start", "end"))
            own = paragraphs.get(part, [])
            if not 0 <= no < len(own):
                yield part, no, start, end, None, None, None, "no_such_paragraph"
                continue
            nodes = _nodes(own[no])
            met = [i for i, (_, a, b, _) in enumerate(nodes) if a < end and b > start]
            size = max((b for _, _, b, _ in nodes), default=0)
            problem = "empty" if start >= end else "out_of_range" if start < 0 or end > size else "overlap" if last[:2] == (part, no) and start < last[2] else None if met else "no_text"
            last = part, no, max(end, last[2] if last[:2] == (part, no) else 0)
            yield part, no, start, end, met[0] if met else None, met[-1] if met else None, len({nodes[i][3] for i in met}) > 1, problem

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(doc, *x) for doc, raw, own in zip(frame["doc_id"], frame["content"], frame["own"], strict=True) for x in one(raw, own)]
            yield pd.DataFrame(out, columns=["doc_id", "part", "paragraph", "start", "end", "first_node", "last_node", "format_mixed", "problem"]).astype({"first_node": "Int32", "last_node": "Int32", "format_mixed": "boolean"})

    joined = table.join(lists, F.col("doc_id") == F.col("of")).select("doc_id", "content", "own")
    return joined.mapInPandas(run, f"doc_id {kind}, part string, paragraph int, start int, end int, first_node int, last_node int, format_mixed boolean, problem string")


_EXACT, _ALTERED = re.compile(patterns.PLACEHOLDER), [re.compile(x) for x in (*patterns.ALTERED, patterns.BARE_PLACEHOLDER)]


def _docx_refilled(raw: bytes, values: dict[str, str], opened: tuple | None = None) -> tuple[bytes | None, int, dict[str, set[str]]]:
    """The file with all known placeholders filled in, how many, and what blocks it: then nothing is filled in."""
    _, parts, body = opened or ([], _parts(raw), None)
    bad, done, roots = {"unknown": set(), "altered": set(), "split": set()}, 0, {}
    for name in (n for n in parts.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)):
        roots[name] = body if name == "word/document.xml" and body is not None else ElementTree.fromstring(parts.read(name))
        for p in roots[name].iter(W + "p"):
            texts = [t.text or "" for t, *_ in _nodes(p)]
            whole = "".join(texts)
            if "<" not in whole and "_" not in whole:
                continue  # every form of a placeholder has one of them
            met = set(_EXACT.findall(whole))
            bad["unknown"] |= met - set(values)
            bad["altered"] |= {x for r in _ALTERED for x in r.findall(whole)} - met
            # A placeholder that people have cut in two runs by a change of format is in no run whole.
            bad["split"] |= {k for k in met & set(values) if not any(k in t for t in texts)}
    if any(bad.values()):
        return None, 0, bad
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in parts.infolist():
            data = parts.read(item.filename)
            if item.filename in roots:
                before = done
                for t in roots[item.filename].iter(W + "t"):
                    t.text, n = _EXACT.subn(lambda m: values[m[0]], t.text or "")
                    done += n
                if done > before:
                    data = _xml(roots[item.filename])
            target.writestr(item.filename, data)
    return out.getvalue(), done, bad


def refill_docx(table: DataFrame, mapped: DataFrame) -> DataFrame:
    """doc_id, status, content (null unless ok), restored, unknown, altered, split of Word files (doc_id, content) under a mapping (doc_id, placeholder, original_value).

    Blocked are files with unknown placeholders, with things like placeholders, and with ones that several runs share; refused
    those that docx_blocks refuses. What is filled in isn't read again; parts without a placeholder stay byte by byte.
    """
    lists = mapped.groupBy(F.col("doc_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original_value"))).alias("values"))
    entries = F.transform(F.map_entries("values"), lambda e: F.struct(e["key"].alias("placeholder"), e["value"].alias("original_value")))
    return refill_docx_rows(table.join(lists, F.col("doc_id") == F.col("of"), "left").select("doc_id", "content", entries.alias("mapping")))


def refill_docx_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """As refill_docx, of files that have their mapping beside them (doc_id, content, mapping: array of placeholder, original_value): nothing is joined. keep: further columns, which stay."""
    workers.ship(rows.sparkSession)
    texts, kinds = {"unknown": pa.list_(pa.string()), "altered": pa.list_(pa.string()), "split": pa.list_(pa.string())}, dict(rows.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}, status string, content binary, restored int", *(f"{n} array<string>" for n in texts), *(f"`{c}` {kinds[c]}" for c in keep)])

    def one(raw: bytes, mapping: list[tuple] | None) -> tuple:
        opened = _docx_opened(raw)
        if opened[0]:
            return "refused", None, 0, [], [], opened[0]
        content, done, bad = _docx_refilled(raw, dict(mapping or ()), opened)
        return "blocked" if content is None else "ok", content, done, *(sorted(bad[k]) for k in ("unknown", "altered", "split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            done = [one(*r) for r in zip(batch.column(1).to_pylist(), scan.lists(batch.column(2)), strict=True)]
            made = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int32(), *texts.values()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], ["doc_id", "status", "content", "restored", *texts, *keep])

    values = F.transform("mapping", lambda m: F.struct(m["placeholder"].alias("placeholder"), m["original_value"].alias("original_value")))
    return rows.select("doc_id", "content", values.alias("__mapping"), *keep).mapInArrow(run, schema)


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _xlsx_values(raw: bytes) -> list[tuple[int, str, str]]:
    """sheet, cell, value of all cells that have one."""
    parts, out, shared = _parts(raw), [], []
    if "xl/sharedStrings.xml" in parts.namelist():
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(S + "si")]
    for name in sorted((n for n in parts.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
        for c in ElementTree.fromstring(parts.read(name)).iter(S + "c"):
            v, t = c.find(S + "v"), c.get("t")
            value = "".join(x.text or "" for x in c.iter(S + "t")) if t == "inlineStr" else None if v is None else shared[int(v.text)] if t == "s" else v.text
            if value is not None and value.strip():
                out.append((int(re.sub(r"\D", "", name)), c.get("r"), value))
    return out


def write_xlsx(table: DataFrame) -> DataFrame:
    """doc_id, content: rows (array of array of strings) as a spreadsheet of one sheet; null cells are left out."""
    workers.ship(table.sparkSession)
    kind = dict(table.dtypes)["doc_id"]

    def one(rows) -> bytes:
        strings: list[str] = []
        lines = []
        for i, row in enumerate(rows):
            cells = []
            for j, v in enumerate(row):
                if v is not None:
                    strings.append(v)
                    cells.append(f'<c r="{_column(j + 1)}{i + 1}" t="s"><v>{len(strings) - 1}</v></c>')
            lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{S[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
            z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><sst xmlns="{S[1:-1]}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in strings)}</sst>')
        return out.getvalue()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": frame["rows"].map(one)})

    return table.select("doc_id", "rows").mapInPandas(run, f"doc_id {kind}, content binary")


def xlsx_cells(table: DataFrame) -> DataFrame:
    """doc_id, sheet, cell, value, merged, hidden of spreadsheets (doc_id, content): merged is the range that a cell begins, hidden tells of its column."""
    workers.ship(table.sparkSession)
    kind = dict(table.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, raw in zip(frame["doc_id"], frame["content"], strict=True):
                parts = _parts(raw)
                if parts is None:
                    continue
                merged, hidden = {}, set()
                for name in (n for n in parts.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                    root, no = ElementTree.fromstring(parts.read(name)), int(re.sub(r"\D", "", name))
                    merged |= {(no, m.get("ref").partition(":")[0]): m.get("ref") for m in root.iter(S + "mergeCell")}
                    hidden |= {(no, _column(k)) for c in root.iter(S + "col") if c.get("hidden") in ("1", "true") for k in range(int(c.get("min")), int(c.get("max")) + 1)}
                out += [(doc, s, c, v, merged.get((s, c)), (s, re.sub(r"\d", "", c)) in hidden) for s, c, v in _xlsx_values(raw)]
            yield pd.DataFrame(out, columns=["doc_id", "sheet", "cell", "value", "merged", "hidden"])

    return table.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, sheet int, cell string, value string, merged string, hidden boolean")


def lines(chars: DataFrame) -> DataFrame:
    """doc_id, page, line, text of characters (doc_id, page, c, x, top, width, height).

    Characters are of one line while their top stays within half the page's median height of the line's mean top so far; in a line, a gap of
    more than 0.4 median widths (1 at least) is a space, but not between two Han characters. A page is one group.
    """
    half, wide = F.expr("percentile(height, 0.5)") / 2, F.greatest(F.lit(1.0), F.expr("percentile(width, 0.5)") * 0.4)
    pages = chars.groupBy("doc_id", "page").agg(half.alias("half"), wide.alias("wide"), F.array_sort(F.collect_list(F.struct("top", "x", "c", "width"))).alias("all"))
    zero = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<struct<line:int,x:double,c:string,width:double>>").alias("out"))

    def place(a: Column, k: Column) -> Column:
        new = a["mean"].isNull() | (F.abs(k["top"] - a["mean"]) > F.col("half"))
        line = a["line"] + new.cast("int")
        n = F.when(new, 1).otherwise(a["n"] + 1)
        mean = F.when(new, k["top"]).otherwise(a["mean"] + (k["top"] - a["mean"]) / n)
        return F.struct(mean.alias("mean"), n.alias("n"), line.alias("line"), F.concat(a["out"], F.array(F.struct(line.alias("line"), k["x"].alias("x"), k["c"].alias("c"), k["width"].alias("width")))).alias("out"))

    placed = pages.select("doc_id", "page", "wide", F.explode(F.aggregate("all", zero, place, lambda a: a["out"])).alias("k")).select("doc_id", "page", "wide", "k.*")
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    han = F.col("c").rlike("[一-龥]") & F.lag("c").over(order).rlike("[一-龥]")
    piece = F.concat(F.when((gap > F.col("wide")) & ~han, " ").otherwise(""), F.col("c"))
    joined = placed.withColumn("piece", piece).groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "piece"))).alias("all"))
    return joined.select("doc_id", "page", "line", F.array_join(F.transform("all", lambda k: k["piece"]), "").alias("text"))


def garbled(text: Column) -> Column:
    """Whether an extracted text is no text: a replacement or private-use character, or more than one control character in a hundred."""
    left = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return text.rlike("[�-]") | (F.char_length(text) - F.char_length(left) > 0.01 * F.char_length(text))


def needs_ocr(text: Column, images: Column) -> Column:
    """Whether a page is a picture: under ten characters that aren't blank, and images."""
    return (F.char_length(F.regexp_replace(text, r"(?U)\s", "")) < 10) & (images > 0)
