"""Chat payloads: the texts in them that are masked, as rows, and the way back into the payload.

The texts of a payload, in order: string content and text blocks of messages, results and inputs of tools, arguments of
calls (a string as one text, else its strings), echoed reasoning, and descriptions of tools. System messages stay in
clear unless asked. Texts become documents of a detection run; what replaces a value is the same in all texts of a payload.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra import workers
from umbra.functions import scan
from umbra.operators import fusion, placeholders, policy

#: Kinds of blocks whose `text` is prose.
PROSE = ("text", "input_text", "output_text")


def _strings(value: object, change: Callable[[str], str]) -> object:
    """A value with all its strings changed; keys stay."""
    if isinstance(value, str):
        return change(value) if value else value
    if isinstance(value, list):
        return [_strings(v, change) for v in value]
    return {k: _strings(v, change) for k, v in value.items()} if isinstance(value, dict) else value


def _descriptions(value: object, change: Callable[[str], str]) -> object:
    if isinstance(value, list):
        return [_descriptions(v, change) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: _strings(v, change) if k == "description" and isinstance(v, str) else _descriptions(v, change) for k, v in value.items()}


def _content(content: object, change: Callable[[str], str]) -> object:
    if isinstance(content, str):
        return _strings(content, change)
    if not isinstance(content, list):
        return content
    out = []
    for block in content:
        kind = block.get("type") if isinstance(block, dict) else None
        if kind in PROSE and isinstance(block.get("text"), str):
            block = block | {"text": _strings(block["text"], change)}
        elif kind == "tool_result" and "content" in block:
            block = block | {"content": _content(block["content"], change)}
        elif kind == "tool_use" and isinstance(block.get("input"), dict):
            block = block | {"input": _strings(block["input"], change)}
        out.append(block)
    return out


def changed(payload: dict, change: Callable[[str], str], system_too: bool = False) -> dict:
    """The payload with `change` applied to each text that is masked, in order."""
    out = dict(payload)
    if system_too and "system" in out:
        out["system"] = _content(out["system"], change)
    if isinstance(out.get("tools"), list):
        out["tools"] = _descriptions(out["tools"], change)
    messages = []
    for m in out.get("messages") or []:
        if isinstance(m, dict) and (system_too or m.get("role") != "system"):
            m = dict(m)
            if "content" in m:
                m["content"] = _content(m["content"], change)
            if isinstance(m.get("reasoning_content"), str):
                m["reasoning_content"] = _strings(m["reasoning_content"], change)
            if isinstance(m.get("tool_calls"), list):
                m["tool_calls"] = [c | {"function": c["function"] | {"arguments": _strings(c["function"]["arguments"], change)}} if isinstance(c, dict) and isinstance(c.get("function"), dict) and "arguments" in c["function"] else c for c in m["tool_calls"]]
        messages.append(m)
    if isinstance(out.get("messages"), list):
        out["messages"] = messages
    return out


def _read(raw: str | None) -> dict | None:
    try:
        value = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def texts(payloads: DataFrame, system_too: bool = False) -> DataFrame:
    """doc_id, no, text: the texts of payloads (doc_id, payload) that are masked, in order."""
    workers.ship(payloads.sparkSession)
    kind = payloads.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            rows = []
            for doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: list[str] = []
                changed(_read(raw) or {}, lambda t: found.append(t) or t, system_too)  # noqa: B023
                rows += [(doc, i, t) for i, t in enumerate(found)]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int32(), pa.string()), strict=True)], ["doc_id", "no", "text"])

    return payloads.select("doc_id", "payload").mapInArrow(run, f"doc_id {kind}, no int, text string")


def masked(payloads: DataFrame, profile: policy.Profile, predictions: DataFrame | None = None, system_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, payload, status; the mapping of each payload) of payloads (doc_id, payload; ids each once).

    predictions: a model's spans by text (doc_id: the payload's id and the text's number, joined by #). status is ok;
    invalid_json (no JSON object); or what turned a text away, or `blocked` where the profile blocks a label: then the
    payload is null, as none of it may be sent. Fail-closed as fusion.run.
    """
    rows = texts(payloads, system_too).select(F.concat_ws("#", F.col("doc_id").cast("string"), "no").alias("doc_id"), F.col("doc_id").alias("of"), "no", "text")
    ran = fusion.run(rows.select("doc_id", "text"), profile, predictions).join(rows.select(F.col("doc_id").alias("__id"), "of", "no"), F.col("doc_id") == F.col("__id")).drop("__id")
    spans = ran.select("of", "no", F.explode("spans").alias("s")).select(F.col("of").alias("doc_id"), "no", "s.*")
    numbered = placeholders.number(spans, "doc_id", ("no", "start"))
    put = numbered.groupBy("doc_id", "no").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("coarse", "placeholder").alias("value")))).alias("puts"))
    bad = ran.groupBy("of").agg(F.min("error").alias("error"), F.max(F.size("blocked") > 0).alias("blocked"))
    lists = put.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_list(F.struct("no", "puts")).alias("all"))
    joined = payloads.select("doc_id", "payload").join(lists, F.col("doc_id").eqNullSafe(F.col("__of")), "left").join(bad, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "payload", "all", "error", "blocked")
    kind = payloads.schema["doc_id"].dataType.simpleString()

    def one(raw: str | None, puts: list[dict] | None, error: str | None, blocked: bool | None) -> tuple[str | None, str]:
        payload = _read(raw)
        if payload is None or error or blocked:
            return None, "invalid_json" if payload is None else error or "blocked"
        by_no, count = {p["no"]: p["puts"] for p in puts or ()}, iter(range(1 << 62))
        done = changed(payload, lambda t: scan.replaced(t, [(x["start"], x["end"], x["value"]) for x in by_no.get(next(count), ())]), system_too)
        return json.dumps(done, ensure_ascii=False, separators=(",", ":")), "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole)):
            done = [one(*r) for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["doc_id", "payload", "status"])

    return joined.mapInArrow(run, f"doc_id {kind}, payload string, status string"), placeholders.mapping(numbered.where(F.col("coarse").isNull()))
