"""Mappings at rest, packages that lead back, audit rows, jobs and namespaces, as tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import text_hash

HOURS = 24
# Names that a ledger never takes in, and what a stream of audit rows may be called.
FORBIDDEN = ("text", "original_value", "redacted_text", "mapping", "surface", "content", "prompt")
STREAM = r"^[a-z][a-z0-9_-]{0,63}$"


def seal(mapped: DataFrame, key: bytes, scope: str = "doc_id") -> DataFrame:
    """scope, name (a hash of the scope), sealed: the mapping of each scope as one value of AES-GCM, bound to its name."""
    whole = mapped.groupBy(scope).agg(F.to_json(F.array_sort(F.collect_list(F.struct("placeholder", "label", "original_value", "text_hash")))).alias("plain"))
    named = whole.withColumn("name", F.concat(F.sha2(F.col(scope).cast("string"), 256), F.lit(".mapping")))
    sealed = F.aes_encrypt(F.encode("plain", "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.encode("name", "UTF-8"))
    return named.select(scope, "name", sealed.alias("sealed"))


def unseal(sealed: DataFrame, key: bytes, scope: str = "doc_id") -> DataFrame:
    """scope, placeholder, label, original_value, text_hash. A value that was moved to another name or changed fails the job."""
    plain = F.decode(F.aes_decrypt("sealed", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.encode("name", "UTF-8")), "UTF-8")
    rows = F.from_json(plain, "array<struct<placeholder:string,label:string,original_value:string,text_hash:string>>")
    return sealed.select(scope, F.explode(rows).alias("r")).select(scope, "r.*")


def in_force(stored: DataFrame, now: Column, hours: int = HOURS) -> tuple[DataFrame, DataFrame]:
    """(rows younger than `hours` by created_at, rows to purge)."""
    old = F.col("created_at") <= now - F.expr(f"INTERVAL {hours} HOURS")
    return stored.where(~old), stored.where(old)


def package_key(password: str, salt: bytes) -> bytes:
    """The key of a recovery package, derived on the driver."""
    return hashlib.scrypt(password.encode(), salt=salt, n=2**15, r=8, p=1, dklen=32, maxmem=64 << 20)


def package(mapped: DataFrame, jobs: DataFrame, key: bytes) -> DataFrame:
    """job_id, binding, package: the mapping of each job, sealed together with what it is bound to. jobs: job_id, app_id, document_hash, expires_at."""
    binding = F.to_json(F.struct("app_id", "document_hash", "expires_at", "job_id"))  # by name, so that it reads the same everywhere
    whole = mapped.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("placeholder", "original_value")))).alias("plain"))
    rows = whole.join(jobs, "job_id").withColumn("binding", binding)
    sealed = F.aes_encrypt(F.encode("plain", "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.encode("binding", "UTF-8"))
    return rows.select("job_id", "binding", sealed.alias("package"))


def recover(packages: DataFrame, requests: DataFrame, key: bytes, now: Column) -> DataFrame:
    """job_id, status, rows: the binding is checked before anything is opened. requests: job_id, app_id, document_hash."""
    bound = F.from_json("binding", "app_id string, document_hash string, expires_at timestamp, job_id bigint")
    joined = requests.join(packages, "job_id", "left").withColumn("bound", bound)
    status = F.when(F.col("package").isNull(), "not_found").when((F.col("bound.app_id") != F.col("app_id")) | (F.col("bound.job_id") != F.col("job_id")), "wrong_owner").when(F.col("bound.document_hash") != F.col("document_hash"), "wrong_document").when(F.col("bound.expires_at") <= now, "expired").otherwise("ok")
    plain = F.decode(F.aes_decrypt("package", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.encode("binding", "UTF-8")), "UTF-8")
    return joined.select("job_id", status.alias("status"), F.when(status == "ok", F.from_json(plain, "array<struct<placeholder:string,original_value:string>>")).alias("rows"))


def manifest(mapped: DataFrame) -> DataFrame:
    """placeholder, label, text_hash, n of a mapping: what may be shown of it. n counts rows of the mapping, not of texts."""
    return mapped.groupBy("placeholder", "label", "text_hash").agg(F.count(F.lit(1)).alias("n"))


def append_audit(rows: DataFrame, path: str, stream: str, now: Column) -> None:
    """Append audit rows of one stream as JSON lines with their time."""
    import re

    if not re.match(STREAM, stream):
        raise ValueError(f"bad stream name {stream}")
    rows.withColumns({"stream": F.lit(stream), "at": now}).write.mode("append").partitionBy("stream").json(path)


def audit_tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """The newest n rows (1 to 200) of audit lines (line_no, line); a torn line is passed over."""
    if not 1 <= n <= 200:
        raise ValueError("1 to 200 rows")
    newest = lines.orderBy(F.desc("line_no")).limit(n)  # a top-k of bounded size
    kept = newest.withColumn("event", F.get_json_object("line", "$.event")).where(F.col("event").isNotNull())
    return kept.select("line_no", "event")


def open_jobs(jobs: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, rows turned away): calls (job_id, meta as JSON) of jobs; one whose meta has a key that could hold a text is refused."""
    keys = F.json_object_keys("meta")
    bad = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN])), F.lit(True))
    marked = calls.join(jobs.select("job_id"), "job_id", "left_semi").withColumns({"bad": bad, "status": F.lit("open")})
    return marked.where(~F.col("bad")).drop("bad"), marked.where("bad").drop("bad", "status")


def close_jobs(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger with open calls completed or failed by outcomes (call_id, error or null); the first outcome counts, closed calls stay as they are."""
    first = outcomes.groupBy("call_id").agg(F.min_by(F.struct("error"), F.struct("seq")).alias("o"))
    joined = ledger.join(first, "call_id", "left")
    status = F.when((F.col("status") != "open") | F.col("o").isNull(), F.col("status")).when(F.col("o.error").isNull(), "complete").otherwise("failed")
    return joined.withColumn("status", status).drop("o")


def namespaces(events: DataFrame) -> DataFrame:
    """namespace_id, state, n_refused: the fold of create, archive and delete in order of seq. Deleted is final; what doesn't fit the state is refused."""
    ordered = events.groupBy("namespace_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("ops"))

    def step(a: Column, e: Column) -> Column:
        to = F.when((e["op"] == "create") & (a["state"] == "none"), "active").when((e["op"] == "archive") & (a["state"] == "active"), "archived").when((e["op"] == "delete") & a["state"].isin("active", "archived"), "deleted")
        return F.struct(F.coalesce(to, a["state"]).alias("state"), (a["refused"] + to.isNull().cast("int")).alias("refused"))

    folded = F.aggregate("ops", F.struct(F.lit("none").alias("state"), F.lit(0).alias("refused")), step)
    return ordered.select("namespace_id", folded.alias("f")).select("namespace_id", "f.state", F.col("f.refused").alias("n_refused"))


def revoke(grants: DataFrame, states: DataFrame) -> DataFrame:
    """Grants of namespaces that aren't deleted: a namespace's grants go before it does."""
    return grants.join(states.where(F.col("state") == "deleted"), "namespace_id", "left_anti")


def receipt(docs: DataFrame, profile_version: str, dictionary_version: str, detector_version: str) -> DataFrame:
    """docs (doc_id, text) as receipts: a hash of the text and the versions that worked on it."""
    made = F.struct(F.lit(profile_version).alias("profile"), F.lit(dictionary_version).alias("dictionary"), F.lit(detector_version).alias("detectors"))
    return docs.select("doc_id", text_hash("text").alias("text_hash"), made.alias("versions"))


def inspected(rows: DataFrame, category: str, search: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of inspection rows (category, no, ...): those of the category whose row as JSON holds the search text, whatever its case; total is of all such rows."""
    if offset < 0 or not 1 <= limit <= 100 or len(search) > 200 or "\0" in search:
        raise ValueError("bad page or search")
    hit = holds(rows, search)
    found = rows.where((F.col("category") == category) & hit)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("no").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def holds(rows: DataFrame, search: str) -> Column:
    """Whether a row, as JSON, holds the text in any case."""
    needle = search.strip().lower()
    return F.lower(F.to_json(F.struct(*rows.columns))).contains(json.dumps(needle, ensure_ascii=False)[1:-1]) if needle else F.lit(True)


def write_mapping(mapped: DataFrame, path: str) -> None:
    """A mapping in plain text as JSON lines (doc_id, placeholder, label, original_value, text_hash, n), all or nothing: Spark commits the folder when all tasks are done.

    Refuses a folder that is there already. Who may read it is a matter of the folder it stands in.
    """
    mapped.select("doc_id", "placeholder", "label", "original_value", "text_hash", "n").write.mode("error").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, placeholder string, label string, original_value string, text_hash string, n long").json(path)
