"""Dictionaries of known values: reading, merging, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERIC = ("公司", "项目", "部门", "集团", "供应商", "合同", "甲方", "乙方")
SUFFIXES = ("有限公司", "研究院", "设计院", "事务所", "工程局")
LONGEST = 64


def active(entries: DataFrame) -> DataFrame:
    """Entries that are in force and have a value and a label."""
    return entries.where((F.coalesce("status", F.lit("active")) == "active") & (F.trim("canonical_value") != "") & (F.trim("label") != ""))


def version(entries: DataFrame) -> DataFrame:
    return entries.agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("version"))


def needles(entries: DataFrame) -> DataFrame:
    """entry_id, canonical_value, needle, label, risk_level: values and aliases, each once."""
    every = F.array_distinct(F.transform(F.concat(F.array("canonical_value"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x)))
    return active(entries).select("entry_id", "canonical_value", F.explode(every).alias("needle"), "label", "risk_level").where(F.col("needle") != "")


def lint(entries: DataFrame) -> DataFrame:
    """code, entry_id, detail: what is wrong with values and with the set."""
    v = F.col("needle")
    issues = F.array_compact(F.array(
        F.when(F.char_length(v) == 1, "single_character"), F.when(F.char_length(v) > LONGEST, "too_long"), F.when(v.rlike("[。！？；]"), "sentence_punctuation"),
        F.when(F.size(F.regexp_extract_all(v, F.lit(r"\s+"), F.lit(0))) >= 3, "many_spaces"), F.when(v.isin(*GENERIC), "generic_value"), F.when(v.isin(*SUFFIXES), "standalone_suffix"),
    ))
    own = needles(entries)
    values = own.select(F.explode(issues).alias("code"), "entry_id", v.alias("detail"))
    twice = entries.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.lit("duplicate_id").alias("code"), "entry_id", F.col("n").cast("string").alias("detail"))
    by_needle = own.groupBy("needle").agg(F.count_distinct("canonical_value").alias("values"), F.count_distinct("label").alias("labels"), F.min("entry_id").alias("entry_id"))
    identity = by_needle.where(F.col("values") > 1).select(F.lit("identity_conflict").alias("code"), "entry_id", F.col("needle").alias("detail"))
    label = by_needle.where(F.col("labels") > 1).select(F.lit("label_conflict").alias("code"), "entry_id", F.col("needle").alias("detail"))
    return values.unionByName(twice).unionByName(identity).unionByName(label)


# Longest values and general values by label, contexts that are no part of a name, general references.
LONGEST_BY_LABEL = {"ORG": 48, "DEPARTMENT": 48, "PROJECT": 48, "ADDRESS": 80}
GENERAL = {
    "ORG": ("行政机关", "自然资源部", "国土资源管理部门", "人民政府土地管理部门", "城市规划、建设、房产管理部门"),
    "PROJECT": ("项目", "本项目", "投资变更", "房地产开发项目", "产开发项目", "幅经营性地块", "地块房地产开发项目", "投资变更报告", "投资变更的法律意见书", "实施本项目", "共同实施本项目"),
}
BARE_SUFFIXES = {"ORG": ("部", "局", "委", "公司", "有限公司"), "PROJECT": ("项目", "地块")}
CONTEXTS = ("项目公司为", "提请", "编制单位：", "编制单位:", "报来", "送审")
THROUGH = "^经.*(?:公司|集团|委员会|局|部)$"
REFERENCES = ("行政机关", "人民政府", "县人民政府土地管理部门", "市县人民政府国土资源行政主管部门", "人民政府国土资源行政主管部门", "直辖市人民政府", "国务院", "自然资源部", "国土资源部", "国土资源管理部门", "城市规划建设房产管理部门")


def _of(table: dict[str, tuple[str, ...]]) -> Column:
    found = F.lit(False)
    for label, values in table.items():
        found = found | ((F.col("label") == label) & F.col("value").isin(*values))
    return found


def issues(entries: DataFrame) -> DataFrame:
    """code, entry_id, label, field, value: what an owner of a dictionary must look at, by label. Entries that aren't in force have none.

    Values and aliases are judged for themselves (field: canonical_value or aliases[i]); ids given twice, values of one label
    that several entries own and values under several labels for the set.
    """
    rows = active(entries).select("entry_id", F.trim("label").alias("label"), F.trim("canonical_value").alias("first"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    fields = F.concat(F.array(F.struct(F.lit("canonical_value").alias("field"), F.col("first").alias("value"))), F.transform("aliases", lambda a, i: F.struct(F.concat(F.lit("aliases["), i.cast("string"), F.lit("]")).alias("field"), F.trim(a).alias("value"))))
    values = rows.select("entry_id", "label", F.explode(fields).alias("f")).select("entry_id", "label", "f.*").where(F.col("value") != "")
    v, org = F.col("value"), F.col("label") == "ORG"
    longest = F.when(F.lit(False), 0)
    for label, n in LONGEST_BY_LABEL.items():
        longest = longest.when(F.col("label") == label, n)
    named = F.col("label").isin(*LONGEST_BY_LABEL)
    compact = F.regexp_replace(v, "[、，]", "")
    general = F.lit(False)
    for r in REFERENCES:
        general = general | F.lit(r).contains(compact)
    context = F.lit(False)
    for c in CONTEXTS:
        context = context | v.contains(c)
    codes = F.array_compact(F.array(
        F.when(F.char_length(v) == 1, "single_character_value"), F.when(F.char_length(v) > longest, "value_too_long"), F.when(named & v.rlike("[，。；！？,;:：]"), "sentence_punctuation"),
        F.when(named & (F.size(F.regexp_extract_all(v, F.lit(r"(?U)\s+"), F.lit(0))) >= 3), "excessive_whitespace"), F.when(_of(GENERAL), "generic_value"), F.when(_of(BARE_SUFFIXES), "standalone_suffix"),
        F.when(org & (F.char_length(compact) >= 2) & general & ~_of(GENERAL), "generic_fragment"), F.when(context, "context_prefix"), F.when(org & v.rlike(THROUGH), "context_prefix"),
    ))
    one = values.select(F.explode(codes).alias("code"), "entry_id", "label", "field", "value")
    nothing = F.lit(None).cast("string")
    ids = lambda: F.array_join(F.array_sort(F.collect_set("entry_id")), ",")
    twice = rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("entry_id_duplicate").alias("code"), "entry_id", nothing.alias("label"), nothing.alias("field"), nothing.alias("value"))
    owners = values.groupBy("label", "value").agg(F.count_distinct("entry_id").alias("n"), ids().alias("entry_id")).where("n > 1").select(F.lit("identity_conflict").alias("code"), "entry_id", "label", nothing.alias("field"), "value")
    labels = values.groupBy("value").agg(F.count_distinct("label").alias("n"), ids().alias("entry_id"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("label")).where("n > 1").select(F.lit("label_conflict").alias("code"), "entry_id", "label", nothing.alias("field"), "value")
    return one.unionByName(twice).unionByName(owners).unionByName(labels)


def lint_shapes(raw: DataFrame) -> DataFrame:
    """code, index, entry_id: what is wrong with the shape of entries, read as JSON (index, entry as JSON text), before any value is looked at.

    An entry that isn't in force has no issues; one without a label has none further, nor one without a canonical value.
    """
    def of(path: str) -> Column:
        return F.get_json_object("entry", f"$.{path}")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json("entry"), f"$.{path}", "variant"))

    entry = F.schema_of_variant(F.try_parse_json("entry"))
    label, value, aliases, flag = (kind(p) for p in ("label", "canonical_value", "aliases", "allow_leading_ocr_truncation"))
    bare = F.from_json(of("aliases"), "array<string>")
    issues = (
        F.when(~F.coalesce(entry.startswith("OBJECT"), F.lit(False)), F.array(F.lit("entry_not_object")))
        .when(F.coalesce(of("status"), F.lit("active")) != "active", F.array().cast("array<string>"))
        .when((F.coalesce(label, F.lit("")) != "STRING") | (F.trim(of("label")) == ""), F.array(F.lit("label_missing")))
        .when((F.coalesce(value, F.lit("")) != "STRING") | (F.trim(of("canonical_value")) == ""), F.array(F.lit("canonical_missing")))
        .otherwise(F.array_compact(F.array(
            F.when(flag.isNotNull() & ~flag.isin("BOOLEAN", "VOID"), "ocr_repair_flag_invalid"),
            F.when(aliases.isNotNull() & ~aliases.startswith("ARRAY"), "aliases_not_list"),
            F.when(aliases.startswith("ARRAY") & F.exists(bare, lambda a: a.isNull() | (F.trim(a) == "")), "alias_empty"),
        )))
    )
    rows = raw.select("index", F.explode(issues).alias("code"), F.coalesce(of("entry_id"), F.concat(F.lit("index-"), F.col("index").cast("string"))).alias("entry_id"))
    return rows.select("code", "index", "entry_id")
