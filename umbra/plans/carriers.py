"""Texts and spans made from the relational tables, by SQL that Spark and the oracle's engine read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra import workers
from umbra.functions import patterns

#: A contract for each order; full-width digits in every fifth.
CONTRACTS = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN translate(raw, '0123456789', '０１２３４５６７８９') ELSE raw END AS text
FROM (SELECT o_orderkey, concat('合同编号：HT-', 20000000 + o_orderkey, '。联系电话：', 13800000000 + o_custkey, '，邮箱：buyer', o_custkey,
      '@example.com。金额为', 100 + o_orderkey % 9000, '万元，日期：', year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate),
      '日。api_key=', 'k', lpad(cast(o_orderkey AS string), 20, '0'), '。') AS raw FROM {orders}) t
"""
#: A model's predictions for them: a person within each contract's number, which the rule's span covers whole.
MODEL = """SELECT o_orderkey AS doc_id, cast(8 AS int) AS start, cast(11 AS int) AS "end", 'PERSON' AS label, cast(0.9 AS double) AS score FROM {orders}"""
#: Spans of several sources on each document of 70 characters or more, by its key: they overlap each other, and hold, are in, and cross line ends.
SOURCES = """
SELECT doc_id, cast(s AS int) AS start, cast(e AS int) AS "end", label, source, cast(confidence AS double) AS confidence FROM (
SELECT doc_id, 10 + doc_id % 7 AS s, 25 + doc_id % 5 AS e, 'ORG' AS label, 'dictionary' AS source, 0.99 AS confidence FROM {documents} WHERE length(text) >= 70
UNION ALL SELECT doc_id, 20, 32 + doc_id % 11, 'PERSON', 'session_mapping', 1.0 FROM {documents} WHERE length(text) >= 70
UNION ALL SELECT doc_id, 30 - doc_id % 3, 36, 'PROJECT_NAME', 'declared_value', 1.0 FROM {documents} WHERE length(text) >= 70 AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 16, 18 + doc_id % 4, 'DATE', 'manual', 1.0 FROM {documents} WHERE length(text) >= 70 AND doc_id % 3 = 0
UNION ALL SELECT doc_id, 9, 40 + doc_id % 20, 'ADDRESS', 'model', 0.5 + doc_id % 5 / 10.0 FROM {documents} WHERE length(text) >= 70
UNION ALL SELECT doc_id, 41, 44 + doc_id % 13, 'ADDRESS', 'model', 0.7 FROM {documents} WHERE length(text) >= 70
UNION ALL SELECT doc_id, 42, 45, 'PERSON', 'model', 0.95 FROM {documents} WHERE length(text) >= 70) x
"""
#: Rules that find something in them: rule, label, pattern for the oracle (over half-width text), characters in front of the value.
CONTRACT_RULES = (
    ("phone_cn", "CONTACT", "联系电话:([0-9]{11})", 5, 0.97, "high"),
    ("email", "CONTACT", "邮箱:(buyer[0-9]+@example[.]com)", 3, 0.96, "high"),
    ("contract_id", "CONTRACT_ID", "编号:(HT-[0-9]+)", 3, 0.96, "high"),
    ("amount_cny", "AMOUNT", "(金额为[0-9]+万元)", 0, 0.88, "medium"),
    ("amount_cny_unit", "AMOUNT", "金额为([0-9]+万元)", 3, 0.85, "medium"),
    ("date", "DATE", "日期:([0-9]+年[0-9]+月[0-9]+日)", 3, 0.90, "medium"),
    ("token_like", "CREDENTIAL", "api_key=(k[0-9]+)", 8, 0.93, "critical"),
)
#: Mentions of parties for each order, with cues by the key.
PARTIES = """
SELECT o_orderkey AS doc_id, concat('前言。', CASE WHEN o_orderkey % 4 = 0 THEN '甲方：' WHEN o_orderkey % 4 = 1 THEN '承包人：' WHEN o_orderkey % 4 = 2 THEN '担保人' ELSE '见' END,
       'C', lpad(cast(o_custkey AS string), 6, '0'), '；其后另有一段与角色毫无关系的文字，C', lpad(cast(o_custkey AS string), 6, '0'), '。') AS text
FROM {orders}
"""
#: Gold spans, and predictions that miss, shorten or move some.
GOLD = """
SELECT l_orderkey AS doc_id, cast(l_linenumber * 40 AS int) AS start, cast(l_linenumber * 40 + 5 + l_partkey % 20 AS int) AS "end",
       CASE l_partkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'AMOUNT' WHEN 3 THEN 'CONTRACT_ID' WHEN 4 THEN 'PROJECT' ELSE 'ADDRESS' END AS label,
       CASE l_partkey % 3 WHEN 0 THEN 'formatted' WHEN 1 THEN 'known' ELSE 'quasi_identifier' END AS category,
       concat('s', l_suppkey % 4) AS scenario, l_partkey AS part, l_suppkey AS supp
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
"""
_PREDICTED = """
SELECT doc_id, cast(start + CASE WHEN part % 7 = 1 THEN 3 ELSE 0 END AS int) AS start, cast("end" - CASE WHEN part % 7 = 2 THEN 2 ELSE 0 END AS int) AS "end",
       CASE WHEN part % 11 = 3 THEN 'OTHER' ELSE label END AS label
FROM ($GOLD) g WHERE part % 7 <> 4
"""
PREDICTED = _PREDICTED.replace("$GOLD", GOLD)
#: Gold spans of which every fourth is semantic, and predictions with a source and a confidence, some of which only touch a gold span.
MEANT = f"""SELECT doc_id, start, "end", label, CASE WHEN part % 4 = 0 THEN 'semantic_sensitive' ELSE category END AS category, scenario, part, supp FROM ({GOLD}) m"""
FOUND = f"""
SELECT doc_id, cast(start + CASE WHEN part % 7 = 1 THEN 3 ELSE 0 END AS int) AS start, cast("end" - CASE WHEN part % 7 = 2 THEN 2 ELSE 0 END AS int) AS "end", CASE WHEN part % 11 = 3 THEN 'OTHER' ELSE label END AS label,
       'model' AS source, cast(supp % 10 AS double) / 10 AS confidence FROM ({GOLD}) g WHERE part % 7 <> 4
UNION ALL SELECT doc_id, cast(start - 4 AS int), cast(start + 2 AS int), label, 'rule', cast(0.9 AS double) FROM ({GOLD}) h WHERE part % 5 = 0
"""
#: Overlapping spans with priorities for the sweep.
OVERLAPS = """
SELECT l_orderkey AS doc_id, cast(l_partkey % 30 AS int) AS start, cast(l_partkey % 30 + 1 + l_suppkey % 12 AS int) AS "end", concat('L', l_partkey % 3) AS label,
       cast(l_linenumber % 3 AS int) AS priority, cast(l_suppkey % 5 AS double) / 10 AS confidence, concat('s', l_linenumber) AS source
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
"""
#: Whether a value has the bits of entropy from which on the guard takes it for a secret, for the oracle.
ENOUGH = f"list_aggregate(string_split({{}}, ''), 'entropy') >= {patterns.SECRET_BITS}"


TABLES = ("orders", "lineitem", "customer", "supplier", "events", "part", "documents", "conversations", "pages", "nation")
#: What carriers group of them.
GROUPED = {"lineitem": ("l_orderkey", "l_linenumber")}


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The carrier over the tables of a folder.

    A table that it groups is dealt by what it groups first, in parts by size: of groups, which are small in a shuffle, Spark
    makes about a part for each core, however large the table.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    for t, keys in GROUPED.items():
        if "{" + t + "} GROUP BY " + ", ".join(keys) in sql:
            tables[t] = tables[t].repartition(workers.parts(tables[t]), *keys)
    return spark.sql(sql.replace('"end"', "`end`"), **tables)


def oracle(sql: str) -> str:
    """The carrier for the oracle's engine."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
