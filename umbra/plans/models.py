"""Queries over a model's predictions: names split at line ends, extended to their tails, and repaired, with SQL that finds them by searching for the whole names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.operators import model_spans
from umbra.plans import carriers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: For each order a text with names of the order's customer number; `given` is what the model is said to find, `whole` what it should.
#: Names are told apart by their numbers, and stand behind a beginning of varying length.
_NO = "cast(o_custkey AS string)"
_CASES = (
    # label, what stands in the text, the part predicted, the names that are right (by line; extended; repaired)
    ("ORG", "concat('企业', {n}, '国土资\\n源部；')", "concat('企业', {n}, '国土资\\n源部')", ("concat('企业', {n}, '国土资\\n源部')",), ("concat('企业', {n}, '国土资\\n源部')",)),
    ("ORG", "concat('企业', {n}, '建筑\\n中建', {n}, '局；')", "concat('企业', {n}, '建筑\\n中建', {n}, '局')", ("concat('企业', {n}, '建筑')", "concat('中建', {n}, '局')"), ("concat('企业', {n}, '建筑')", "concat('中建', {n}, '局')")),
    ("ADDRESS", "concat('东湖', {n}, '\\n市；')", "concat('东湖', {n}, '\\n市')", ("concat('东湖', {n}, '\\n市')",), ("concat('东湖', {n}, '\\n市')",)),
    ("ORG", "concat(' 甲', {n}, '公司 \\n\\n丙', {n}, '集团；')", "concat(' 甲', {n}, '公司 \\n\\n丙', {n}, '集团')", ("concat('甲', {n}, '公司')", "concat('丙', {n}, '集团')"), ("concat('甲', {n}, '公司')", "concat('丙', {n}, '集团')")),
    ("PERSON", "concat('张', {n}, '三公司；')", "concat('张', {n}, '三')", ("concat('张', {n}, '三')",), ("concat('张', {n}, '三')",)),
    ("ORG", "concat('宏远', {n}, '建设有限公司的，')", "concat('宏远', {n}, '建设')", ("concat('宏远', {n}, '建设')",), ("concat('宏远', {n}, '建设有限公司')",)),
    ("ADDRESS", "concat('测试大道', {n}, '号楼。')", "concat('测试大道')", ("concat('测试大道')",), ("concat('测试大道', {n}, '号')",)),
    ("ORG", "concat('上海', {n}, '置业\\n有限公司；')", "concat('上海', {n}, '置业')", ("concat('上海', {n}, '置业')",), ("concat('上海', {n}, '置业\\n有限公司')",)),
)


def _case(column: int) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {c[column].format(n=_NO)}" for i, c in enumerate(_CASES)) + " END"


_TEXTS = f"SELECT o_orderkey AS doc_id, concat(repeat('前', cast(o_orderkey % 7 AS int)), '，', {_case(1)}) AS text, cast(o_orderkey % 7 + 1 AS int) AS start, length({_case(2)}) AS size, CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{c[0]}{chr(39)}' for i, c in enumerate(_CASES))} END AS label FROM {{orders}}"


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = carriers.spark_sql(spark, sf_dir, _TEXTS)
    return rows.selectExpr("doc_id", "start", "start + size AS end", "label", "0.9D AS score"), rows.select("doc_id", "text")


def _wanted(column: int) -> str:
    """SQL that looks for the right names in the texts."""
    names = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, {v.format(n=_NO)} AS surface FROM orders WHERE o_orderkey % 8 = {i}" for i, c in enumerate(_CASES) for v in c[column])
    texts = carriers.oracle(_TEXTS)
    made = f"SELECT t.doc_id, CAST(strpos(text, surface) - 1 AS INTEGER) AS start, CAST(strpos(text, surface) - 1 + length(surface) AS INTEGER) AS \"end\", label, surface FROM ({names}) w JOIN ({texts}) t ON t.doc_id = w.doc_id"
    return made.replace("\\n", "' || chr(10) || '").replace("string)", "varchar)")


@query(_wanted(3))
def model_lines(spark, sf_dir):
    predictions, docs = _given(spark, sf_dir)
    return model_spans.split(predictions, docs).select("doc_id", "start", "end", "label", "surface")


@query(_wanted(4))
def model_tails(spark, sf_dir):
    predictions, docs = _given(spark, sf_dir)
    return model_spans.extend(predictions, docs).select("doc_id", "start", "end", "label", "surface")


#: A contract that names the customer's company several times; the model finds it whole once, then shifted, cut and broken, and more that names nobody.
_FULL = f"concat('企业', {_NO}, '置业集团')"
_MENTIONS = f"""SELECT o_orderkey AS doc_id, concat(repeat('前', cast(o_orderkey % 5 AS int)), '，', {_FULL}, '拟收购乙方。其后', '企业', {_NO}, '置\\n业集团签约；公司、项目公司、江城市人民法院与abcd，企业', {_NO}, '置业集团并列') AS text,
cast(o_orderkey % 5 + 1 AS int) AS a, length({_FULL}) AS n, o_orderkey % 4 AS kind FROM {{orders}}"""
_FOUND = """SELECT doc_id, a AS start, a + n + CASE WHEN kind = 0 THEN 3 ELSE 0 END AS e, 'ORG' AS label, 0.9 AS score FROM m
UNION ALL SELECT doc_id, a + n + 8 + CASE WHEN kind = 1 THEN 1 ELSE 0 END, a + n + 8 + n - 3, CASE WHEN kind = 2 THEN 'ADDRESS' ELSE 'ORG' END, 0.8 FROM m
UNION ALL SELECT doc_id, a + 2 * n + 12, a + 2 * n + 14, 'ORG', 0.7 FROM m UNION ALL SELECT doc_id, a + 2 * n + 15, a + 2 * n + 19, 'ORG', 0.7 FROM m UNION ALL SELECT doc_id, a + 2 * n + 20, a + 2 * n + 27, 'ORG', 0.7 FROM m
UNION ALL SELECT doc_id, a + 2 * n + 28, a + 2 * n + 32, 'ORG', 0.99 FROM m UNION ALL SELECT doc_id, a + 2 * n + 34, a + 2 * n + 33 + n, 'ORG', 0.6 FROM m"""


@query(f"""WITH m AS ({carriers.oracle(_MENTIONS)}), f AS (SELECT doc_id, text, substr(text, CAST(a + 1 AS BIGINT), CAST(n AS BIGINT)) AS name, kind FROM m), s AS (SELECT *, regexp_replace(name, '置业', '置' || chr(10) || '业') AS broken FROM f)
SELECT doc_id, CAST(strpos(text, name) - 1 AS INTEGER) AS start, CAST(strpos(text, name) - 1 + length(name) AS INTEGER) AS "end", 'ORG' AS label, name AS surface FROM s
UNION ALL SELECT doc_id, CAST(strpos(text, broken) - 1 AS INTEGER), CAST(strpos(text, broken) - 1 + length(broken) AS INTEGER), CASE WHEN kind = 2 THEN 'ADDRESS' ELSE 'ORG' END, broken FROM s WHERE kind <> 2
UNION ALL SELECT doc_id, CAST(strpos(text, broken) - 1 AS INTEGER), CAST(strpos(text, broken) - 1 + length(name) - 3 AS INTEGER), 'ADDRESS', substr(broken, 1, length(name) - 3) FROM s WHERE kind = 2
UNION ALL SELECT doc_id, CAST(strpos(text, 'abcd，' || name) + 4 AS INTEGER), CAST(strpos(text, 'abcd，' || name) + 4 + length(name) AS INTEGER), 'ORG', name FROM s""".replace("\\n", "' || chr(10) || '").replace("string)", "varchar)"))
def model_repairs(spark, sf_dir):
    rows = carriers.spark_sql(spark, sf_dir, _MENTIONS)
    predictions = spark.sql(f"WITH m AS (SELECT * FROM {{m}}) {_FOUND}", m=rows).selectExpr("doc_id", "start", "e AS end", "label", "CAST(score AS DOUBLE) AS score")
    return model_spans.spans(predictions, rows.select("doc_id", "text")).select("doc_id", "start", "end", "label", "surface")
