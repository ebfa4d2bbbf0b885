"""Queries whose SQL once told a narrower rule than the query, on tables made for it."""

from __future__ import annotations

import datetime

import duckdb
from umbra.plans import queries as plans


def both(spark, folder, name):
    """(rows of the query, rows of its SQL) over the tables of a folder, columns by name."""
    c = duckdb.connect()
    for path in folder.glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'").fetchall()
    df = plans.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = c.execute(f"select {', '.join(columns)} from ({plans.ORACLE[name]}) x").fetchall()
    return sorted(tuple(r[x] for x in columns) for r in df.collect()), sorted(want)


def test_alert_events_leaves_out_values_of_little_entropy(spark, tmp_path):
    # 444444 makes a password of less than three bits.
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in (2, 6, 444444, 123456)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got, want = both(spark, tmp_path, "alert_events")
    assert got == want
    assert sum(r.count("generic_secret") for r in got) == 3


def test_summary_and_secrets_leave_out_values_of_little_entropy(spark, tmp_path):
    spark.createDataFrame([(9, 17), (4378647, 444444), (12, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("alert_summary", "secret_entropy"):
        got, want = both(spark, tmp_path, name)
        assert got == want
        assert all(4378647 not in r for r in got)


def test_formats_leave_out_values_of_little_entropy(spark, tmp_path):
    spark.range(5600, 5700).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got, want = both(spark, tmp_path, "secret_formats")
    assert got == want
    assert all(5632 not in r for r in got)


def test_round_trip_counts_paragraphs_with_longer_numbers(spark, tmp_path):
    # Eleven digits within a longer number are no telephone number; the count of paragraphs that look like one sees them.
    texts = [(1, "card 4491382641088554 here\nand 13826410885544 too"), (2, "mail a.b@c.example.com, 9913866557355100 twice 9913866557355100"), (3, "nothing"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, tmp_path, "docx_round_trip")
    assert got == want
    assert [r[1] for r in got] == [2, 1, 0, 0]


def test_values_of_all_contracts_are_inspected(spark, tmp_path):
    # Every fifth contract has full-width digits: values of its own.
    day = datetime.datetime(1996, 1, 2)
    spark.createDataFrame([(k, 7, day) for k in (1, 2, 5, 6, 10)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = both(spark, tmp_path, "inspection_values")
    assert got == want
    documents = sorted(plans.QUERIES["inspection_values"](spark, str(tmp_path)).toPandas()["documents"])
    assert documents == [2, 2, 3, 3]
