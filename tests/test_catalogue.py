"""A cross-section of the catalogue against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quadloom import catalogue, runtime, stream_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["c2r_full_region", "c2r_ordered_list", "c2r_null_facets", "c2r_number_pattern", "c2r_datetime", "csv_dialect_roundtrip", "nquads_roundtrip", "turtle_roundtrip", "r2c_optional", "r2c_chain", "r2c_typed_root",
         "r2c_multivalue_cross", "r2c_filter_number", "r2c_filter_lang", "r2c_roundtrip_customer", "infer_columns", "infer_template", "issues_required", "fk_check", "window_ring", "stream_c2r",
         "jsonld_roundtrip", "trig_roundtrip", "csv_blank_lines", "csv_ragged", "csv_headerless", "csv_encoding", "csv_row_numbers", "r2c_optional_chain", "r2c_two_variables",
         "r2c_constant_literal", "r2c_key_root", "r2c_cycle", "r2c_issues", "infer_template_mixed", "csv_skipped", "csv_trimmed", "csv_terminators", "c2r_percent", "c2r_inherited", "issues_as_quads"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    return sorted(tuple("NULL" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_row_conversion_has_no_exchange_and_no_python(spark):
    plan = catalogue.c2r_minimal_nation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_a_star_takes_one_exchange_and_pushes_its_predicates(spark):
    plan = catalogue.r2c_star_required(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_trig_parts_stay_whole_when_their_files_are_large(spark, duck, monkeypatch):
    """Files larger than a split, and more blocks than a file may hold: no block is cut, each file has its prefixes."""
    monkeypatch.setattr(catalogue.serialize, "BLOCKS", 3, raising=False)
    small = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = catalogue.trig_roundtrip(spark, SF).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows(got) == rows(duck.sql(catalogue.ORACLES["trig_roundtrip"]).df())


def test_what_windows_emit_is_dealt_by_the_number_of_rows(spark, duck, monkeypatch):
    """A task's share is a number of rows: with more rows there are more tasks, whatever the session's setting."""
    monkeypatch.setattr(runtime, "SHARE", 1000, raising=False)
    got = catalogue.QUERIES["window_emit_filter"](spark, SF)
    per_file = [r[0] for r in got.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(per_file) > int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per_file) < 2500
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert rows(got.toPandas()) == rows(duck.sql(catalogue.ORACLES["window_emit_filter"]).df())


def test_hubs_are_read_once_and_crossed_like_lists(spark, monkeypatch):
    """Every kind of column in every place, grids of one and of many cells; the quads are not read again for each column."""
    made = [catalogue.described("h.csv", [{"name": "s", "suppressOutput": True}, {"name": c}], aboutUrl=catalogue.B + "h/{s}") for c in ("a", "b", "c")]
    cells = lambda c, n, where: spark.range(n).where(where).select(F.expr("if(id % 3 = 0, 'x', string(id % 5))").alias("_c0"), F.expr(f"concat('{c}', id div 2)").alias("_c1"), F.lit(1).cast("bigint").alias("_row"))
    parts = [catalogue.quads(cells(c, n, w), d) for c, n, w, d in zip("abc", (12, 90, 9), ("id > 1", "id % 5 <> 1", "id % 3 <> 0"), made, strict=True)]
    q = runtime.materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "test-quads")
    for needed in ("", "a", "b", "c", "ab"):
        t = catalogue.table_of(catalogue.described("h.csv", [{"name": c, "required": c in needed} for c in "abc"], aboutUrl=catalogue.B + "h/{s}"))
        want = rows(catalogue.r2c.table_rows(q, t, distinct=True).toPandas())
        for cell in (10, 1_000_000):
            monkeypatch.setattr(catalogue.r2c.Hubs, "CELL", cell, raising=False)
            got = catalogue.r2c.table_rows(q, t, hubs=3, distinct=True)
            assert rows(got.toPandas()) == want
    plan = catalogue.QUERIES["r2c_hub"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("hub-quads") <= 1 and "l_orderkey" not in plan
