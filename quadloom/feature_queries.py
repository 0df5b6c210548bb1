"""Queries that each isolate one property of dialects, cells, templates, inference and editing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom import issues, runtime
from quadloom.catalogue import SHOWN, SUPPLIER, SUPPLIER_CELLS, B, _lines, _plain, described, quads, query, rows, table_of
from quadloom.functions.terms import XSD
from quadloom.operators import c2r, infer, r2c
from quadloom.plans.descriptor import Loader
from quadloom.sources import tables

# dialects


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS row, n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def csv_skipped(spark, sf_dir):
    """Lines before the header and a first column that the dialect skips."""
    body = runtime.table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(F.concat_ws(",", F.lit("-"), "n_nationkey", "n_name").alias("value"))
    head = spark.createDataFrame([("made by hand",), ("x,y",), ("-,k,v",)], "value string").coalesce(1)
    path = _lines(spark, head.unionByName(body).coalesce(1), "skipped")
    df, t = tables.read_csv(spark, path, _plain(path, ["k", "v"], skipRows=2, skipColumns=1, header=True))
    return df.select(F.col("_row").alias("row"), F.col("_c0").alias("k"), F.col("_c1").alias("v"))


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS v, ' ' || n_name AS q FROM nation")
def csv_trimmed(spark, sf_dir):
    """White space around cells goes, that inside quotes stays."""
    lines = runtime.table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_nationkey", F.lit(" ,  "), "n_name", F.lit("\t, \" "), "n_name", F.lit("\"")).alias("value"))
    path = _lines(spark, lines, "trimmed")
    return tables.read_csv(spark, path, _plain(path, ["k", "v", "q"], trim=True))[0].select(F.col("_c0").alias("k"), F.col("_c1").alias("v"), F.col("_c2").alias("q"))


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def csv_terminators(spark, sf_dir):
    """Records that end in characters of the dialect's choice, of two kinds."""
    one = runtime.table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("x"), (F.col("n_nationkey") % 2).alias("m"))
    text = one.orderBy("m", "x").coalesce(1).groupBy().agg(F.concat(F.array_join(F.collect_list(F.when(F.col("m") == 0, F.col("x"))), "|"), F.lit("~"), F.array_join(F.collect_list(F.when(F.col("m") == 1, F.col("x"))), "~")).alias("value"))
    path = runtime.scratch_path(spark, "terminators")
    text.write.option("lineSep", "|").text(path)
    return tables.read_csv(spark, path, _plain(path, ["k", "v"], lineTerminators=["|", "~"]))[0].select(F.col("_c0").alias("k"), F.col("_c1").alias("v"))


@query("SELECT 'Key' AS first, 'the header n is none of the titles of column 2' AS warning, count(*) AS n FROM nation")
def csv_header_titles(spark, sf_dir):
    """Titles of the schema and the header's are brought together; one that differs is reported."""
    body = runtime.table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    head = spark.createDataFrame([("Key,n",)], "value string").coalesce(1)
    path = _lines(spark, head.unionByName(body.orderBy("value").coalesce(1)).coalesce(1), "titles")
    found = issues.Issues()
    df, t = tables.read_csv(spark, path, table_of(described(path, [{"titles": "Key"}, {"titles": "Name"}])), found)
    return df.agg(F.lit(t.columns[0].title("und")).alias("first"), F.lit(found.items[0][1]).alias("warning"), F.count("*").alias("n"))


# cells


@query(f"""SELECT '{B}p/' || p_partkey AS s, '{B}p.csv#t' AS p, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS o, '{XSD}token' AS o_dt FROM part
UNION ALL SELECT '{B}p/' || p_partkey, '{B}p.csv#s', '  ' || p_name || '  ', '{XSD}string' FROM part UNION ALL SELECT '{B}p/' || p_partkey, '{B}p.csv#d', CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_partkey::VARCHAR END, '{XSD}string' FROM part""")
def c2r_white_space_and_default(spark, sf_dir):
    cells = ["p_partkey", "concat('  ', replace(p_name, ' ', ' \\t '), ' ')", "concat('  ', p_name, '  ')", "case when p_partkey % 3 = 0 then '' else string(p_partkey) end"]
    cols = [{"name": "k", "suppressOutput": True}, {"name": "t", "datatype": "token"}, {"name": "s"}, {"name": "d", "default": "none"}]
    return quads(rows(spark, sf_dir, "part", cells), described("p.csv", cols, aboutUrl=B + "p/{k}")).select(*SHOWN)


@query(" UNION ALL ".join(f"SELECT '{B}o/' || o_orderkey AS s, '{B}o.csv#{c}' AS p, regexp_replace(((o_orderkey % {n}) / {n}.0)::VARCHAR, '\\.?0+$', '') AS o, '{XSD}double' AS o_dt FROM orders" for c, n in (("p", 100), ("m", 1000))))
def c2r_percent(spark, sf_dir):
    """Percent and permille signs divide."""
    cols = [{"name": "k", "suppressOutput": True}, {"name": "p", "datatype": "double"}, {"name": "m", "datatype": "double"}]
    return quads(rows(spark, sf_dir, "orders", ["o_orderkey", "concat(o_orderkey % 100, '%')", "concat(o_orderkey % 1000, '‰')"]), described("o.csv", cols, aboutUrl=B + "o/{k}")).select(*SHOWN)


@query(f"""SELECT '{B}n/' || n_nationkey AS s, 'http://schema.org/name' AS p, n_name AS o, NULL AS o_dt, 'fr' AS o_lang FROM nation WHERE n_name <> 'FRANCE'
UNION ALL SELECT '{B}n/' || n_nationkey, '{B}own', n_name, NULL, 'de' FROM nation WHERE n_name <> 'FRANCE' UNION ALL SELECT '{B}n/' || n_nationkey, 'http://schema.org/name', n_regionkey::VARCHAR, '{XSD}integer', NULL FROM nation""")
def c2r_inherited(spark, sf_dir):
    """Group, table and schema hand properties down to columns; the nearest one counts."""
    cols = [{"name": "k", "suppressOutput": True}, {"name": "v"}, {"name": "w", "lang": "de", "propertyUrl": B + "own"}, {"name": "r", "datatype": "integer"}]
    made = Loader(B).load({"@context": "http://www.w3.org/ns/csvw", "lang": "fr", "null": "FRANCE", "tables": [{"url": "n.csv", "propertyUrl": "schema:name", "aboutUrl": B + "other/{k}", "tableSchema": {"columns": cols, "aboutUrl": B + "n/{k}"}}]})
    out = c2r.row_quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_name", "n_regionkey"]), made.tables[0], 0, c2r.Options(minimal=True))
    return out.select("s", "p", "o", F.when(F.col("o_lang").isNull(), F.col("o_dt")).alias("o_dt"), "o_lang")


@query(f"""SELECT '{B}r/' || (r_regionkey + 1) || '/' || (r_regionkey + 2) AS s, '{B}col/2/name' AS p, r_name AS o, '{XSD}string' AS o_dt FROM region""")
def c2r_row_and_column_templates(spark, sf_dir):
    cols = [{"name": "k", "suppressOutput": True}, {"name": "name", "propertyUrl": B + "col/{_column}/{_name}"}]
    return quads(rows(spark, sf_dir, "region", ["r_regionkey", "r_name"], "r_regionkey + 1"), described("r.csv", cols, aboutUrl=B + "r/{_row}/{_sourceRow}")).select(*SHOWN)


@query(f"""SELECT '{B}o/' || o_orderkey AS s, '{B}o.csv#d' AS p, o_orderdate::DATE::VARCHAR || 'T10:30:00' || CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-05:30' END AS o, '{XSD}dateTime' AS o_dt FROM orders""")
def c2r_time_zones(spark, sf_dir):
    """Zones of several forms behind a pattern."""
    zone = "case o_orderkey % 3 when 0 then 'Z' when 1 then '+02' else '-0530' end"
    cols = [{"name": "k", "suppressOutput": True}, {"name": "d", "datatype": {"base": "dateTime", "format": "yyyy-MM-ddTHH:mmX"}}]
    return quads(rows(spark, sf_dir, "orders", ["o_orderkey", f"concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30', {zone})"]), described("o.csv", cols, aboutUrl=B + "o/{k}")).select(*SHOWN)


@query(f"""SELECT '{XSD}integer' AS o_dt, count(*) FILTER (o_orderkey % 7 < 3) AS n FROM orders UNION ALL SELECT '{XSD}string', count(*) FILTER (o_orderkey % 7 >= 3) FROM orders""")
def c2r_length_of_binary(spark, sf_dir):
    """A cell whose length is not the datatype's is a string; lengths of hexadecimal text are bytes."""
    cols = [{"name": "k", "suppressOutput": True}, {"name": "h", "datatype": {"base": "hexBinary", "length": 3}}]
    q = quads(rows(spark, sf_dir, "orders", ["o_orderkey", "case when o_orderkey % 7 < 3 then 'a0b1c2' else 'a0b1' end"]), described("o.csv", cols, aboutUrl=B + "o/{k}"))
    return q.groupBy(F.when(F.col("o_dt").endswith("hexBinary"), F.lit(XSD + "integer")).otherwise(F.col("o_dt")).alias("o_dt")).agg(F.count("*").alias("n"))


@query("SELECT 'a required cell is empty' AS message, n_nationkey + 1 AS row FROM nation WHERE n_nationkey % 4 = 0")
def issues_as_quads(spark, sf_dir):
    """Issues written as quads and read back: each is a node with its description and row."""
    t = table_of(described("n.csv", [{"name": "k"}, {"name": "v", "required": True}]))
    q = issues.as_quads(c2r.cell_issues(rows(spark, sf_dir, "nation", ["n_nationkey", "case when n_nationkey % 4 = 0 then '' else n_name end"], "n_nationkey + 1"), t))
    own = q.groupBy("s").pivot("p", ["urn:quadloom:issue#description", "urn:quadloom:issue#row"]).agg(F.max("o"))
    return own.select(F.col("`urn:quadloom:issue#description`").alias("message"), F.col("`urn:quadloom:issue#row`").cast("bigint").alias("row"))


# quads to tables, inference, editing


@query("SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 2 = 0)::VARCHAR ELSE '' END AS b FROM orders")
def r2c_boolean_values(spark, sf_dir):
    """Values that are no booleans, or no numbers within bounds, are not of the column; the row stays."""
    cells = ["o_orderkey", "case o_orderkey % 4 when 0 then 'true' when 1 then 'false' when 2 then 'yes' else '' end", "o_orderkey"]
    made = described("o.csv", [{"name": "i", "suppressOutput": True}, {"name": "b"}, {"name": "k"}], aboutUrl=B + "o/{i}")
    q = quads(rows(spark, sf_dir, "orders", cells), made)
    t = table_of(described("o.csv", [{"name": "k", "required": True, "datatype": {"base": "integer", "minimum": 0}}, {"name": "b", "datatype": {"base": "string", "format": "^(true|false)$"}}], aboutUrl=B + "o/{i}"))
    return r2c.table_rows(q, t)


@query("SELECT 'unknown_type.csv' AS url, 3 AS columns, count(*) AS n FROM supplier")
def infer_untyped(spark, sf_dir):
    """Subjects without a class have a table of their own."""
    cols = [c for c in SUPPLIER["tableSchema"]["columns"] if c["name"] in ("s_suppkey", "s_name", "s_nationkey")]
    q = quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS[:3]), described("supplier.csv", cols, aboutUrl=B + "supplier/{s_suppkey}"))
    g = infer.infer(q)
    found = r2c.convert(q, Loader(B).load(g))
    ((url, table),) = found.items()
    return table.agg(F.lit(url.rpartition("/")[2]).alias("url"), F.lit(len(table.columns)).alias("columns"), F.count("*").alias("n"))


@query("""SELECT 'lieferanten.csv' AS url, s_suppkey::VARCHAR AS k, 'Saldo' AS title, regexp_replace(s_acctbal::VARCHAR, '\\.0$', '') AS v FROM supplier
UNION ALL SELECT 'orte.csv', s_suppkey::VARCHAR, 'of', s_nationkey::VARCHAR FROM supplier""")
def edit_tables(spark, sf_dir):
    """An inferred descriptor is edited: a table and a column get new names, a column moves to a new table with a copy of the
    key, another one goes; the quads are then converted by it."""
    nation = {"name": "nation", "propertyUrl": B + "of", "valueUrl": B + "nation/{nation}"}
    kind = {"name": "kind", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": B + "Supplier"}
    cols = [{"name": "k", "suppressOutput": True}, {"name": "s_name"}, nation, {"name": "s_acctbal", "datatype": "double"}, kind]
    q = quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS), described("supplier.csv", cols, aboutUrl=B + "supplier/{k}"))
    g = infer.add_table(infer.rename_table(infer.infer(q), "Supplier.csv", "lieferanten.csv"), "orte.csv")
    name = {c["titles"]: c["name"] for c in g["tables"][0]["tableSchema"]["columns"]}
    g = infer.rename_column(g, "lieferanten.csv", name["s_acctbal"], "Saldo")
    g = infer.move_columns(g, "lieferanten.csv", "orte.csv", [name["of"]])
    g = infer.remove_column(g, "lieferanten.csv", name["s_name"])
    found = r2c.convert(q, Loader(B).load(g))
    parts = [df.select(F.lit(url.rpartition("/")[2]).alias("url"), F.col(df.columns[0]).alias("k"), F.lit(df.columns[1]).alias("title"), F.col(df.columns[1]).alias("v")) for url, df in found.items()]
    return parts[0].unionByName(parts[1])


