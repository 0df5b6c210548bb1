"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.functions import numbers
from quadloom.functions.terms import CSVW, PREFIXES, RDF, XSD
from quadloom.issues import counts
from quadloom.operators import c2r, infer, r2c, serialize
from quadloom.plans.descriptor import Loader, Table, TableGroup
from quadloom.sources import rdf, tables
from quadloom.streaming import windows

B = "http://example.org/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MINIMAL = c2r.Options(minimal=True)
SHOWN = ["s", "p", "o", "o_dt"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def group(*described: dict[str, Any], lang: str | None = None) -> TableGroup:
    context: Any = ["http://www.w3.org/ns/csvw", {"@language": lang}] if lang else "http://www.w3.org/ns/csvw"
    return Loader(B).load({"@context": context, "tables": list(described)})


def described(url: str, columns: list[dict[str, Any]], **more: Any) -> dict[str, Any]:
    own = {k: more.pop(k) for k in ("primaryKey", "foreignKeys", "rowTitles", "aboutUrl") if k in more}
    return {"url": url, "tableSchema": {"columns": columns, **own}, **more}


def rows(spark: SparkSession, sf_dir: str, name: str, columns: list[str], row: str = "1") -> DataFrame:
    """A test table's columns as cells; ``row`` gives the row number."""
    return runtime.table(spark, sf_dir, name).select(*[F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"_c{i}") for i, c in enumerate(columns)], F.expr(row).cast("bigint").alias("_row"))


def quads(df: DataFrame, table: dict[str, Any], options: c2r.Options = MINIMAL) -> DataFrame:
    return c2r.row_quads(df, group(table).tables[0], 0, options)


def table_of(t: dict[str, Any]) -> Table:
    return group(t).tables[0]


def _cell(view: str, key: str, url: str, name: str, value: str, dt: str = "string", where: str = "true", s: str | None = None, graph: str = "") -> str:
    """One column's triples in SQL."""
    return f"SELECT {s or f'{repr(B + view + chr(47))} || {key}'} AS s, '{B}{url}#{name}' AS p, {value} AS o, {repr(XSD + dt) if dt else 'NULL'} AS o_dt FROM {view} WHERE {where}"


NUM = "regexp_replace({}::VARCHAR, '\\.0$', '')"

NATION = described("nation.csv", [{"name": "n_nationkey", "datatype": "integer"}, {"name": "n_name"}, {"name": "n_regionkey", "datatype": "integer"}], aboutUrl=B + "nation/{n_nationkey}")
REGION = described("region.csv", [{"name": "r_regionkey", "datatype": "integer"}, {"name": "r_name"}], aboutUrl=B + "region/{r_regionkey}")
NATION_SQL = " UNION ALL ".join([_cell("nation", "n_nationkey", "nation.csv", "n_nationkey", "n_nationkey::VARCHAR", "integer"), _cell("nation", "n_nationkey", "nation.csv", "n_name", "n_name"), _cell("nation", "n_nationkey", "nation.csv", "n_regionkey", "n_regionkey::VARCHAR", "integer")])
REGION_SQL = " UNION ALL ".join([_cell("region", "r_regionkey", "region.csv", "r_regionkey", "r_regionkey::VARCHAR", "integer"), _cell("region", "r_regionkey", "region.csv", "r_name", "r_name")])


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), NATION)


@query(NATION_SQL)
def c2r_minimal_nation(spark, sf_dir):
    return nation_quads(spark, sf_dir).select(*SHOWN)


@query(f"""WITH r AS (SELECT *, r_regionkey + 1 AS n FROM region) {REGION_SQL.replace('FROM region', 'FROM r')}
UNION ALL SELECT '_:t0', '{CSVW}row', '_:t0r' || n, NULL FROM r UNION ALL SELECT '_:t0r' || n, '{RDF}type', '{CSVW}Row', NULL FROM r
UNION ALL SELECT '_:t0r' || n, '{CSVW}rownum', n::VARCHAR, '{XSD}integer' FROM r UNION ALL SELECT '_:t0r' || n, '{CSVW}url', '{B}region.csv#row=' || (n + 1), NULL FROM r
UNION ALL SELECT '_:t0r' || n, '{CSVW}describes', '{B}region/' || r_regionkey, NULL FROM r UNION ALL SELECT '_:t0r' || n, '{CSVW}title', r_name, '{XSD}string' FROM r
UNION ALL SELECT * FROM (VALUES ('_:g', '{RDF}type', '{CSVW}TableGroup', NULL), ('_:g', '{CSVW}table', '_:t0', NULL), ('_:t0', '{RDF}type', '{CSVW}Table', NULL), ('_:t0', '{CSVW}url', '{B}region.csv', NULL))""")
def c2r_full_region(spark, sf_dir):
    own = group({**REGION, "tableSchema": {**REGION["tableSchema"], "rowTitles": ["r_name"]}})
    return c2r.convert(spark, own, lambda t: (rows(spark, sf_dir, "region", ["r_regionkey", "r_name"], "r_regionkey + 1"), t)).select(*SHOWN)


@query(f"SELECT '{B}nation/' || n_nationkey AS s, '{B}inRegion' AS p, '{B}region/' || n_regionkey AS o FROM nation")
def c2r_valueurl_fk(spark, sf_dir):
    t = described("nation.csv", [{"name": "n_nationkey", "suppressOutput": True}, {"name": "n_regionkey", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{n_regionkey}"}], aboutUrl=B + "nation/{n_nationkey}")
    return quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]), t).select("s", "p", "o")


@query(" UNION ALL ".join([_cell("supplier", "", "supplier.csv", "s_name", "s_name", s="'_:t0r' || s_suppkey || 's'"), _cell("supplier", "", "supplier.csv", "s_nationkey", "s_nationkey::VARCHAR", "integer", s="'_:t0r' || s_suppkey || 's'")]))
def c2r_default_subject(spark, sf_dir):
    return quads(rows(spark, sf_dir, "supplier", ["s_name", "s_nationkey"], "s_suppkey"), described("supplier.csv", [{"name": "s_name"}, {"name": "s_nationkey", "datatype": "integer"}])).select(*SHOWN)


def _words(ordered: bool) -> dict[str, Any]:
    return described("part.csv", [{"name": "p_partkey", "suppressOutput": True}, {"name": "p_name", "separator": " ", "ordered": ordered}], aboutUrl=B + "part/{p_partkey}")


@query(f"SELECT DISTINCT '{B}part/' || p_partkey AS s, '{B}part.csv#p_name' AS p, w AS o, '{XSD}string' AS o_dt FROM part, unnest(string_split(p_name, ' ')) AS u(w) WHERE w <> ''")
def c2r_unordered_list(spark, sf_dir):
    return quads(rows(spark, sf_dir, "part", ["p_partkey", "p_name"]), _words(False)).select(*SHOWN)


@query(f"""WITH w AS (SELECT p_partkey AS k, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS l FROM part), i AS (SELECT k, l, unnest(range(0, len(l))) AS i FROM w)
SELECT '{B}part/' || k AS s, '{B}part.csv#p_name' AS p, '_:t0r' || k || 'c1i0' AS o, NULL AS o_dt FROM w WHERE len(l) > 0
UNION ALL SELECT '_:t0r' || k || 'c1i' || i, '{RDF}first', l[i + 1], '{XSD}string' FROM i
UNION ALL SELECT '_:t0r' || k || 'c1i' || i, '{RDF}rest', CASE WHEN i + 1 < len(l) THEN '_:t0r' || k || 'c1i' || (i + 1) ELSE '{RDF}nil' END, NULL FROM i""")
def c2r_ordered_list(spark, sf_dir):
    return quads(rows(spark, sf_dir, "part", ["p_partkey", "p_name"], "p_partkey"), _words(True)).select(*SHOWN)


@query(_cell("orders", "o_orderkey", "orders.csv", "o_orderstatus", "o_orderstatus", where="o_orderstatus <> 'F'"))
def c2r_null_facets(spark, sf_dir):
    t = described("orders.csv", [{"name": "o_orderkey", "suppressOutput": True}, {"name": "o_orderstatus", "null": ["F", ""]}], aboutUrl=B + "orders/{o_orderkey}")
    return quads(rows(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]), t).select(*SHOWN)


TYPED_CUSTOMER = described("customer.csv", [{"name": "c_custkey", "suppressOutput": True}, {"name": "c_name", "required": True}, {"name": "kind", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": "schema:Person"}], aboutUrl=B + "customer/{c_custkey}")


@query(_cell("customer", "c_custkey", "customer.csv", "c_name", "c_name") + f" UNION ALL SELECT '{B}customer/' || c_custkey, '{RDF}type', '{PREFIXES['schema']}Person', NULL FROM customer")
def c2r_suppress_virtual(spark, sf_dir):
    return quads(rows(spark, sf_dir, "customer", ["c_custkey", "c_name"]), TYPED_CUSTOMER).select(*SHOWN)


@query(f"SELECT '{B}region/' || r_regionkey AS s, '{B}region.csv#Region%20name' AS p, r_name AS o, '{RDF}langString' AS o_dt, 'en' AS o_lang FROM region")
def c2r_lang_titles(spark, sf_dir):
    t = described("region.csv", [{"name": "k", "suppressOutput": True}, {"titles": "Region name", "lang": "en"}], aboutUrl=B + "region/{k}")
    return quads(rows(spark, sf_dir, "region", ["r_regionkey", "r_name"]), t).select(*SHOWN, "o_lang")


@query(" UNION ALL ".join(_cell("lineitem", "l_orderkey || '-' || l_linenumber", "lineitem.csv", c, NUM.format(c), "double") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def c2r_datatypes_number(spark, sf_dir):
    cols = [{"name": c, "datatype": "double"} for c in ("l_quantity", "l_extendedprice", "l_discount")]
    t = described("lineitem.csv", [{"name": "k", "suppressOutput": True}, {"name": "n", "suppressOutput": True}, *cols], aboutUrl=B + "lineitem/{k}-{n}")
    return quads(rows(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]), t).select(*SHOWN)


@query(_cell("part", "p_partkey", "part.csv", "p_retailprice", NUM.format("p_retailprice"), "decimal"))
def c2r_number_pattern(spark, sf_dir):
    t = described("part.csv", [{"name": "p_partkey", "suppressOutput": True}, {"name": "p_retailprice", "datatype": {"base": "decimal", "format": {"pattern": "#,##0.00", "groupChar": ".", "decimalChar": ","}}}], aboutUrl=B + "part/{p_partkey}")
    df = runtime.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_c0"), numbers.show(F.col("p_retailprice"), "#,##0.00", ",", ".").alias("_c1"), F.lit(1).cast("bigint").alias("_row"))
    return quads(df, t).select(*SHOWN)


@query(_cell("orders", "o_orderkey", "orders.csv", "o_orderdate", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "dateTime"))
def c2r_datetime(spark, sf_dir):
    t = described("orders.csv", [{"name": "o_orderkey", "suppressOutput": True}, {"name": "o_orderdate", "datatype": {"base": "datetime", "format": "dd.MM.yyyy HH:mm:ss"}}], aboutUrl=B + "orders/{o_orderkey}")
    return quads(rows(spark, sf_dir, "orders", ["o_orderkey", "date_format(o_orderdate, 'dd.MM.yyyy HH:mm:ss')"]), t).select(*SHOWN)


@query(_cell("labels", "doc_id", "labels.csv", "toxic", "CASE toxic WHEN 1 THEN 'true' ELSE 'false' END", "boolean"))
def c2r_boolean_format(spark, sf_dir):
    t = described("labels.csv", [{"name": "doc_id", "suppressOutput": True}, {"name": "toxic", "datatype": {"base": "boolean", "format": "Y|N"}}], aboutUrl=B + "labels/{doc_id}")
    return quads(rows(spark, sf_dir, "labels", ["doc_id", "if(toxic = 1, 'Y', 'N')"]), t).select(*SHOWN)


@query(_cell("customer", "c_custkey", "customer.csv", "c_mktsegment", "c_mktsegment"))
def c2r_invalid_cell(spark, sf_dir):
    t = described("customer.csv", [{"name": "c_custkey", "suppressOutput": True}, {"name": "c_mktsegment", "datatype": "integer"}], aboutUrl=B + "customer/{c_custkey}")
    return quads(rows(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]), t).select(*SHOWN)


@query(f"SELECT '{B}events/' || event_id AS s, '{B}events.csv#props' AS p, props AS o, '{CSVW}JSON' AS o_dt FROM events")
def c2r_json_props(spark, sf_dir):
    t = described("events.csv", [{"name": "event_id", "suppressOutput": True}, {"name": "props", "datatype": "json"}], aboutUrl=B + "events/{event_id}")
    return quads(rows(spark, sf_dir, "events", ["event_id", "props"]), t).select(*SHOWN)


@query(f"{NATION_SQL} UNION ALL {REGION_SQL}")
def c2r_multi_table_group(spark, sf_dir):
    frames = {B + "nation.csv": rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), B + "region.csv": rows(spark, sf_dir, "region", ["r_regionkey", "r_name"])}
    return c2r.convert(spark, group(NATION, REGION), lambda t: (frames[t.url], t), MINIMAL).select(*SHOWN)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ';' AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_dialect_roundtrip(spark, sf_dir):
    path = runtime.scratch_path(spark, "csv")
    t = table_of({**described(path, [{"name": "n_nationkey"}, {"name": "n_name"}, {"name": "n_regionkey"}]), "dialect": {"delimiter": ";", "quoteChar": "'"}})
    tables.write_csv(runtime.table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(";")).alias("n_name"), "n_regionkey").coalesce(1), path, t.dialect)
    df, full = tables.read_csv(spark, path, t)
    return c2r.cells(df, full).select(*[F.col(f"x{i}.lex").alias(c.name) for i, c in enumerate(full.columns)])


SUPPLIER = described("supplier.csv", [{"name": "s_suppkey", "suppressOutput": True}, {"name": "s_name", "required": True}, {"name": "s_nationkey", "datatype": "integer"}, {"name": "s_acctbal", "datatype": "double"}], aboutUrl=B + "supplier/{s_suppkey}")
SUPPLIER_CELLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
SUPPLIER_SQL = " UNION ALL ".join([_cell("supplier", "s_suppkey", "supplier.csv", "s_name", "s_name"), _cell("supplier", "s_suppkey", "supplier.csv", "s_nationkey", "s_nationkey::VARCHAR", "integer"), _cell("supplier", "s_suppkey", "supplier.csv", "s_acctbal", NUM.format("s_acctbal"), "double")])


@query(SUPPLIER_SQL)
def nquads_roundtrip(spark, sf_dir):
    path = runtime.scratch_path(spark, "supplier") + ".nq"
    serialize.write(quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS), SUPPLIER), path)
    return rdf.read_rdf(spark, path).select(*SHOWN)


@query(SUPPLIER_SQL)
def turtle_roundtrip(spark, sf_dir):
    path = runtime.scratch_path(spark, "supplier")
    serialize.write(quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS), SUPPLIER), path, "turtle")
    return rdf.read_rdf(spark, path, B + "x.ttl").select(*SHOWN)


@query(SUPPLIER_SQL)
def jsonld_roundtrip(spark, sf_dir):
    path = runtime.scratch_path(spark, "supplier") + ".jsonld"
    serialize.write(quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS), SUPPLIER), path)
    return rdf.read_rdf(spark, path).select(*SHOWN)


@query(f"SELECT s_name, s_nationkey::VARCHAR AS s_nationkey, '{B}g' AS g FROM supplier")
def trig_roundtrip(spark, sf_dir):
    """Blank nodes in a named graph, written as several parts, are still the same nodes."""
    made = quads(rows(spark, sf_dir, "supplier", ["s_name", "s_nationkey"], "s_suppkey"), described("supplier.csv", [{"name": "s_name"}, {"name": "s_nationkey", "datatype": "integer"}]))
    path = runtime.scratch_path(spark, "supplier") + ".trig"
    # each predicate in blocks of its own, so that a node's triples lie in different parts
    halves = [made.where(F.col("p").endswith(c)).withColumn("g", F.lit(B + "g")) for c in ("s_name", "s_nationkey")]
    for half in halves:
        serialize.write(half, path, "trig", "append")
    read = rdf.read_rdf(spark, path)
    name, nation = (read.where(F.col("p").endswith(c)).select("s", "g", F.col("o").alias(c)) for c in ("s_name", "s_nationkey"))
    return name.join(nation, ["s", "g"]).select("s_name", "s_nationkey", "g")


def _lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = runtime.scratch_path(spark, name)
    lines.write.text(path)
    return path


def _plain(path: str, names: list[str], **dialect: Any) -> Table:
    return table_of({**described(path, [{"name": n} for n in names]), "dialect": {"header": False, **dialect}})


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) SELECT 2 * i - 1 AS row, r_regionkey::VARCHAR AS k, r_name AS v FROM r UNION ALL SELECT 2 * i, '', '' FROM r")
def csv_blank_lines(spark, sf_dir):
    lines = runtime.table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select(F.explode(F.array(F.concat_ws(",", "r_regionkey", "r_name"), F.lit(""))).alias("value"))
    path = _lines(spark, lines, "blank")
    return tables.read_csv(spark, path, _plain(path, ["k", "v"]))[0].select(F.col("_row").alias("row"), F.col("_c0").alias("k"), F.col("_c1").alias("v"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS row FROM nation)
SELECT row, 'the row has ' || CASE n_nationkey % 3 WHEN 1 THEN 1 ELSE 3 END || ' cells, the table 2' AS message FROM r WHERE n_nationkey % 3 <> 0""")
def csv_ragged(spark, sf_dir):
    cells = F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(",", "n_nationkey", "n_name")).when(F.col("n_nationkey") % 3 == 1, F.col("n_nationkey").cast("string")).otherwise(F.concat_ws(",", "n_nationkey", "n_name", F.lit("x")))
    path = _lines(spark, runtime.table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(cells.alias("value")), "ragged")
    return c2r.cell_issues(*tables.read_csv(spark, path, _plain(path, ["k", "v"]))).select("row", "message")


@query("SELECT '_col.1' AS name, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT '_col.2', n_name FROM nation")
def csv_headerless(spark, sf_dir):
    path = _lines(spark, runtime.table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")), "headerless")
    df, full = tables.read_csv(spark, path, table_of({"url": path, "dialect": {"header": False}}))
    cells = F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"_c{i}").alias("value")) for i, c in enumerate(full.columns)])
    return df.select(F.inline(cells))


@query("SELECT n_nationkey::VARCHAR AS k, n_name || 'é' AS v FROM nation")
def csv_encoding(spark, sf_dir):
    path = runtime.scratch_path(spark, "latin1")
    runtime.table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("é"))).write.option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(spark, path, _plain(path, ["k", "v"], encoding="latin1"))[0].select(F.col("_c0").alias("k"), F.col("_c1").alias("v"))


@query("SELECT count(*) AS n, 1::BIGINT AS lo, count(*) AS hi, count(*) AS kinds FROM orders")
def csv_row_numbers(spark, sf_dir):
    """Several files with comment lines of a long prefix: rows are numbered 1 to n over all of them."""
    lines = runtime.table(spark, sf_dir, "orders").repartition(3).select(F.explode(F.array(F.lit("// a note"), F.col("o_orderkey").cast("string"))).alias("value"))
    path = _lines(spark, lines, "numbers")
    rows_ = tables.read_csv(spark, path, _plain(path, ["k"], commentPrefix="//"))[0]
    return rows_.agg(F.count("*").alias("n"), F.min("_row").alias("lo"), F.max("_row").alias("hi"), F.count_distinct("_row").alias("kinds"))


@query(f"SELECT s_name, s_nationkey::VARCHAR AS s_nationkey, {NUM.format('s_acctbal')} AS s_acctbal FROM supplier")
def r2c_star_required(spark, sf_dir):
    t = described("supplier.csv", [c for c in SUPPLIER["tableSchema"]["columns"] if c["name"] != "s_suppkey"], aboutUrl=B + "supplier/{s_suppkey}")
    return r2c.table_rows(quads(rows(spark, sf_dir, "supplier", SUPPLIER_CELLS), SUPPLIER), table_of(t))


@query("SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def r2c_optional(spark, sf_dir):
    cols = [{"name": "o_orderpriority", "required": True}, {"name": "o_orderstatus"}]
    made = described("orders.csv", [{"name": "o_orderkey", "suppressOutput": True}, cols[0], {**cols[1], "null": "F"}], aboutUrl=B + "orders/{o_orderkey}")
    q = quads(rows(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]), made)
    return r2c.table_rows(q, table_of(described("orders.csv", cols, aboutUrl=B + "orders/{o_orderkey}")))


@query("SELECT n_name, n_regionkey::VARCHAR AS region, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def r2c_chain(spark, sf_dir):
    made = described("geo.csv", [{"name": "n", "suppressOutput": True}, {"name": "n_name"}, {"name": "region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}"}], aboutUrl=B + "nation/{n}")
    other = described("geo.csv", [{"name": "region", "suppressOutput": True}, {"name": "r_name"}], aboutUrl=B + "region/{region}")
    q = quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), made).unionByName(quads(rows(spark, sf_dir, "region", ["r_regionkey", "r_name"]), other))
    t = described("geo.csv", [{"name": "n_name", "required": True, "aboutUrl": B + "nation/{n}"}, {"name": "region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}", "aboutUrl": B + "nation/{n}"}, {"name": "r_name", "aboutUrl": B + "region/{region}"}])
    return r2c.table_rows(q, table_of(t))


@query("""SELECT n_name, CASE WHEN r_name IS NULL THEN '' ELSE n_regionkey::VARCHAR END AS region, coalesce(r_name, '') AS r_name
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def r2c_optional_chain(spark, sf_dir):
    """An optional link to a star with a required column: rows without it stay, with both cells empty."""
    made = described("geo.csv", [{"name": "n", "suppressOutput": True}, {"name": "n_name"}, {"name": "region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}"}], aboutUrl=B + "nation/{n}")
    other = described("geo.csv", [{"name": "region", "suppressOutput": True}, {"name": "r_name"}], aboutUrl=B + "region/{region}")
    q = quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), made).unionByName(quads(rows(spark, sf_dir, "region", ["r_regionkey", "r_name"]).where("_c0 < 3"), other))
    t = described("geo.csv", [{"name": "n_name", "required": True, "aboutUrl": B + "nation/{n}"}, {"name": "region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}", "aboutUrl": B + "nation/{n}"},
                              {"name": "r_name", "required": True, "aboutUrl": B + "region/{region}"}])
    return r2c.table_rows(q, table_of(t))


@query("SELECT o_orderpriority, o_orderstatus FROM orders")
def r2c_two_variables(spark, sf_dir):
    """Two stars without a link belong together where all variables that their templates share agree."""
    keys = ["o_orderkey div 100", "o_orderkey % 100"]
    made = [described("o.csv", [{"name": "a", "suppressOutput": True}, {"name": "b", "suppressOutput": True}, {"name": c}], aboutUrl=B + kind + "/{a}/{b}") for kind, c in (("first", "o_orderpriority"), ("second", "o_orderstatus"))]
    q = quads(rows(spark, sf_dir, "orders", [*keys, "o_orderpriority"]), made[0]).unionByName(quads(rows(spark, sf_dir, "orders", [*keys, "o_orderstatus"]), made[1]))
    return r2c.table_rows(q, table_of(described("o.csv", [{"name": "o_orderpriority", "required": True, "aboutUrl": B + "first/{a}/{b}"}, {"name": "o_orderstatus", "required": True, "aboutUrl": B + "second/{a}/{b}"}])))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def r2c_typed_root(spark, sf_dir):
    q = quads(rows(spark, sf_dir, "customer", ["c_custkey", "c_name"]), TYPED_CUSTOMER)
    t = described("customer.csv", [{"name": "c_custkey", "propertyUrl": "rdf:type", "valueUrl": "schema:Person", "required": True}, {"name": "c_name"}], aboutUrl=B + "customer/{c_custkey}")
    return r2c.table_rows(q, table_of(t))


@query("SELECT coalesce(l.quality::VARCHAR, '') AS quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def r2c_all_optional_seed(spark, sf_dir):
    a = described("docs.csv", [{"name": "d", "suppressOutput": True}, {"name": "lang"}], aboutUrl=B + "d/{d}")
    b = described("docs.csv", [{"name": "d", "suppressOutput": True}, {"name": "quality", "datatype": "integer"}], aboutUrl=B + "d/{d}")
    q = quads(rows(spark, sf_dir, "documents", ["doc_id", "lang"]), a).unionByName(quads(rows(spark, sf_dir, "labels", ["doc_id", "quality"]), b))
    return r2c.table_rows(q, table_of(described("docs.csv", [{"name": "quality", "datatype": "integer"}, {"name": "lang"}], aboutUrl=B + "d/{d}")))


@query("""WITH v AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'hub' ELSE l_orderkey::VARCHAR END AS s, l_orderkey * 10 + l_linenumber AS n FROM lineitem),
f AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'hub' ELSE l_orderkey::VARCHAR END AS s, l_returnflag AS r, l_linestatus AS t FROM lineitem WHERE l_linenumber <> 3),
r AS (SELECT DISTINCT s, r FROM f), t AS (SELECT DISTINCT s, t FROM f WHERE t = 'O')
SELECT n::VARCHAR AS n, r, coalesce(t, '') AS t FROM v JOIN r USING (s) LEFT JOIN t USING (s)""")
def r2c_hub(spark, sf_dir):
    """One subject has half of all values: its columns are crossed over a grid of tasks, without a list."""
    made = described("h.csv", [{"name": "s", "suppressOutput": True}, {"name": "n", "datatype": "integer"}], aboutUrl=B + "h/{s}")
    flag = lambda c: described("h.csv", [{"name": "s", "suppressOutput": True}, {"name": c}], aboutUrl=B + "h/{s}")
    s = "case when l_orderkey % 2 = 0 then 'hub' else string(l_orderkey) end"
    others = [quads(rows(spark, sf_dir, "lineitem", [s, f"case when l_linenumber <> 3 {more} then {c} else '' end"]), flag(n)) for n, c, more in (("r", "l_returnflag", ""), ("t", "l_linestatus", "and l_linestatus = 'O'"))]
    q = quads(rows(spark, sf_dir, "lineitem", [s, "l_orderkey * 10 + l_linenumber"]), made).unionByName(others[0]).unionByName(others[1])
    q = runtime.materialize(q, "hub-quads")  # hubs are counted, taken and left out: three readings
    t = described("h.csv", [{"name": "n", "required": True, "datatype": "integer"}, {"name": "r", "required": True}, {"name": "t"}], aboutUrl=B + "h/{s}")
    return r2c.table_rows(q, table_of(t), hubs=1000, distinct=True)


@query("SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def r2c_constant_literal(spark, sf_dir):
    """A needed column with a constant: subjects without that literal leave before their values are collected."""
    cells = ["o_orderkey", "o_orderpriority", "o_orderstatus"]
    q = quads(rows(spark, sf_dir, "orders", cells), described("c.csv", [{"name": "k", "suppressOutput": True}, {"name": "o_orderpriority"}, {"name": "o_orderstatus"}], aboutUrl=B + "o/{k}"))
    t = described("c.csv", [{"name": "o_orderpriority"}, {"name": "o_orderstatus", "required": True, "valueUrl": "O"}], aboutUrl=B + "o/{k}")
    return r2c.table_rows(q, table_of(t)).withColumn("o_orderstatus", F.regexp_extract("o_orderstatus", "([^/]*)$", 1))


@query("SELECT r_name, coalesce(n_name, '') AS n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_regionkey = r_regionkey")
def r2c_key_root(spark, sf_dir):
    """The table begins at the star of its primary key, though another star's values point at it: regions without nations stay."""
    made = described("geo.csv", [{"name": "n", "suppressOutput": True}, {"name": "n_name"}, {"name": "region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}"}], aboutUrl=B + "nation/{n}")
    other = described("geo.csv", [{"name": "region", "suppressOutput": True}, {"name": "r_name"}], aboutUrl=B + "region/{region}")
    q = quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]).where("_c2 < 3"), made).unionByName(quads(rows(spark, sf_dir, "region", ["r_regionkey", "r_name"]), other))
    cols = [{"name": "n_name", "aboutUrl": B + "nation/{n}"}, {"name": "r_name", "aboutUrl": B + "region/{region}"},
            {"name": "link", "virtual": True, "propertyUrl": B + "inRegion", "valueUrl": B + "region/{region}", "aboutUrl": B + "nation/{n}"}]
    return r2c.table_rows(q, table_of(described("geo.csv", cols, primaryKey=["r_name"]))).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = CASE WHEN a.n_nationkey % 2 = 0 THEN 24 - a.n_nationkey ELSE (a.n_nationkey + 2) % 25 END WHERE a.n_nationkey % 2 = 0")
def r2c_cycle(spark, sf_dir):
    """Two stars that point at each other: the second link leads back to the first's subject."""
    key, other = "n_nationkey", "case when n_nationkey % 2 = 0 then 24 - n_nationkey else (n_nationkey + 2) % 25 end"
    made = lambda kind, to: described("c.csv", [{"name": "x", "suppressOutput": True}, {"name": kind}, {"name": "to", "propertyUrl": B + "to" + to, "valueUrl": B + to + "/{to}"}], aboutUrl=B + kind + "/{x}")
    own = lambda kind, to: quads(rows(spark, sf_dir, "nation", [key, "n_name", other]), made(kind, to))
    cols = [{"name": "a", "required": True, "aboutUrl": B + "a/{i}"}, {"name": "b", "required": True, "aboutUrl": B + "b/{j}"},
            {"name": "ab", "virtual": True, "required": True, "propertyUrl": B + "tob", "valueUrl": B + "b/{j}", "aboutUrl": B + "a/{i}"}, {"name": "ba", "virtual": True, "required": True, "propertyUrl": B + "toa", "valueUrl": B + "a/{i}", "aboutUrl": B + "b/{j}"}]
    return r2c.table_rows(own("a", "b").unionByName(own("b", "a")), table_of(described("c.csv", cols)))


@query(f"""SELECT '{B}o/' || o_orderkey AS subject, 'v' AS "column", 'P' || (o_orderkey % 40) || 'D' AS value, CASE WHEN o_orderkey % 40 > 20 THEN 'the value is left out: it does not meet the facets of duration' ELSE 'the value is shown as it is: it is no duration of the format' END AS message
FROM orders WHERE o_orderkey % 40 > 9""")
def r2c_issues(spark, sf_dir):
    """Durations outside their bounds are left out, those outside their format are shown as they are; both are reported."""
    q = quads(rows(spark, sf_dir, "orders", ["o_orderkey", "concat('P', o_orderkey % 40, 'D')"]), described("o.csv", [{"name": "k", "suppressOutput": True}, {"name": "v", "datatype": "duration"}], aboutUrl=B + "o/{k}"))
    t = table_of(described("o.csv", [{"name": "v", "datatype": {"base": "duration", "format": "^P[0-9]D$", "maxInclusive": "P20D"}}], aboutUrl=B + "o/{k}"))
    return r2c.extraction_issues(q, t).select("subject", "column", "value", "message")


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), w AS (SELECT n, o_orderkey::VARCHAR AS k, CASE n % 4 WHEN 0 THEN o_orderpriority || chr(10) || 'and "more", ' || o_orderstatus WHEN 1 THEN '' WHEN 2 THEN o_orderstatus ELSE chr(10) || chr(10) || 'x' END AS v FROM r)
SELECT 2 * n - 1 AS row, k, v, CASE WHEN n % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS cells FROM w UNION ALL SELECT 2 * n, '', '', 1 FROM w""")
def csv_quoted_breaks(spark, sf_dir):
    """Cells with line breaks, quotes and delimiters, blank lines, rows with a cell too many, in files of many splits."""
    old, tasks = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.maxPartitionNum", None)
    q = '"'
    v = F.expr(f"""case n % 4 when 0 then concat('{q}', o_orderpriority, '\n', 'and {q}{q}more{q}{q}, ', o_orderstatus, '{q}') when 1 then '' when 2 then o_orderstatus else '{q}\n\nx{q}' end""")
    own = tables.renumbered(runtime.table(spark, sf_dir, "orders").withColumn("_at", F.col("o_orderkey"))).withColumn("n", F.col("_at") + 1)
    lines = own.select("n", F.concat(F.concat_ws(",", F.col("o_orderkey").cast("string"), v), F.when(F.col("n") % 5 == 0, ",more").otherwise(""), F.lit("\n")).alias("value"))
    path = _lines(spark, lines.orderBy("n").select("value"), "breaks")  # parts in the order of their names
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.maxPartitionNum", "256")  # a task reads many splits where there are more
    try:
        df, t = tables.read_csv(spark, path, _plain(path, ["k", "v"]))
        out = df.select(F.col("_row").alias("row"), F.col("_c0").alias("k"), F.col("_c1").alias("v"), F.col("_cells").cast("bigint").alias("cells"))
        return runtime.materialize(out, "breaks-read")  # while the splits are small
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.maxPartitionNum", tasks) if tasks else spark.conf.unset("spark.sql.files.maxPartitionNum")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_shipdate::DATE::VARCHAR AS d FROM lineitem), a AS (SELECT DISTINCT k, n FROM l), b AS (SELECT DISTINCT k, d FROM l)
SELECT n::VARCHAR AS n, d FROM a JOIN b USING (k)""")
def r2c_multivalue_cross(spark, sf_dir):
    cols = [{"name": "n", "datatype": "integer", "required": True}, {"name": "d", "datatype": "date", "required": True}]
    made = described("l.csv", [{"name": "k", "suppressOutput": True}, *cols], aboutUrl=B + "o/{k}")
    q = quads(rows(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "to_date(l_shipdate)"]), made)
    return r2c.table_rows(q, table_of(described("l.csv", cols, aboutUrl=B + "o/{k}")), distinct=True)


@query("SELECT o_orderpriority, o_custkey::VARCHAR AS o_custkey FROM orders")
def r2c_named_graphs(spark, sf_dir):
    cols = [{"name": "o_orderpriority", "required": True}, {"name": "o_custkey", "datatype": "integer"}]
    made = described("orders.csv", [{"name": "k", "suppressOutput": True}, *cols], aboutUrl=B + "orders/{k}")
    parts = [quads(rows(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_custkey"]).where("_c0 % 2 = " + str(i)), made).withColumn("g", F.lit(f"{B}g{i}") if i else F.lit(None).cast("string")) for i in (0, 1)]
    return r2c.table_rows(parts[0].unionByName(parts[1]), table_of(described("orders.csv", cols, aboutUrl=B + "orders/{k}")))


def _filtered(spark, sf_dir, name: str, key: str, cells: list[str], column: dict[str, Any], plain: dict[str, Any]) -> DataFrame:
    made = described("t.csv", [{"name": "k", "suppressOutput": True}, {"name": "v", **plain}], aboutUrl=B + "t/{k}")
    q = quads(rows(spark, sf_dir, name, [key, *cells]), made)
    return r2c.table_rows(q, table_of(described("t.csv", [{"name": "v", "required": True, **column}], aboutUrl=B + "t/{k}")))


@query(f"SELECT {NUM.format('l_extendedprice')} AS v FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 50000")
def r2c_filter_number(spark, sf_dir):
    return _filtered(spark, sf_dir, "lineitem", "l_orderkey || '-' || l_linenumber", ["l_extendedprice"], {"datatype": {"base": "double", "minInclusive": "20000", "maxExclusive": "50000"}}, {"datatype": "double"})


@query("SELECT o_orderdate::DATE::VARCHAR AS v FROM orders WHERE o_orderdate::DATE > DATE '1996-06-30'")
def r2c_filter_date(spark, sf_dir):
    return _filtered(spark, sf_dir, "orders", "o_orderkey", ["to_date(o_orderdate)"], {"datatype": {"base": "date", "minExclusive": "1996-06-30"}}, {"datatype": "date"})


@query("SELECT p_name AS v FROM part WHERE regexp_matches(p_name, '^[a-m]') AND length(p_name) <= 20")
def r2c_filter_regex_length(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", ["p_name"], {"datatype": {"base": "string", "format": "^[a-m]", "maxLength": 20}}, {})


@query("SELECT source AS v FROM documents WHERE lang = 'de'")
def r2c_filter_lang(spark, sf_dir):
    parts = None
    for lang in ("en", "de", "fr", "es"):
        made = described("t.csv", [{"name": "k", "suppressOutput": True}, {"name": "v", "lang": lang}], aboutUrl=B + "t/{k}")
        own = quads(rows(spark, sf_dir, "documents", ["doc_id", "source", "lang"]).where(F.col("_c2") == lang), made)
        parts = own if parts is None else parts.unionByName(own)
    return r2c.table_rows(parts, table_of(described("t.csv", [{"name": "v", "lang": "de", "required": True}], aboutUrl=B + "t/{k}")))


@query("SELECT s_suppkey::VARCHAR AS k, s_name AS v FROM supplier")
def r2c_filter_template(spark, sf_dir):
    q = quads(rows(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]), described("t.csv", [{"name": "k", "suppressOutput": True}, {"name": "v"}, {"name": "self", "virtual": True, "propertyUrl": B + "self", "valueUrl": B + "a/{k}"}], aboutUrl=B + "a/{k}"))
    q = q.unionByName(quads(rows(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]), described("t.csv", [{"name": "k", "suppressOutput": True}, {"name": "v"}], aboutUrl=B + "b/{k}")))
    return r2c.table_rows(q, table_of(described("t.csv", [{"name": "k", "propertyUrl": B + "self", "valueUrl": B + "a/{k}"}, {"name": "v", "required": True}], aboutUrl=B + "a/{k}")))


@query("SELECT 'PT' || (event_id % 100)::VARCHAR || 'M' AS v FROM events WHERE event_id % 100 >= 30")
def r2c_duration_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, "events", "event_id", ["concat('PT', event_id % 100, 'M')"], {"datatype": {"base": "duration", "minInclusive": "PT30M"}}, {"datatype": "duration"})


@query("SELECT printf('%.1f', round(p_size * 1.0, 1)) AS v FROM part")
def r2c_format_number(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", ["p_size"], {"datatype": {"base": "double", "format": "#,##0.0"}}, {"datatype": "double"})


@query("SELECT strftime(o_orderdate, '%d/%m/%Y') AS v FROM orders")
def r2c_format_date(spark, sf_dir):
    return _filtered(spark, sf_dir, "orders", "o_orderkey", ["to_date(o_orderdate)"], {"datatype": {"base": "date", "format": "dd/MM/yyyy"}}, {"datatype": "date"})


@query("SELECT CASE quality WHEN 1 THEN 'Y' ELSE 'N' END AS v FROM labels")
def r2c_format_boolean(spark, sf_dir):
    return _filtered(spark, sf_dir, "labels", "doc_id", ["quality"], {"datatype": {"base": "boolean", "format": "Y|N"}}, {"datatype": "boolean"})


CUSTOMER_COLUMNS = [{"name": "c_custkey", "propertyUrl": B + "key", "valueUrl": B + "customer/{c_custkey}", "required": True}, {"name": "c_name", "required": True}, {"name": "c_nationkey", "datatype": "integer"}, {"name": "c_acctbal", "datatype": "double"}, {"name": "c_mktsegment"}]
CUSTOMER = described("customer.csv", CUSTOMER_COLUMNS, aboutUrl=B + "customer/{c_custkey}", primaryKey="c_custkey")


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, {NUM.format('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer")
def r2c_roundtrip_customer(spark, sf_dir):
    q = quads(rows(spark, sf_dir, "customer", [c["name"] for c in CUSTOMER_COLUMNS]), CUSTOMER)
    return r2c.table_rows(q, table_of(CUSTOMER))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r2c_roundtrip_customer(spark, sf_dir)


def _typed(name: str, key: str, cls: str, columns: list[dict[str, Any]]) -> dict[str, Any]:
    return described(f"{name}.csv", [{"name": "k", "suppressOutput": True}, *columns, {"name": "cls", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": B + cls}], aboutUrl=B + name + "/{k}")


def typed_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), _typed("nation", "n_nationkey", "Nation", [{"name": "n_name"}, {"name": "n_region", "propertyUrl": B + "inRegion", "valueUrl": B + "region/{n_region}"}]))
    b = quads(rows(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal"]), _typed("supplier", "s_suppkey", "Supplier", [{"name": "s_name"}, {"name": "s_acctbal", "datatype": "double"}]))
    c = quads(rows(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"]), _typed("part", "p_partkey", "Part", [{"name": "p_name", "separator": " "}, {"name": "p_size", "datatype": "integer"}]))
    return a.unionByName(b).unionByName(c)


@query(f"SELECT '{B}Nation' AS class, count(*) AS n FROM nation UNION ALL SELECT '{B}Supplier', count(*) FROM supplier UNION ALL SELECT '{B}Part', count(*) FROM part")
def infer_classes(spark, sf_dir):
    return infer.classes(typed_quads(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""SELECT * FROM (VALUES ('{B}Nation', '{B}nation.csv#n_name', false), ('{B}Nation', '{B}inRegion', false), ('{B}Supplier', '{B}supplier.csv#s_name', false), ('{B}Supplier', '{B}supplier.csv#s_acctbal', false),
('{B}Part', '{B}part.csv#p_size', false)) v(class, p, multi) UNION ALL SELECT '{B}Part', '{B}part.csv#p_name', bool_or(len(list_distinct(string_split(p_name, ' '))) > 1) FROM part""")
def infer_columns(spark, sf_dir):
    return infer.columns(typed_quads(spark, sf_dir)).select("class", "p", "multi")


@query(f"SELECT '{B}part.csv#p_name' AS p FROM part WHERE len(list_distinct(string_split(p_name, ' '))) > 1 LIMIT 1")
def infer_multivalue(spark, sf_dir):
    return infer.columns(typed_quads(spark, sf_dir)).where("multi").select("p")


@query(f"SELECT '{B}Nation' AS class, '{B}nation/{{subject_id}}' AS template UNION ALL SELECT '{B}Supplier', '{B}supplier/{{subject_id}}' UNION ALL SELECT '{B}Part', '{B}part/{{subject_id}}'")
def infer_template(spark, sf_dir):
    found = infer.infer(typed_quads(spark, sf_dir))
    keys = [t["tableSchema"]["columns"][0] for t in found["tables"] if not t["tableSchema"]["foreignKeys"]]
    return spark.createDataFrame([(k["valueUrl"], k["aboutUrl"]) for k in keys], "class string, template string")


@query("SELECT 'decimal' AS datatype")
def infer_datatype_lca(spark, sf_dir):
    made = lambda dt: _typed("part", "p_partkey", "Part", [{"name": "v", "datatype": dt}])
    q = quads(rows(spark, sf_dir, "part", ["p_partkey", "p_size"]), made("integer")).unionByName(quads(rows(spark, sf_dir, "part", ["p_partkey + 1000000", "p_retailprice"]), made("decimal")))
    table = infer.infer(q)["tables"][0]["tableSchema"]["columns"]
    return spark.createDataFrame([(c["datatype"],) for c in table[1:]], "datatype string")


@query(f"SELECT '{B}nation/' || n_nationkey AS iri, n_name AS label FROM nation")
def infer_label(spark, sf_dir):
    made = lambda lang: described("v.csv", [{"name": "k", "suppressOutput": True}, {"name": "l", "propertyUrl": "rdfs:label", "lang": lang}], aboutUrl=B + "nation/{k}")
    q = quads(rows(spark, sf_dir, "nation", ["n_nationkey", "n_name"]), made("en")).unionByName(quads(rows(spark, sf_dir, "nation", ["n_nationkey", "upper(concat('de ', n_name))"]), made("de")))
    return infer.labels(q)


@query(f"SELECT '{B}nation/' AS namespace, NULL::VARCHAR AS prefix UNION ALL SELECT '{B}nation.csv#', NULL")
def prefix_candidates(spark, sf_dir):
    return serialize.prefix_candidates(nation_quads(spark, sf_dir))


@query("SELECT 'warning' AS type, count(*) AS n FROM customer")
def issues_counts(spark, sf_dir):
    t = described("customer.csv", [{"name": "c_custkey", "datatype": "integer"}, {"name": "c_mktsegment", "datatype": "integer"}])
    return counts(c2r.cell_issues(rows(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"], "c_custkey"), table_of(t)))


@query("SELECT o_orderkey AS row, 'a required cell is empty' AS message FROM orders WHERE o_orderstatus = 'F'")
def issues_required(spark, sf_dir):
    t = described("orders.csv", [{"name": "o_orderstatus", "null": "F", "required": True}])
    return c2r.cell_issues(rows(spark, sf_dir, "orders", ["o_orderstatus"], "o_orderkey"), table_of(t)).select("row", "message")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group(described("lineitem.csv", [{"name": "k", "datatype": "integer"}], foreignKeys=[{"columnReference": "k", "reference": {"resource": "orders.csv", "columnReference": "o"}}]),
              described("orders.csv", [{"name": "o", "datatype": "integer"}, {"name": "c"}], primaryKey="c"))
    frames = {B + "lineitem.csv": rows(spark, sf_dir, "lineitem", ["l_orderkey"], "l_orderkey"), B + "orders.csv": rows(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], "o_orderkey").where("_c0 % 3 > 0")}
    return c2r.key_issues({t.url: (frames[t.url], t) for t in g.tables})


@query("SELECT l_orderkey AS row FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0)")
def fk_check(spark, sf_dir):
    return _keyed(spark, sf_dir).where(F.col("message").startswith("a foreign")).select("row")


@query("SELECT min(o_orderkey) AS row FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey HAVING count(*) > 1")
def pk_check(spark, sf_dir):
    return _keyed(spark, sf_dir).where(F.col("message").startswith("a primary")).select("row")


@query(f"SELECT DISTINCT * FROM ({NATION_SQL})")
def dedup_quads(spark, sf_dir):
    q = nation_quads(spark, sf_dir)
    return rdf.as_set(q.unionByName(q)).select(*SHOWN)


@query("SELECT event_id AS n, CASE WHEN event_id < 100 THEN 0 ELSE (event_id - 90) // 10 END AS added_at, event_id // 10 AS last_at FROM events")
def window_ring(spark, sf_dir):
    return windows.window_events(runtime.table(spark, sf_dir, "events").select(F.col("event_id").alias("n")), 100)


@query(_cell("events", "event_id", "events.csv", "event_type", "event_type"))
def stream_c2r(spark, sf_dir):
    t = table_of(described("events.csv", [{"name": "event_id", "suppressOutput": True}, {"name": "event_type"}], aboutUrl=B + "events/{event_id}"))
    schema = runtime.table(spark, sf_dir, "events").schema
    # the file source reads folders; the pattern picks the one table
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cells = stream.select(F.col("event_id").cast("string").alias("_c0"), F.col("event_type").alias("_c1"), F.col("event_id").alias("_row"))
    return windows.materialised(windows.stream_quads(cells, t), "stream").select(*SHOWN)


from quadloom import feature_queries, stream_queries  # noqa: E402, F401  (add their queries)
