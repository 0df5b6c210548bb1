"""Annotated tables as DataFrames: CSV in any dialect or any DataFrame -> text columns _c0.. with a row number _row."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime
from quadloom.issues import Issues
from quadloom.plans.descriptor import ENCODINGS, Column, Dialect, Table, name_columns
from quadloom.sources import records

LINE_ENDS = {"\n", "\r\n", "\r"}


def number_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """1, 2, ... in partition order, without a global sort: rows per partition are counted, their sums are the offsets.
    The offsets, a row for each partition, are joined; Spark broadcasts them only while they are small."""
    spark = df.sparkSession
    own = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33))
    sizes = own.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_part"], at))
        at += r.n
    if len(starts) < 2:  # the usual small table needs no join
        return own.withColumn(name, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_mid", "_part")
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    return own.join(offsets, "_part").withColumn(name, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start") + 1).drop("_mid", "_part", "_start")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def _cell_count(line: C, dialect: Dialect) -> C:
    if dialect.quote_char:
        line = records.without_quoted(line, dialect)
    return F.size(F.split(line, _literal(dialect.delimiter), -1))


def _separator(dialect: Dialect) -> tuple[str | None, list[str]]:
    """The line end that Spark's reader is given (None: its own ones), and other ones to split at."""
    own = [x for x in dialect.line_terminators if x not in LINE_ENDS]
    return (own[0], [*own[1:], *(x for x in dialect.line_terminators if x in LINE_ENDS)]) if own else (None, [])


def _text(dialect: Dialect) -> C:
    """A line's text: the reader takes bytes, in which line ends of these encodings are what they are in ASCII."""
    encoding = ENCODINGS.get(dialect.encoding, "UTF-8")
    return F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)


def _lines(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """A file's lines, without comments (and blank ones where the dialect skips them)."""
    end, others = _separator(dialect)
    lines = (spark.read.option("lineSep", end) if end else spark.read).text(path).select(_text(dialect).alias("value"))
    if others:
        lines = lines.select(F.explode(F.split("value", "|".join(map(_literal, sorted(others, key=len, reverse=True))), -1)).alias("value"))
    return _kept(lines, dialect)


def _kept(lines: DataFrame, dialect: Dialect) -> DataFrame:
    if dialect.comment_prefix:
        lines = lines.where(~F.col("value").startswith(dialect.comment_prefix))
    return lines.where(F.trim("value") != "") if dialect.skip_blank_rows else lines


def _options(dialect: Dialect) -> dict[str, str | bool]:
    return {"sep": dialect.delimiter, "quote": dialect.quote_char or "\u0000", "escape": '"' if dialect.double_quote else "\\", "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": dialect.trim in ("true", "start") or dialect.skip_initial_space, "ignoreTrailingWhiteSpace": dialect.trim in ("true", "end")}


def scan_csv(spark: SparkSession, path: str, dialect: Dialect = Dialect(), width: int | None = None, multiline: bool | None = None) -> DataFrame:
    """All records as text: _c0.., _cells (how many the record has) and _line, the record's number in the file. Missing
    and empty cells are ''; blank lines are records of one empty cell unless the dialect skips them.

    Files are split among tasks and read line by line. Where a quoted cell holds a line break (``multiline``; None: found by
    one pass over the lines) records are put together by sources.records, still from splits. Only files of two-byte encodings
    are read as a whole: their line ends are no single bytes."""
    if ENCODINGS.get(dialect.encoding, "UTF-8").startswith("UTF-16"):
        return _scan_whole(spark, path, dialect, width)
    if multiline is None:
        multiline = bool(dialect.quote_char) and not _lines(spark, path, dialect).where(records.line_states(F.col("value"), dialect)[0]).isEmpty()
    if multiline:
        end, others = _separator(dialect)
        found = records.whole_records(spark, path, dialect, _text(dialect), end or "\n")
        # the reader splits at \n; the rest of \r\n stands at the record's end
        text = F.regexp_replace("value", "\r$", "") if end is None else F.col("value")
        lines = _kept(found.withColumn("value", text), dialect)
        if dialect.comment_prefix or dialect.skip_blank_rows:  # places that records left out have not
            lines = renumbered(lines)
        numbered = lines.withColumn("_line", F.col("_at") + 1).drop("_at").withColumn("_cells", _cell_count(F.col("value"), dialect))
        lines = numbered
    else:
        lines = _lines(spark, path, dialect).withColumn("_cells", _cell_count(F.col("value"), dialect))
        numbered = number_rows(lines, "_line")
    numbered = numbered.where(F.col("_line") > dialect.skip_rows).withColumn("_line", F.col("_line") - dialect.skip_rows)
    if width is None:
        first = (numbered.where("_line <= 20").orderBy("_line").collect() if multiline else lines.limit(dialect.skip_rows + 20).collect()[dialect.skip_rows :])
        width = next((r["_cells"] for r in first if r.value.strip()), 1)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    cells = numbered.withColumn("cells", F.from_csv("value", schema, {k: str(v).lower() if isinstance(v, bool) else v for k, v in _options(dialect).items()}))
    skip = dialect.skip_columns
    return cells.select(*[F.coalesce(F.col(f"cells._c{i + skip}"), F.lit("")).alias(f"_c{i}") for i in range(width - skip)], (F.col("_cells") - skip).alias("_cells"), "_line")


def renumbered(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """_at without gaps: the rows of each block of places are counted; their sums are a row for each block."""
    own = lines.withColumn("_block", F.expr(f"_at div {block}"))
    sizes = own.groupBy("_block").agg(F.count("*").alias("n"))
    starts = sizes.select("_block", (F.sum("n").over(runtime.running_window("_block")) - F.col("n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_at")) - 1
    return own.withColumn("_at", inside).join(starts, "_block").withColumn("_at", F.col("_at") + F.col("_start")).drop("_block", "_start")


def _scan_whole(spark: SparkSession, path: str, dialect: Dialect, width: int | None) -> DataFrame:
    """Each file in one task, for encodings whose line ends are no single bytes; its reader drops blank lines and gives no
    number of cells."""
    opts = _options(dialect) | {"encoding": ENCODINGS[dialect.encoding], "multiLine": True, "header": False, "inferSchema": False}
    if dialect.comment_prefix:
        if len(dialect.comment_prefix) > 1:
            raise ValueError("in a two-byte encoding, a comment prefix has one character")
        opts["comment"] = dialect.comment_prefix
    if set(dialect.line_terminators) - LINE_ENDS:
        opts["lineSep"] = next(x for x in dialect.line_terminators if x not in LINE_ENDS)
    reader = spark.read.options(**opts)
    if width is None:  # lines before the header can be shorter
        head = reader.schema(", ".join(f"_c{i} string" for i in range(200))).csv(path).limit(dialect.skip_rows + 1).collect() if dialect.skip_rows else []
        width = max(1, max((i + 1 for i, v in enumerate(head[-1]) if v is not None), default=1)) if head else len(reader.csv(path).columns)
    df = reader.schema(", ".join(f"_c{i} string" for i in range(width))).csv(path)
    df = number_rows(df, "_line").where(F.col("_line") > dialect.skip_rows).withColumn("_line", F.col("_line") - dialect.skip_rows)
    skip = dialect.skip_columns
    return df.select(*[F.coalesce(f"_c{i + skip}", F.lit("")).alias(f"_c{i}") for i in range(width - skip)], F.lit(width - skip).alias("_cells"), "_line")


def read_csv(spark: SparkSession, path: str, table: Table, issues: Issues | None = None, lang: str = "und") -> tuple[DataFrame, Table]:
    """A table's body with _row, and the table with the columns that the header adds or names."""
    issues = issues or Issues()
    df = scan_csv(spark, path, table.dialect)
    width = len([c for c in df.columns if re.fullmatch(r"_c\d+", c)])
    head_rows = table.dialect.header_rows
    header = [[r[i] for i in range(width)] for r in df.where(F.col("_line") <= head_rows).orderBy("_line").limit(head_rows).collect()] if head_rows else []
    with issues.at(table=table.url):
        table = apply_header(table, header, width, issues, lang)
    body = df.where(F.col("_line") > head_rows).withColumn("_row", F.col("_line") - head_rows).drop("_line")
    return body, table


def apply_header(table: Table, header: list[list[str]], width: int, issues: Issues, lang: str = "und") -> Table:
    """Titles from the header; columns by number where there is neither header nor schema."""
    physical = [c for c in table.columns if not c.virtual]
    virtual = [c for c in table.columns if c.virtual]
    if table.columns and len(physical) != width:
        issues.warn(f"the schema has {len(physical)} columns, the table {width}")
    own_lang = table.defaults.lang if table.defaults.lang != "und" else lang
    out = []
    for i in range(max(width, len(physical))):
        c = physical[i] if i < len(physical) else replace(table.defaults, name=None)
        texts = [row[i] for row in header if i < len(row) and row[i] != ""]
        titles = {k: list(v) for k, v in c.titles.items()}
        if texts:
            known = [t for v in titles.values() for t in v]
            if known and texts[0] not in known:
                issues.warn(f"the header {texts[0]} is none of the titles of column {i + 1}")
            for t in texts:
                if t not in known:
                    titles.setdefault(own_lang, []).append(t)
        out.append(replace(c, titles=titles))
    out = out[: max(width, len(physical))]
    names = name_columns([*out, *virtual], own_lang)
    if len(set(names)) < len(names):
        issues.error("two columns have one name")
    return replace(table, columns=tuple(replace(c, name=n) for c, n in zip([*out, *virtual], names, strict=True)))


def from_frame(df: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """A DataFrame's columns as text with _row: in the order of ``order`` if given, else in partition order."""
    if order:
        rows = number_rows(df.orderBy(*order))  # a range-partitioned sort; all its partitions are in order
    else:
        rows = number_rows(df)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_c{i}") for i, c in enumerate(columns)], "_row")


def write_csv(df: DataFrame, path: str, dialect: Dialect = Dialect(), mode: str = "errorifexists") -> None:
    """The table's own dialect decides header, delimiter, quoting and line ends."""
    opts = {"sep": dialect.delimiter, "quote": dialect.quote_char or "\u0000", "escape": '"' if dialect.double_quote else "\\", "header": dialect.header, "emptyValue": "", "nullValue": ""}
    if dialect.line_terminators and len(dialect.line_terminators[0]) == 1:
        opts["lineSep"] = dialect.line_terminators[0]
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode(mode).options(**opts).csv(path)


__all__ = ["Column", "apply_header", "from_frame", "number_rows", "read_csv", "scan_csv", "write_csv"]
