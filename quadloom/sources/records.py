"""CSV records whose quoted cells hold line breaks, from files that stay split among tasks.

A file's split (a chunk) can begin inside a quoted cell. What a line does to that is a function of two states: where it
leaves the reader that begins it outside a quoted cell, and one that begins it inside; regular expressions give both for
each line. A first pass composes the functions of a chunk's lines; composing the chunks of a file in their order (a row
for each chunk) says in which state each begins, and how many records lie before it. The second pass cuts each chunk into
records. Of a record that runs over a chunk's end the rest stands at the next chunk's head; these heads, at most one a
chunk, are joined to their records. Records are numbered by file and place, so that neither sort nor one task is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime
from quadloom.plans.descriptor import Dialect

#: Records in one batch that a task hands on.
BATCH = 4096


def quoted(dialect: Dialect) -> tuple[str, str]:
    """What follows an opening quote inside a cell, and a whole quoted cell, as possessive patterns without alternatives in a loop."""
    q = re.escape(dialect.quote_char)
    inner = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+" if dialect.double_quote else f"[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+"
    return inner, f"{q}{inner}{q}"


def _opening(dialect: Dialect) -> str:
    """Where a quote opens a cell: at a line's or cell's begin, behind white space that the dialect drops."""
    space = r"\s*+" if dialect.skip_initial_space or dialect.trim in ("true", "start") else ""
    return f"(^|{re.escape(dialect.delimiter)}){space}"


def without_quoted(text: C, dialect: Dialect) -> C:
    """The text without its whole quoted cells; a quote inside another cell is a character like others."""
    return F.regexp_replace(text, f"(?s){_opening(dialect)}{quoted(dialect)[1]}", "$1")


def line_states(line: C, dialect: Dialect) -> tuple[C, C, C]:
    """Whether the line, begun outside or inside a quoted cell, ends inside one; and whether one begun inside leaves it."""
    q = re.escape(dialect.quote_char)
    inner, opening = quoted(dialect)[0], _opening(dialect)
    open_after = lambda text: without_quoted(text, dialect).rlike(f"(?s){opening}{q}")
    outside = open_after(line)
    if dialect.comment_prefix:
        outside = outside & ~line.startswith(dialect.comment_prefix)
    leaves = line.rlike(f"(?s)^{inner}{q}")
    inside = ~leaves | open_after(F.regexp_replace(line, f"(?s)^{inner}{q}", ""))
    return outside, inside, leaves


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: the end states from both begins, and the records that begin in it (from inside: none may)."""
    rows: list[tuple] = []
    chunk, out, ins, n_out, n_ins = None, 0, 1, 0, 0
    for batch in batches:
        for file, start, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, start) != chunk:
                if chunk:
                    rows.append((*chunk, out, ins, n_out, n_ins))
                chunk, out, ins, n_out, n_ins = (file, start), 0, 1, 0, 0
            n_out += not out
            n_ins += not ins
            out, ins = b if out else a, b if ins else a
    if chunk:
        rows.append((*chunk, out, ins, n_out, n_ins))
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "out", "ins", "n_out", "n_ins"), (f, s, int(o), int(i), n, m), strict=True)) for f, s, o, i, n, m in rows],
                                         pa.schema([("file", pa.string()), ("start", pa.int64()), ("out", pa.int32()), ("ins", pa.int32()), ("n_out", pa.int64()), ("n_ins", pa.int64())]))


def _records(inside: dict[str, frozenset], sep: str):
    """Cuts chunks into records: file, start, k (place in the chunk; -1: the head, the rest of a record before), text."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        chunk, state, k, parts = None, False, 0, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for file, start, a, b, line in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (file, start) != chunk:
                    if chunk:
                        done.append((*chunk, k, sep.join(parts)))
                    chunk, parts = (file, start), [line]
                    state = start in inside.get(file, ())
                    k = -1 if state else 0
                elif state:
                    parts.append(line)
                else:
                    done.append((*chunk, k, sep.join(parts)))
                    k, parts = k + 1, [line]
                    if len(done) >= BATCH:
                        yield flush()
                state = b if state else a
        if chunk:
            done.append((*chunk, k, sep.join(parts)))
        if done:
            yield flush()

    return run


def _chunks(rows: DataFrame) -> DataFrame:
    """Adds to the summaries of a file's chunks, by composing them in their order: whether a chunk begins inside a cell, the
    number of records that begin before it in the table, and the chunk whose record its head continues."""
    # a split keeps the state (out 0, ins 1), turns it (1, 0) or sets it: what counts is the last one that sets it, and how many
    # turn it from there on. A file's chunks are as many as its splits.
    at = Window.partitionBy("file").orderBy("start")
    now, past = at.rowsBetween(Window.unboundedPreceding, Window.currentRow), at.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("turns", F.sum(((F.col("out") == 1) & (F.col("ins") == 0)).cast("bigint")).over(now))
    own = own.withColumn("set", F.last(F.when(F.col("out") == F.col("ins"), F.struct("out", "turns")), ignorenulls=True).over(now))
    own = own.withColumn("end", ((F.coalesce(F.col("set.out"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("set.turns"), F.lit(0))) % 2).cast("int"))
    own = own.withColumn("inside", F.coalesce(F.lag("end").over(at), F.lit(0)))
    own = own.withColumn("n", F.when(F.col("inside") == 1, F.col("n_ins")).otherwise(F.col("n_out")))
    opener = F.last(F.when(F.col("n") > 0, F.col("start")), ignorenulls=True).over(past)
    own = own.select("file", "start", "inside", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"), F.when(F.col("inside") == 1, opener).alias("owner"), "n")
    own = runtime.materialize(own, "composed")
    files = own.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", (F.sum("n").over(runtime.running_window("file")) - F.col("n")).alias("first"))
    return own.join(files, "file").select("file", "start", "inside", (F.col("before") + F.col("first")).alias("before"), "owner")


def whole_records(spark: SparkSession, path: str, dialect: Dialect, decode: C | None = None, sep: str = "\n") -> DataFrame:
    """value and _at, its place among all records from 0, for records that may run over several lines."""
    lines = spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), (decode if decode is not None else F.col("value")).alias("value"))
    runtime.ship(spark)
    outside, inside, _ = line_states(F.col("value"), dialect)
    states = lines.select("file", "start", outside.alias("a"), inside.alias("b"), "value")
    summaries = states.drop("value").mapInArrow(_summaries, "file string, start bigint, out int, ins int, n_out bigint, n_ins bigint")
    chunks = runtime.materialize(_chunks(summaries), "chunks")
    # some of the chunks' borders, numbers by file
    begun_inside = {r.file: frozenset(r.starts) for r in chunks.where("inside = 1").groupBy("file").agg(F.collect_list("start").alias("starts")).collect()}
    found = states.mapInArrow(_records(begun_inside, sep), "file string, start bigint, k bigint, text string")
    if not begun_inside:
        records = found
    else:
        heads = found.where("k < 0").join(chunks.select("file", "start", "owner"), ["file", "start"]).where("owner is not null")
        rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), sep).alias("rest")
        heads = runtime.materialize(heads.groupBy("file", F.col("owner").alias("start")).agg(rest), "heads").withColumn("last", F.lit(True))
        lasts = found.where("k >= 0").groupBy("file", "start").agg(F.max("k").alias("k")).join(heads, ["file", "start"])
        lasts = runtime.materialize(lasts, "open-records")  # as many as heads: small ones are broadcast
        records = found.where("k >= 0").join(lasts, ["file", "start", "k"], "left").withColumn("text", F.when(F.col("last"), F.concat_ws(sep, "text", "rest")).otherwise(F.col("text")))
    # a chunk that begins inside a cell counts its records from behind the head
    return records.join(chunks.select("file", "start", "before"), ["file", "start"]).select(F.col("text").alias("value"), (F.col("before") + F.col("k")).alias("_at"))
