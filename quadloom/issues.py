"""Validation issues: collected on the driver for metadata, as a DataFrame for cells."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "type string, message string, table string, row bigint, column string"


class ValidationError(ValueError):
    """An error in the metadata, or in data where errors stop."""


@dataclass
class Issues:
    """Errors throw unless ``throw`` is off; warnings are kept. The location is what the enclosing at() blocks say."""

    throw: bool = True
    items: list[tuple[str, str, str | None, int | None, str | None]] = field(default_factory=list)
    _table: str | None = None
    _row: int | None = None
    _column: str | None = None

    @contextmanager
    def at(self, table: str | None = None, row: int | None = None, column: str | None = None):
        before = self._table, self._row, self._column
        self._table = table if table is not None else self._table
        self._row = row if row is not None else self._row if table is None else None
        self._column = column if column is not None else self._column if table is None else None
        try:
            yield self
        finally:
            self._table, self._row, self._column = before

    def warn(self, message: str) -> None:
        self.items.append(("warning", message, self._table, self._row, self._column))

    def error(self, message: str) -> None:
        self.items.append(("error", message, self._table, self._row, self._column))
        if self.throw:
            raise ValidationError(message)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.items, ISSUE)


def counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n"))


def as_quads(issues: DataFrame) -> DataFrame:
    """Each issue as a blank node with its type, description and location."""
    from quadloom.functions.terms import RDF, XSD

    ns = "urn:quadloom:issue#"
    node = F.concat(F.lit("_:issue"), F.abs(F.xxhash64("type", "message", "table", "row", "column")).cast("string"))

    def quad(p: str, value, dt: str | None) -> object:
        return F.struct(F.lit("bnode").alias("s_kind"), node.alias("s"), F.lit(p).alias("p"), F.lit("literal" if dt else "iri").alias("o_kind"), value.cast("string").alias("o"),
                        F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("g"))

    rows = F.array(quad(RDF + "type", F.concat(F.lit(ns), F.initcap("type")), None), quad(ns + "description", F.col("message"), XSD + "string"), quad(ns + "table", F.col("table"), XSD + "string"),
                   quad(ns + "row", F.col("row"), XSD + "integer"), quad(ns + "column", F.col("column"), XSD + "string"))
    return issues.select(F.inline(F.filter(rows, lambda q: q["o"].isNotNull())))
