"""Conversions as functions of a session, a place and options; the command line is made of them."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import templates
from quadloom.issues import Issues
from quadloom.operators import c2r, infer, r2c
from quadloom.plans.descriptor import Loader, Table, TableGroup
from quadloom.sources import resolve, tables
from quadloom.streaming import extract

#: Log levels: what is handed to ``log``.
ERROR, WARN, DEBUG = 0, 1, 2


@dataclass(frozen=True)
class ConversionOptions:
    """``base_iri``: what relative places and IRIs begin with. ``path_overrides``: (start or ^pattern, replacement) of places.
    ``log``, ``log_level``: who takes messages, from which level on. ``minimal``: no rows and tables in the quads.
    ``template_iris``: IRIs from templates are made readable. ``descriptor``: a descriptor, its text or its place.
    ``use_vocab_metadata``: names of inferred tables come from labels, of ``vocabulary`` too, or else of the documents that
    ``resolve`` gives for the namespaces of predicates and classes. ``window_size``: tables are made
    of each window of so many quads (quads need a number n). ``resolve``: reads a text by its place; texts are kept.
    ``well_known``: the text of a site's list of metadata places, else /.well-known/csvm is read. ``link``: a table's link header."""

    base_iri: str = ""
    path_overrides: tuple[tuple[str, str], ...] = ()
    log_level: int = WARN
    log: Callable[[int, str], None] = lambda level, text: None
    minimal: bool = False
    template_iris: bool = True
    descriptor: Any = None
    use_vocab_metadata: bool = True
    vocabulary: DataFrame | None = None
    window_size: int | None = None
    resolve: Callable[[str], str] | None = None
    well_known: str | None = None
    link: str | None = None

    def reader(self) -> Callable[[str], str]:
        cache = resolve.Cache(self.resolve or (lambda u: resolve.read_text(u, list(self.path_overrides))))
        return cache.__getitem__

    def say(self, level: int, text: str) -> None:
        if level <= self.log_level:
            self.log(level, text)

    def report(self, issues: Issues) -> None:
        for kind, message, table, _, column in issues.items:
            self.say(WARN if kind == "warning" else ERROR, " ".join(x for x in (table, column and f"column {column}", message) if x))


def load_group(source: str | None, options: ConversionOptions, issues: Issues) -> TableGroup:
    """The options' descriptor; else that at ``source``, or the metadata found for the table there, or an empty one."""
    read = options.reader()
    own = options.descriptor
    if isinstance(own, str) and not own.lstrip().startswith("{"):
        return Loader(own, read, issues).load(read(own))
    if own is not None:
        return Loader(options.base_iri, read, issues).load(own)
    if source is None:
        raise ValueError("neither a descriptor nor a table")
    if source.endswith(".json"):
        return Loader(source, read, issues).load(read(source))
    link = resolve.link_metadata(options.link) if options.link else None
    well_known = options.well_known
    if well_known is None and templates.is_absolute(source):  # the site's own list
        with contextlib.suppress(OSError, KeyError, ValueError):
            well_known = read(urljoin(source, "/.well-known/csvm"))
    found = resolve.discover(source, read, well_known, link, issues)
    return Loader(found[0], read, issues).load(found[1]) if found else TableGroup((Table(url=source, has_schema=False),))


def _table_reader(spark: SparkSession, options: ConversionOptions, issues: Issues) -> Callable[[Table], tuple[DataFrame, Table]]:
    return lambda t: tables.read_csv(spark, resolve.override(re.sub(r"[?#].*$", "", t.url), list(options.path_overrides)), t, issues)


def to_quads(spark: SparkSession, source: str | None, options: ConversionOptions = ConversionOptions(), issues: Issues | None = None) -> DataFrame:
    """The quads of the tables at ``source`` (a table or a descriptor)."""
    issues = issues or Issues()
    group = load_group(source, options, issues)
    out = c2r.convert(spark, group, _table_reader(spark, options, issues), c2r.Options(minimal=options.minimal, pretty_iris=options.template_iris))
    options.report(issues)
    return out


def validate(spark: SparkSession, source: str | None, options: ConversionOptions = ConversionOptions(), issues: Issues | None = None) -> DataFrame:
    """Issues of the metadata and of all cells."""
    issues = issues or Issues(throw=False)
    group = load_group(source, options, issues)
    return c2r.validate(spark, group, _table_reader(spark, options, issues), issues)


def infer_descriptor(quads: DataFrame, options: ConversionOptions = ConversionOptions()) -> dict[str, Any]:
    """A descriptor of the quads' tables."""
    if options.use_vocab_metadata:
        known = options.vocabulary
        if known is None and options.resolve:
            known = infer.fetch_vocabularies(quads, options.reader())
        return infer.infer(quads, known)
    rows = infer.summary(infer.observations(quads)).withColumn("level", F.col("smin") == F.col("smax"))
    return infer.describe(rows.collect())  # a row per class and predicate


def to_tables(quads: DataFrame, options: ConversionOptions = ConversionOptions(), issues: Issues | None = None) -> tuple[dict[str, DataFrame], dict[str, Table], dict[str, Any] | None]:
    """Table URL -> rows, and -> table; and the descriptor, if it was inferred. With a window size the rows have their window."""
    issues = issues or Issues()
    made = None
    if options.descriptor is None:
        made = infer_descriptor(quads, options)
        options.say(DEBUG, json.dumps(made))
        group = Loader(options.base_iri, options.reader(), issues).load(made)
    else:
        group = load_group(None, options, issues)
    if options.window_size:
        found = extract.window_rows(quads, group, options.window_size)
        r2c.tables_with_rows(group, issues)
    else:
        found = r2c.convert(quads, group, issues, distinct=True)
    options.report(issues)
    return found, {t.url: t for t in group.tables}, made


def table_header(table: Table, lang: str = "und") -> tuple[str, list[str]]:
    """A table's name (its URL without query and fragment) and the titles of its columns."""
    return re.sub(r"[?#].*$", "", table.url), r2c.output_names(table, lang)
