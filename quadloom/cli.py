"""spark-submit entry: csvw2rdf (c2r), rdf2csvw (r2c), validate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quadloom import api
from quadloom.issues import Issues, ValidationError, counts
from quadloom.operators import serialize
from quadloom.sources import rdf, resolve, tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadloom")
    sub = p.add_subparsers(dest="command", required=True)
    for names in (("csvw2rdf", "c2r"), ("rdf2csvw", "r2c"), ("validate",)):
        s = sub.add_parser(names[0], aliases=list(names[1:]))
        s.add_argument("input")
        s.add_argument("--path-override", nargs=2, action="append", default=[], metavar=("FROM", "TO"))
        s.add_argument("--base-iri", default="")
        s.add_argument("--log-level", choices=("error", "warn", "debug"), default="warn")
        if names[0] != "validate":
            s.add_argument("--output", "-o", required=True)
        if names[0] == "csvw2rdf":
            s.add_argument("--format", choices=sorted(serialize.FORMATS))
            s.add_argument("--minimal", action="store_true")
            s.add_argument("--keep-template-iris", action="store_true")
        if names[0] == "rdf2csvw":
            s.add_argument("--descriptor")
            s.add_argument("--no-vocab-metadata", action="store_true")
    a = p.parse_args(argv)
    spark, issues = SparkSession.builder.getOrCreate(), Issues()
    rules = tuple(tuple(x) for x in a.path_override)
    level = {"error": api.ERROR, "warn": api.WARN, "debug": api.DEBUG}[a.log_level]
    options = api.ConversionOptions(base_iri=a.base_iri, path_overrides=rules, log_level=level, log=lambda _, text: print(text, file=sys.stderr), minimal=getattr(a, "minimal", False),
                                    template_iris=not getattr(a, "keep_template_iris", False), descriptor=getattr(a, "descriptor", None), use_vocab_metadata=not getattr(a, "no_vocab_metadata", False))
    if a.command in ("csvw2rdf", "c2r"):
        serialize.write(api.to_quads(spark, a.input, options, issues), a.output, a.format or serialize.format_of(a.output))
    elif a.command in ("rdf2csvw", "r2c"):
        quads = rdf.read_rdf(spark, resolve.override(a.input, list(rules)), a.base_iri or None).persist()
        found, described, made = api.to_tables(quads, options, issues)
        for url, rows in found.items():
            name, _ = api.table_header(described[url])
            tables.write_csv(rows, f"{a.output}/{name.rpartition('/')[2]}", described[url].dialect)
        text = json.dumps(made) if made else options.reader()(a.descriptor)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{a.output}/descriptor.json")
    else:
        try:
            found = api.validate(spark, a.input, options, issues)
        except ValidationError:
            found = issues.frame(spark)
        for line in found.toJSON().toLocalIterator():
            print(line)
        return int(counts(found).count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
