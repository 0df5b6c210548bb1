"""Schemas of streams: what is known of each subject stays in Spark's state store, what is known of each class and predicate
is merged from batch to batch, and the descriptor only grows: its tables are locked once they are given."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quadloom import runtime
from quadloom.operators import infer
from quadloom.streaming.extract import bucket, frames, prepare, stored, texts, tuples

_TERM = "struct<o:string,o_dt:string,o_lang:string>"
_TYPES = {"vlo": _TERM, "vhi": _TERM, "dts": "array<string>", "smin": "int", "smax": "int"}
SUMMARY = "class string, p string, " + ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in infer.FACTS) + ", multi boolean"
_LEAST, _MOST = ("vlo", "lo", "rlo", "smin"), ("vhi", "hi", "rhi", "smax", "lang")


def merged(a: dict[str, Any] | None, b: dict[str, Any]) -> dict[str, Any]:
    """Two sets of FACTS of one subject and predicate, as infer.merge() has them; terms are lists whose nulls come first."""
    if a is None:
        return b
    order = lambda x: [(y is not None, y or "") for y in x] if isinstance(x, list) else x
    out = {"dts": sorted({*a["dts"], *b["dts"]})}
    for names, choose in ((_LEAST, min), (_MOST, max)):
        for c in names:
            out[c] = choose((x[c] for x in (a, b) if x[c] is not None), key=order, default=None)
    return out


class SubjectFacts(StatefulProcessor):
    """Subjects' FACTS by predicate and their classes, for the subjects of a bucket. What a batch changes is given for each of a
    subject's classes: all predicates to a new class, changed ones to the others. The first class makes up for what was given
    without one. Later entries of the state replace earlier ones; it is written anew once half of it is replaced."""

    def init(self, handle) -> None:
        self.facts = handle.getListState("facts", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple, list] = {}
        for g, s, named, *own in tuples(rows, ["g", "s", "named", "p", "facts", "classes"]):
            came.setdefault((g, s, bool(named)), []).append(own)
        known: dict[tuple, dict] = {}
        n = live = 0
        entries: dict[tuple, list] = {}
        for row in stored(self.facts):
            n += 1
            entries[tuple(row[:4])] = row
        for (*subject, p), row in entries.items():
            live += 1
            if tuple(subject) in came:
                known.setdefault(tuple(subject), {})[p] = row[4]
        out, kept = [], []
        for subject, own in came.items():
            self._subject(subject, own, known.get(subject, {}), out, kept)
        if kept and n + len(kept) > 2 * (live + len(kept)):
            self.facts.put(texts(list((entries | {tuple(r[:4]): r for r in kept}).values())))
        elif kept:
            self.facts.appendList(texts(kept))
        yield from frames(iter(out), ["class", "p", "facts", "multi"])

    def _subject(self, subject: tuple, own: list, known: dict[str, dict], out: list, kept: list) -> None:
        _, s, named = subject
        classes = known.pop("", {"classes": []})["classes"]
        new_classes, changed = [], {}
        for p, text, found in own:
            new_classes += [c for c in json.loads(found) if c not in classes and c not in new_classes]
            if p != infer.TYPE:
                before = changed.get(p) or known.get(p)
                now = merged(before, json.loads(text))
                if now != before:
                    changed[p] = now
        kept += [[*subject, p, value] for p, value in changed.items()]
        if new_classes:
            kept.append([*subject, "", {"classes": classes + new_classes}])
        every = known | changed
        for c in classes or ([] if new_classes else [""]):
            out += [self._row(c, p, x) for p, x in changed.items()]
        for c in new_classes:
            out += [self._row(c, p, x) for p, x in every.items()]
        itself = {**dict.fromkeys(infer.FACTS), "dts": [], "lo": s, "hi": s, "rlo": s[::-1], "rhi": s[::-1]} if named else {**dict.fromkeys(infer.FACTS), "dts": []}
        if named:
            itself["smin"] = itself["smax"] = sum(ch in "/?&=#{}[]" for ch in s)
        first_sight = not known and not classes
        for c in new_classes or ([""] if first_sight else []):
            out.append(self._row(c, None, itself))

    @staticmethod
    def _row(cls: str, p: str | None, x: dict[str, Any]) -> tuple:
        return cls, p, json.dumps(x), p is not None and x["vlo"] != x["vhi"]

    def close(self) -> None:
        pass


def fact_stream(quads: DataFrame) -> DataFrame:
    """Rows of SUMMARY for a stream of quads, to be merged by infer.merge_summaries(): a stateful step per bucket of subjects."""
    prepare(quads.sparkSession)
    iri = F.when(F.col("o_kind") == "iri", F.col("o"))
    term = F.array("o", "o_dt", "o_lang")
    seps = F.length(iri) - F.length(F.regexp_replace(iri, infer.SEPARATOR, ""))
    parts = {"vlo": term, "vhi": term, "dts": F.array(infer.datatype_name(F.col("o_kind"), F.col("o_dt"))), "lo": iri, "hi": iri, "rlo": F.reverse(iri), "rhi": F.reverse(iri), "smin": seps, "smax": seps, "lang": F.col("o_lang")}
    facts = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})
    classes = F.to_json(F.when((F.col("p") == infer.TYPE) & iri.isNotNull(), F.array(iri)).otherwise(F.array().cast("array<string>")))
    own = quads.select(F.coalesce("g", F.lit("")).alias("g"), "s", (F.col("s_kind") == "iri").alias("named"), "p", facts.alias("facts"), classes.alias("classes"))
    found = own.withColumn("bucket", bucket("g", "s")).groupBy("bucket").transformWithStateInPandas(SubjectFacts(), "class string, p string, facts string, multi boolean", "append", "none")
    text = F.from_json("facts", ", ".join(f"{c} {'array<string>' if c in ('vlo', 'vhi') else _TYPES.get(c, 'string')}" for c in infer.FACTS))
    out = found.select("class", "p", text.alias("x"), "multi")
    cells = [(F.when(F.col(f"x.{c}").isNotNull(), F.struct(*[F.col(f"x.{c}")[i].alias(n) for i, n in enumerate(("o", "o_dt", "o_lang"))])) if c in ("vlo", "vhi") else F.col(f"x.{c}")).alias(c) for c in infer.FACTS]
    return out.select("class", "p", *cells, "multi")


def schema_stream(quads: DataFrame, on_schema: Callable[[dict[str, Any], int], None], checkpoint: str, *, store: str | None = None) -> StreamingQuery:
    """After each batch ``on_schema(descriptor, batch)`` takes the descriptor of all quads so far: tables that it had before are
    as they were, new predicates of their classes are in new tables of two columns. A class's summary, a row per predicate,
    is kept for each batch in the shared folder, so that a batch that runs again starts where it started."""
    spark = quads.sparkSession
    store = store or checkpoint.rstrip("/") + "-schema"

    def before(batch: int) -> tuple[DataFrame | None, dict[str, Any] | None]:
        done = [int(x.rpartition("=")[2]) for x in runtime.children(spark, f"{store}/descriptor")]
        done = [n for n in done if n < batch]
        if not done:
            return None, None
        text = spark.read.text(f"{store}/descriptor/batch={max(done)}", wholetext=True).first()[0]
        return spark.read.schema(SUMMARY).parquet(f"{store}/summary/batch={max(done)}"), json.loads(text)

    def one(rows: DataFrame, batch: int) -> None:
        old, group = before(batch)
        now = infer.merge_summaries(rows if old is None else rows.unionByName(old)).select(*rows.columns)
        now.write.mode("overwrite").parquet(f"{store}/summary/batch={batch}")
        found = spark.read.schema(SUMMARY).parquet(f"{store}/summary/batch={batch}").withColumn("level", F.col("smin") == F.col("smax"))
        group = infer.describe(found.collect(), group=group, lock=True)  # a row per class and predicate
        spark.createDataFrame([(json.dumps(group),)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/descriptor/batch={batch}")
        for kind in ("summary", "descriptor"):
            for folder in runtime.children(spark, f"{store}/{kind}"):
                if int(folder.rpartition("=")[2]) < batch - 1:
                    runtime.delete(spark, folder)
        on_schema(group, batch)

    return fact_stream(quads).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
