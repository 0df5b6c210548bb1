"""Quads that arrive to table rows: what changes in a count window, the rows of each window, and rows as they come to be.

``window_changes`` keeps the ring of the last ``size`` quads in Spark's state store and gives the quads that each step adds
and removes. ``convert_windows`` converts each closed window as a whole. ``row_stream`` needs no window: every star keeps
its subjects' values in the state store, dealt to buckets, so that a batch reads the state of the buckets that it touches, and gives the
solutions that a new value makes possible, each once: those that hold at least one new value. Linked stars are joined as
they come (new left rows with all right rows, old left rows with new right ones).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quadloom import runtime
from quadloom.functions.terms import QUAD, QUAD_COLUMNS
from quadloom.operators import r2c
from quadloom.plans.descriptor import Table, TableGroup
from quadloom.streaming.windows import window_step

#: Rows of one frame that a processor hands on.
FRAME = 10_000
#: Tasks that a ring is dealt to.
SHARDS = 64
#: Keys of the state store that subjects are dealt to: a call from Python for each subject takes a millisecond, one for each of
#: these takes as long. What a batch reads is the state of the buckets that it touches.
BUCKETS = 1 << 12
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """The state store that keyed processors need, and the code for executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    runtime.ship(spark)


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, FRAME)):
        yield pd.DataFrame(part, columns=columns, dtype=object)


def _plain(value: Any) -> Any:
    """Null instead of pandas' missing values."""
    return None if value is None or value is pd.NA or isinstance(value, float) and value != value else value


def tuples(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for pdf in rows:
        for r in pdf[columns].itertuples(index=False, name=None):
            yield tuple(map(_plain, r))


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def stored(state) -> Iterator[list]:
    """The rows of a list state of JSON texts, in the order in which they came."""
    for (text,) in state.get():
        yield from json.loads(text)


def texts(rows: list) -> list[tuple[str]]:
    """Rows as JSON texts of at most FRAME rows, for stored()."""
    return [(json.dumps(rows[i : i + FRAME], ensure_ascii=False),) for i in range(0, len(rows), FRAME)]


# Windows


def added_at(n: int, size: int, step: int) -> int:
    """The step that brings quad n into the window: 0 is the first filling."""
    return 0 if n < size else (n - size) // step + 1


class Ring(StatefulProcessor):
    """A share of the ring's places. The quad that comes to a place drives out the one before it."""

    def __init__(self, size: int, step: int):
        self.size, self.step = size, step

    def init(self, handle) -> None:
        self.places = handle.getMapState("places", "place bigint", "n bigint, " + QUAD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from frames(self._changes(rows), ["step", "change", "n", *QUAD_COLUMNS])

    def _changes(self, rows) -> Iterator[tuple]:
        new = sorted(tuples(rows, ["n", *QUAD_COLUMNS]), key=lambda r: r[0])
        held: dict[int, tuple] = {}
        for row in new:
            n = int(row[0])
            place = n % self.size
            if place not in held and self.places.containsKey((place,)):
                held[place] = tuple(self.places.getValue((place,)))
            before = held.get(place)
            if before is not None and int(before[0]) == n:
                continue  # the same place of the stream again
            yield added_at(n, self.size, self.step), "added", n, *row[1:]
            older, newer = (row, before) if before is not None and int(before[0]) > n else (before, row)
            if older is not None:
                yield added_at(int(older[0]) + self.size, self.size, self.step), "removed", int(older[0]), *older[1:]
            held[place] = newer
        for place, row in held.items():
            self.places.updateValue((place,), (int(row[0]), *row[1:]))

    def close(self) -> None:
        pass


def window_changes(quads: DataFrame, size: int, step: int | None = None, number: str = "n") -> DataFrame:
    """step, change (added, removed) and the quad, for a stream of quads numbered from 0 without gaps. As soon as the window
    is full, each quad that comes drives out the one ``size`` places before it. The ring is dealt to SHARDS keys, so that no
    task holds it alone; quads that come late, after the one that drives them out, are added and removed in their steps."""
    prepare(quads.sparkSession)
    step = step or window_step(size)
    width = -(-size // min(SHARDS, size))
    own = quads.select(F.col(number).cast("bigint").alias("n"), *QUAD_COLUMNS).withColumn("shard", F.expr(f"(n % {size}) div {width}"))
    return own.groupBy("shard").transformWithStateInPandas(Ring(size, step), "step bigint, change string, n bigint, " + QUAD, "append", "none")


#: Folders that a batch's quads are kept in.
PARTS = 16
#: Between the window's number and the graph's name in the graph column, while windows are converted side by side.
_MARK = "\u0001"


def windows_of(quads: DataFrame, size: int, step: int | None = None, number: str = "n", first: int = 0, last: int | None = None) -> DataFrame:
    """Each quad once for every window ``first`` to ``last`` that holds it; window k holds the numbers [k * step, k * step + size)."""
    step = step or window_step(size)
    low = F.greatest(F.lit(first), F.expr(f"({number} - {size} + {step}) div {step}"), F.lit(0)).cast("bigint")
    high = F.expr(f"{number} div {step}").cast("bigint")
    if last is not None:
        high = F.least(high, F.lit(last))
    # -(size - step) div step rounds toward zero: what is below the first window counts as 0
    low = F.when(F.col(number) < size, F.lit(first)).otherwise(low)
    return quads.withColumn("window", F.explode(F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint"))))).drop(number)


def window_rows(quads: DataFrame, group: TableGroup, size: int, step: int | None = None, number: str = "n", first: int = 0, last: int | None = None) -> dict[str, DataFrame]:
    """Table URL -> rows with their window, for numbered quads at rest. All windows are converted side by side: a window is to
    the conversion what a graph is, stars and links stay inside it."""
    own = windows_of(quads, size, step, number, first, last)
    own = own.withColumn("g", F.concat(F.col("window").cast("string"), F.lit(_MARK), F.coalesce("g", F.lit("")))).select(*QUAD_COLUMNS)
    window = F.split("g", _MARK)[0].cast("bigint").alias("window")
    return {t.url: r2c.render(r2c.bindings(own, t, distinct=True), t, group.lang, [window]) for t in r2c.tables_with_rows(group)}


def window_emissions(quads: DataFrame, group: TableGroup, size: int, step: int | None = None, number: str = "n") -> dict[str, DataFrame]:
    """Table URL -> the rows that each step of a window emits, with their window, for numbered quads at rest.

    A window's solution is emitted at its step if one of its terms came with the step before (of the first window: is in it)
    and one leaves with the next step or none comes with it. Of columns that give a class the subject counts, of others the
    object. What comes and leaves is a table by window, role and term; each column's term is looked up in it by a join. Quads
    are a set by the stars' own aggregate; shuffles are dealt to tasks by the number of quads in all windows, so that a task's
    share does not grow with them, and the rows are written, as that number holds while they are made."""
    spark, step = quads.sparkSession, step or window_step(size)
    own = runtime.materialize(quads.select(F.col(number).cast("bigint").alias("n"), *QUAD_COLUMNS), "numbered")
    top, count = own.agg(F.max("n"), F.count("*")).first()
    at = lambda n: F.expr(f"case when {n} < {size} then 0L else ({n} - {size}) div {step} + 1 end")
    came, left = at("n"), F.when(F.col("n") + size <= F.lit(top), at(f"(n + {size})"))
    flag = lambda window, previous, added, removed: F.struct(window.cast("bigint").alias("window"), F.lit(previous).alias("previous"), F.lit(added).alias("added"), F.lit(removed).alias("removed"))
    tables = r2c.tables_with_rows(group)
    slots = {t.url: [slot for star in r2c.plan(t).values() for slot in star.slots] for t in tables}
    roles = sorted({_role(slot) for some in slots.values() for slot in some})
    flags = ["previous", "added", "removed"]

    windows_ = windows_of(own, size, step)
    windows_ = windows_.withColumn("g", F.concat(F.col("window").cast("string"), F.lit(_MARK), F.coalesce("g", F.lit("")))).select(*QUAD_COLUMNS)
    out = {}
    with runtime.shuffled(spark, count * -(-size // step)):
        marks = own.select(F.explode(F.array(flag(came, True, False, False), flag(came - 1, False, True, False), flag(left - 1, False, False, True))).alias("m"), "s", "o").where("m.window is not null")
        marks = marks.select("m.*", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("term")) for r in roles])).alias("x"))
        marks = runtime.materialize(marks.groupBy("window", "x.role", "x.term").agg(*[F.max(c).alias(c) for c in flags]), "marks")
        for t in tables:
            found = r2c.bindings(windows_, t, distinct=True).withColumn("window", F.split("g", _MARK)[0].cast("bigint"))
            for slot in slots[t.url]:
                i, role = slot.index, _role(slot)
                term = F.when(F.col(f"o{i}").isNotNull(), F.col(f"{role}{i}"))
                met = marks.where(F.col("role") == role).select(F.col("window").alias("mark_window"), "term", *[F.col(c).alias(f"{c}{i}") for c in flags])
                found = found.join(met, (F.col("window") == F.col("mark_window")) & (term == F.col("term")), "left").drop("mark_window", "term")
            previous, added, removed = (F.coalesce(F.greatest(F.lit(False), *[F.col(f"{c}{slot.index}") for slot in slots[t.url]]), F.lit(False)) for c in flags)
            kept = found.where(previous & (removed | ~added))
            out[t.url] = runtime.materialize(r2c.render(kept, t, group.lang, [F.col("window")]), "emitted")
    return out


def _role(slot: r2c.Slot) -> str:
    """Which of a solution's terms counts for a column: s or o."""
    return "s" if slot.predicate == r2c.TYPE else "o"


def convert_windows(quads: DataFrame, group: TableGroup, size: int, emit: Callable[[str, DataFrame, int], None], checkpoint: str, *, step: int | None = None, number: str = "n", delay: int = 0, store: str | None = None) -> StreamingQuery:
    """Converts each window of a numbered stream when it closes: when a number ``delay`` behind its end has come.

    A batch's quads are kept in Parquet folders, PARTS or so of equally many steps each and named by their last step; a batch
    reads those of the windows that it closes, and folders that no later window needs are deleted a batch later, so that what
    a batch reads does not grow, and the number of its files neither. A batch that runs again
    overwrites its own part. ``emit(url, rows, batch)`` takes the rows with their window; ``last_windows`` those left over."""
    spark = quads.sparkSession
    runtime.ship(spark)
    step = step or window_step(size)
    store = store or checkpoint.rstrip("/") + "-window"

    def one(batch: DataFrame, number_of: int) -> None:
        own = batch.select(F.col(number).cast("bigint").alias("n"), *QUAD_COLUMNS)
        low, new_top = own.agg(F.min("n"), F.max("n")).first()
        width = 1 if low is None else (new_top // step - low // step) // PARTS + 1
        own.withColumn("last", F.expr(f"(n div {step} div {width} + 1) * {width} - 1")).write.mode("overwrite").partitionBy("last").parquet(f"{store}/quads/batch={number_of}")
        top, closed, _ = _progress(spark, store, number_of - 1)
        top = max(top, -1 if new_top is None else new_top)
        now = max(closed, (top + 1 - delay - size) // step if top + 1 - delay >= size else -1)
        if now > closed:
            for url, rows in window_rows(_kept(spark, store, closed + 1, step), group, size, step, "n", closed + 1, now).items():
                emit(url, rows, number_of)
        _delete_before(spark, store, closed + 1, number_of)
        spark.createDataFrame([(top, now, step)], "top bigint, closed bigint, step bigint").coalesce(1).write.mode("overwrite").parquet(f"{store}/progress/batch={number_of}")

    return quads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_windows(spark: SparkSession, group: TableGroup, size: int, checkpoint: str, *, step: int | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """Rows of the windows that were open when the stream ended, those that hold fewer than ``size`` quads too."""
    step = step or window_step(size)
    store = store or checkpoint.rstrip("/") + "-window"
    top, closed, _ = _progress(spark, store, None)
    return window_rows(_kept(spark, store, closed + 1, step), group, size, step, "n", closed + 1, max(top, 0) // step)


_KEPT = "n bigint, " + QUAD + ", batch bigint, last bigint"


def _kept(spark: SparkSession, store: str, first: int, step: int) -> DataFrame:
    """Quads of all steps from ``first`` on; files that hold earlier steps alone are not read."""
    if not runtime.exists(spark, f"{store}/quads"):
        return spark.createDataFrame([], "n bigint, " + QUAD)
    return spark.read.schema(_KEPT).option("basePath", f"{store}/quads").parquet(f"{store}/quads").where((F.col("last") >= first) & (F.col("n") >= first * step)).select("n", *QUAD_COLUMNS)


def _progress(spark: SparkSession, store: str, batch: int | None) -> tuple[int, int, int]:
    """The largest number and the last closed window after a batch (None: the last one)."""
    if not runtime.exists(spark, f"{store}/progress"):
        return -1, -1, 0
    rows = spark.read.schema("top bigint, closed bigint, step bigint, batch bigint").option("basePath", f"{store}/progress").parquet(f"{store}/progress")
    if batch is not None:
        rows = rows.where(F.col("batch") <= batch)
    found = rows.orderBy(F.desc("batch")).first()
    return (found.top, found.closed, found.step) if found else (-1, -1, 0)


def _delete_before(spark: SparkSession, store: str, first: int, batch: int) -> None:
    """Deletes the steps below ``first`` of batches before ``batch``, and progress that a repeated batch cannot ask for."""
    for folder in runtime.children(spark, f"{store}/quads"):
        if int(folder.rpartition("=")[2]) < batch:
            steps = [x for x in runtime.children(spark, folder) if "last=" in x]
            old = [x for x in steps if int(x.rpartition("=")[2]) < first]
            for x in [folder] if len(old) == len(steps) else old:
                runtime.delete(spark, x)
    for folder in runtime.children(spark, f"{store}/progress"):
        if int(folder.rpartition("=")[2]) < batch - 1:
            runtime.delete(spark, folder)


# Rows as they come to be


class StarValues(StatefulProcessor):
    """Subjects' values, column by column, for the subjects of a bucket. New ones give the solutions that hold at least one of them."""

    def __init__(self, slots: list[int], needed: list[int], shown: list[int]):
        self.slots, self.needed, self.shown = slots, needed, shown

    def init(self, handle) -> None:
        self.values = handle.getListState("values", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple, dict] = {}  # subject -> slot and quad -> value
        for g, s, slot, ident, o in tuples(rows, ["g", "s", "slot", "id", "o"]):
            came.setdefault((g, s), {}).setdefault((int(slot), ident), o)
        old: dict[tuple, dict] = {}
        for g, s, slot, ident, o in stored(self.values):
            if (g, s) in came:
                came[g, s].pop((slot, ident), None)
                old.setdefault((g, s), {k: [] for k in self.slots})[slot].append(o)
        if kept := [(*subject, *k, o) for subject, values in came.items() for k, o in values.items()]:
            self.values.appendList(texts(kept))
        yield from frames(self._rows(old, came), ["g", "s", *(f"o{i}" for i in self.shown)])

    def _rows(self, old: dict[tuple, dict], came: dict[tuple, dict]) -> Iterator[tuple]:
        for subject, values in came.items():
            new: dict[int, list] = {k: [] for k in self.slots}
            for (slot, _), o in values.items():
                new[slot].append(o)
            for r in self.solutions(old.get(subject) or {k: [] for k in self.slots}, new):
                yield *subject, *r

    def solutions(self, old: dict[int, list], new: dict[int, list]) -> Iterator[tuple]:
        every = {s: old[s] + new[s] for s in self.slots}
        if not any(new.values()) or any(not every[s] for s in self.needed):
            return
        if not (any(old.values()) and all(old[s] for s in self.needed)):  # the subject's first solutions
            yield from itertools.product(*[every[s] or [None] for s in self.shown])
            return
        for i, s in enumerate(self.shown):  # columns before s: values from before; s: new ones; behind it: all
            if new[s]:
                yield from itertools.product(*[old[x] if every[x] else [None] for x in self.shown[:i]], new[s], *[every[x] or [None] for x in self.shown[i + 1 :]])

    def close(self) -> None:
        pass


class OptionalRows(StatefulProcessor):
    """Left rows with all right rows of their key, each pair once, for the keys of a bucket; a left row without any, when it
    comes, alone."""

    def __init__(self, keys: list[str], left: list[str], right: list[str]):
        self.keys, self.left, self.right = keys, left, right

    def init(self, handle) -> None:
        self.lefts = handle.getListState("lefts", "rows string")
        self.rights = handle.getListState("rights", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new_left, new_right = [], []
        k, n = len(self.keys), len(self.keys) + len(self.left)
        for side, *row in tuples(rows, ["side", *self.keys, *self.left, *self.right]):
            new_left.append(row[:n]) if side == 0 else new_right.append(row[:k] + row[n:])
        yield from frames(self._pairs(new_left, new_right), self.left + self.right)
        if new_left:
            self.lefts.appendList(texts(new_left))
        if new_right:
            self.rights.appendList(texts(new_right))

    def _pairs(self, new_left: list[list], new_right: list[list]) -> Iterator[tuple]:
        k = len(self.keys)
        if new_left:
            asked = {tuple(r[:k]) for r in new_left}
            rights: dict[tuple, list[tuple]] = {}
            for r in itertools.chain(stored(self.rights), new_right):
                if tuple(r[:k]) in asked:
                    rights.setdefault(tuple(r[:k]), []).append(tuple(r[k:]))
            for r in new_left:
                for other in rights.get(tuple(r[:k])) or [(None,) * len(self.right)]:
                    yield *r[k:], *other
        if new_right:
            by_key: dict[tuple, list[list]] = {}
            for r in new_right:
                by_key.setdefault(tuple(r[:k]), []).append(r[k:])
            for r in stored(self.lefts):
                for other in by_key.get(tuple(r[:k]), ()):
                    yield *r[k:], *other

    def close(self) -> None:
        pass


def star_stream(quads: DataFrame, star: r2c.Star, table: Table, shown: list[r2c.Slot] | None = None) -> DataFrame:
    """g, s and o{i} of the star's new solutions; ``shown``: only of these columns, of the others counts that they are there."""
    shown = star.slots if shown is None else shown
    own = r2c.of_star(quads, star, table)
    ident = F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("p", "o_kind", "o", "o_dt", "o_lang")]))
    matched = F.array(*[F.when(r2c.matches(s, table), F.lit(s.index)) for s in star.slots])
    own = own.select("g", "s", F.explode(F.array_compact(matched)).alias("slot"), ident.alias("id"), "o")
    hidden = [s.index for s in star.slots if s not in shown]
    if hidden:
        own = own.withColumns({c: F.when(F.col("slot").isin(hidden), "").otherwise(F.col(c)) for c in ("id", "o")})
    needed = [s.index for s in star.slots if s in r2c.needed(star, table) or r2c.is_type(s)]
    schema = "g string, s string, " + ", ".join(f"o{s.index} string" for s in shown)
    values = StarValues([s.index for s in star.slots], needed, [s.index for s in shown])
    return own.withColumn("bucket", bucket("g", "s")).groupBy("bucket").transformWithStateInPandas(values, schema, "append", "none")


def link_values(quads: DataFrame, star: r2c.Star, table: Table, slot: r2c.Slot) -> DataFrame:
    """g, s and the values of one column, each once."""
    return star_stream(quads, r2c.Star(star.key, [slot]), table)


def _optional(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Left rows with right ones of equal keys (pairs of columns), or alone; rows with a null in a key stay alone."""
    lcols, rcols = left.columns, [c for c in right.columns if c not in {r for _, r in keys}]
    key = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{c} string" for c in [*lcols, *rcols])
    null = lambda cols: [F.lit(None).cast("string").alias(c) for c in cols]
    whole = F.lit(True)
    for a, _ in keys:
        whole = whole & F.col(a).isNotNull()
    sides = left.where(whole).select(F.lit(0).alias("side"), *[F.col(a).alias(k) for (a, _), k in zip(keys, key, strict=True)], *lcols, *null(rcols)).unionByName(
        right.select(F.lit(1).alias("side"), *[F.col(b).alias(k) for (_, b), k in zip(keys, key, strict=True)], *null(lcols), *rcols))
    joined = sides.withColumn("bucket", bucket(*key)).groupBy("bucket").transformWithStateInPandas(OptionalRows(key, lcols, rcols), schema, "append", "none")
    return joined.unionByName(left.where(~whole).select(*lcols, *null(rcols)))


def _inner(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    on = F.lit(True)
    for a, b in keys:
        on = on & (left[a] == right[b])
    return left.join(right, on, "inner").drop(*[right[b] for _, b in keys])


def _above(stars: dict[str, r2c.Star], key: str) -> set[str]:
    """The star and those from which links lead to it."""
    found, new = set(), {key}
    while new:
        found |= new
        new = {k for k, star in stars.items() if any(s.child in new for s in star.slots)} - found
    return found


def solution_stream(quads: DataFrame, table: Table) -> DataFrame:
    """o{i} and s{i} of each new solution, for streaming (or resting) quads that may repeat."""
    prepare(quads.sparkSession)
    quads = r2c.in_graphs(quads)
    stars = r2c.plan(table)
    if any(s.child in _above(stars, k) for k, star in stars.items() for s in star.slots):
        raise ValueError(f"links of {table.url} lead back to their start: no stream of rows")
    children = {s.child for star in stars.values() for s in star.slots if s.child}
    done: set[str] = set()

    def build(key: str) -> DataFrame:
        done.add(key)
        star = stars[key]
        needed = r2c.needed(star, table)
        links = [s for s in star.slots if s.child and s.child not in done]
        done.update(s.child for s in links)
        loose = [s for s in links if s not in needed and r2c.needed(stars[s.child], table)]
        kept = [s for s in star.slots if s not in loose]
        out = star_stream(quads, star, table, kept)
        for s in links:
            right = build(s.child).withColumnsRenamed({"s": f"child_s{s.index}", "g": f"child_g{s.index}"})
            names = [("g", f"child_g{s.index}"), (f"o{s.index}", f"child_s{s.index}")]
            if s in loose:  # a value counts only together with what its target must have
                pairs = link_values(quads, star, table, s).withColumnsRenamed({"g": f"link_g{s.index}", "s": f"link_s{s.index}"})
                on = (pairs[f"link_g{s.index}"] == right[names[0][1]]) & (pairs[f"o{s.index}"] == right[names[1][1]])
                pairs = pairs.join(right, on, "inner").drop(names[0][1], names[1][1])
                out = _optional(out, pairs, [("g", f"link_g{s.index}"), ("s", f"link_s{s.index}")])
            elif r2c.needed(stars[s.child], table):
                out = _inner(out, right, names)
            else:
                out = _optional(out, right, names)
        return out.withColumns({f"s{s.index}": F.col("s") for s in star.slots})

    order = [k for k in stars if k not in children] or list(stars)[:1]
    out = build(order[0])
    for key in [*order[1:], *stars]:
        if key in done:
            continue
        left_key, shared = r2c.shared_variables(stars, set(done), key)
        if not shared:
            raise ValueError(f"nothing joins {key} to the other subjects of {table.url}")
        right = build(key).withColumnsRenamed({"s": "other_s", "g": "other_g"})
        out = out.withColumn("join_key", r2c.variable_parts(F.col(r2c.subject_of(stars, left_key)), left_key, shared, table))
        right = right.withColumn("other_key", r2c.variable_parts(F.col("other_s"), key, shared, table))
        out = out.join(right, (F.col("join_key") == F.col("other_key")) & (F.col("g") == F.col("other_g")), "inner").drop("join_key", "other_key", "other_s", "other_g")
    return out


def row_stream(quads: DataFrame, group: TableGroup) -> dict[str, DataFrame]:
    """Table URL -> stream of its rows, each solution once, as soon as all that it must have has come. Quads that repeat (a
    source that is read again) change nothing. A solution whose optional value comes later is given again with it: rows are
    only added. Write each with ``writeStream`` in append mode; state and offsets make a repeated batch give the same rows."""
    return {t.url: r2c.render(solution_stream(quads, t), t, group.lang) for t in r2c.tables_with_rows(group)}


__all__ = ["added_at", "convert_windows", "last_windows", "row_stream", "solution_stream", "star_stream", "window_changes", "window_emissions", "window_rows", "windows_of"]
