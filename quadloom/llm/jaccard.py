"""Similarity join on word n-gram sets (Jaccard), with components of the link graph.

Method: an inverted index over set prefixes with block skipping, and answers derived from a similar set's answers.

1. One pass shingles every text into a set of 64-bit hashes. Equal sets are one class, known by 128 bits.
2. Sets that no other can be linked with leave early. A linked set lacks at most d = n - ceil(n * num / den) of its
   shingles in its partner; so of its 2d + 4 smallest hashes d + 4 or more occur in some other set of a fitting size.
   Each task counts what it sees itself and sends, packed by hash, only undecided entries and two witnesses of each size.
3. Only the sets that remain are kept. Of equal min-hashes one set is the pivot; its answers (the overlap with each set of
   its bucket) are computed, and a set that differs in few shingles is coded by these differences from its pivot.
4. The index holds prefixes, rarest shingle first, of sets that share a shingle with another component. Short lists are
   joined block by block: entries stand by set size, and blocks whose positions cannot reach the needed overlap are
   skipped, and so are pairs that the parities of their hash cells keep apart. Before them, long lists take pivots, those
   of their largest component first, in rounds of growing number until every list lies within one component or all of
   its pairs are decided; there is no cap.
5. A coded set's answer is derived: its overlap with a set is that of the set it is coded from, corrected by the
   differing shingles alone, so a group of near copies ships one whole set and its members' differences.

Links inside a component that is already known are not produced, only what joins components. No pair is left out
otherwise, no list goes to one task as pairs, and hot lists meet their pivots in a join that adaptive execution splits.

Edge cases: a null text, or one without words, is an empty set and linked with nothing. With fewer words than the
shingle length the whole sequence is the one shingle. Rows with equal sets are one class, linked with each other;
rows that repeat an id are rows of their own. A null id never names a component that has another id. Very long texts
are whole sets. Other columns are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime

#: Entries of a task that are settled together, before they are sent.
FLUSH = 1 << 18
#: Hashes beyond 2d + 1 that step 2 looks at.
EXTRA = 3
MINHASHES = 3
#: A set is coded from its pivot where at most one in so many of its shingles differs.
CODED = 8
SHORT_LIST = 256
BLOCK = 32
PIVOTS = 32
#: Ids (8 bytes each) up to this number may be broadcast to filter rows; beyond it they are joined.
BROADCAST_IDS = 200_000
LOW48 = (1 << 48) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word -> 64-bit hash; bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


@functools.lru_cache(1)
def _words() -> _Words:
    return _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word k-grams."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z alone, and white space is 20 and 09-0D
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words().__getitem__, parts), np.uint64, len(parts))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(31))) * _P + w[i : len(w) - size + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * _Q
    return np.unique(h ^ (h >> np.uint64(27)))


def _class_of(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
    return int(d[0]), int(d[1])


def lacking(n: int, num: int, den: int) -> int:
    """The most shingles of a set of n that a linked set can lack."""
    return n - -(-num * n // den)


def prefix_size(n: int, num: int, den: int) -> int:
    return lacking(n, num, den) + 1


def overlap_needed(n1, n2, num: int, den: int):
    """The least intersection of linked sets: den * i >= num * (n1 + n2 - i)."""
    return -(-num * (n1 + n2) // (num + den))


def _settled(token: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of entries sorted by token and n, of one class each: whether another of the token has a fitting size."""
    out = np.zeros(len(token), bool)
    fit = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
    out[1:] |= fit
    out[:-1] |= fit
    return out


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each number, plane by plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def pack(token: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(n.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.compress(_six(token) + _six(cls) + planes, 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    m = len(data) // 16
    n = np.ascontiguousarray(np.frombuffer(data[12 * m :], np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")
    return _from_six(data[: 6 * m]), _from_six(data[6 * m : 12 * m]), n.astype(np.int64)


ROWS = [("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("cls", pa.int64()), ("seen", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())]
SCHEMA = "doc_id bigint, t1 bigint, t2 bigint, n bigint, c1 bigint, c2 bigint, cls bigint, seen bigint, bucket bigint, data binary"
KINDS = "doc_id bigint, t1 bigint, t2 bigint, n bigint, c1 bigint, c2 bigint, cls bigint, seen bigint"


def _batch(columns: dict[str, list], fields) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in fields], [c for c, _ in fields])


def _flushed(held: list[np.ndarray], cls: list[int], sizes: list[int], buckets: int, num: int, den: int) -> pa.RecordBatch:
    """What the entries of a task settle among themselves, and packed the rest with witnesses for other tasks."""
    ref = np.repeat(np.arange(len(held)), [len(h) for h in held])
    token = (np.concatenate(held) & np.uint64(LOW48)).astype(np.int64)
    c, n = np.array(cls, np.int64)[ref], np.array(sizes, np.int64)[ref]
    order = np.lexsort((c, n, token))
    token, c, n, ref = token[order], c[order], n[order], ref[order]
    done = _settled(token, n, num, den)
    counts = np.bincount(ref[done], minlength=len(held))
    # of the settled ones of a token and nearly equal size the first and the last stand for all
    near = np.floor(np.log(n) / np.log(1.01)).astype(np.int64) if 100 * num < 98 * den else n
    at = np.flatnonzero(done)
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = (token[at[1:]] != token[at[:-1]]) | (near[at[1:]] != near[at[:-1]])
    send = ~done
    send[at[edge[:-1] | edge[1:]]] = True
    token, c, n, done = token[send], c[send], n[send], done[send]
    out: dict[str, list] = {"cls": [], "seen": [], "bucket": [], "data": []}
    some = np.flatnonzero(counts)
    out["cls"] += [cls[i] for i in some]
    out["seen"] += counts[some].tolist()
    out["bucket"] += (some % buckets).tolist()
    out["data"] += [None] * len(some)
    for kind in (False, True):
        own = done == kind
        b = token[own] % buckets
        by = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.diff(b[by])) + 1
        for part in np.split(by, cuts) if len(by) else []:
            out["cls"].append(None)
            out["seen"].append(-1 if kind else -2)
            out["bucket"].append(int(b[part[0]]))
            out["data"].append(pack(token[own][part], c[own][part], n[own][part]))
    return _batch(out, ROWS)


def _first_pass(batches: Iterator[pa.RecordBatch], k: int, buckets: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    cls: list[int] = []
    sizes: list[int] = []
    have: set[int] = set()
    size = turn = 0
    for batch in batches:
        rows: dict[str, list] = {c: batch.column(i).to_pylist() for i, c in enumerate(("doc_id", "t1", "t2"))} | {"n": [], "c1": [], "c2": [], "bucket": []}
        for text in batch.column(3).to_pylist():
            s = shingles(text, k)
            c1, c2 = _class_of(s) if len(s) else (None, None)
            rows["n"].append(len(s))
            rows["c1"].append(c1)
            rows["c2"].append(c2)
            turn += 1
            rows["bucket"].append(turn % buckets)
            if len(s) and c1 not in have:
                have.add(c1)
                held.append(s[: 2 * lacking(len(s), num, den) + 1 + EXTRA])
                cls.append(c1 & LOW48)
                sizes.append(len(s))
                size += len(held[-1])
        yield _batch(rows, ROWS)
        if size >= FLUSH:
            yield _flushed(held, cls, sizes, buckets, num, den)
            held, cls, sizes, size = [], [], [], 0
            have.clear()
    if held:
        yield _flushed(held, cls, sizes, buckets, num, den)


def _second_pass(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows pass; entries of one token from different tasks settle each other."""
    fields = ROWS[:8]
    blobs: dict[int, list[bytes]] = {-1: [], -2: []}
    for batch in batches:
        data = batch.column(9)
        seen = batch.column(7).to_numpy(zero_copy_only=False)
        keep = data.is_null()
        for i in np.flatnonzero(~keep.to_numpy(zero_copy_only=False)):
            blobs[int(seen[i])].append(data[i].as_py())
        yield batch.select([c for c, _ in fields]).filter(keep)
    parts = [unpack(d) for kind in (-1, -2) for d in blobs[kind]]
    if not parts:
        return
    known = np.repeat([True] * len(blobs[-1]) + [False] * len(blobs[-2]), [len(p[0]) for p in parts])
    token, c, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((known, c, n, token))
    token, c, n, known = token[order], c[order], n[order], known[order]
    first = np.ones(len(token), bool)  # a class that several tasks sent; unsettled comes first
    first[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
    token, c, n, known = token[first], c[first], n[first], known[first]
    ids, counts = np.unique(c[_settled(token, n, num, den) & ~known], return_counts=True)
    if len(ids):
        yield _batch({"cls": ids.tolist(), "seen": counts.tolist()}, fields)


BITS = ["b0", "b1", "b2", "b3"]
SETS = "c1 bigint, c2 bigint, n bigint, tokens array<bigint>, mins array<bigint>, " + ", ".join(f"{b} bigint" for b in BITS)


def parities(s: np.ndarray) -> np.ndarray:
    """Of 64 times len(BITS) hash cells, whether a set has an odd number of shingles in each. Where the cells of two sets
    differ, some shingle is in one set alone, so the cells bound the overlap from above."""
    odd = np.bincount(((s >> np.uint64(13)) % np.uint64(64 * len(BITS))).astype(np.int64), minlength=64 * len(BITS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def _whole_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        cs, sets, mins, bits = [], [], [], [np.zeros((0, len(BITS)), np.int64)]
        for t1, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t1 in seen:
                continue
            seen.add(t1)
            s = shingles(text, k)
            if len(s):
                cs.append(_class_of(s))
                sets.append(s.view(np.int64))
                bits.append(parities(s)[None])
                mins.append(np.array([((s ^ (s >> np.uint64(29 + i))) * (_P + np.uint64(2 * i))).min() for i in range(MINHASHES)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cs], pa.int64()), pa.array([c[1] for c in cs], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), _lists(mins), *map(pa.array, np.concatenate(bits).T)], ["c1", "c2", "n", "tokens", "mins", *BITS])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


DONE = "a bigint, b bigint, linked boolean, added array<bigint>, dropped array<bigint>"


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int, code: bool) -> Iterator[pa.RecordBatch]:
    """Rows (p, lead, kind, q, n, x, y) by p, lead and kind: p's own set (lead null); then, per set that others are coded
    from, the set (kind 1) and its followers (kind 2) as shingles added and dropped."""
    pivot = own = lead = base = whole = None
    for batch in batches:
        a, b, ok, added, dropped = [], [], [], [], []
        cols = [batch.column(i).to_pylist() for i in range(5)]
        arrays = []
        for i in (5, 6):
            v, off = batch.column(i), batch.column(i).offsets.to_numpy()
            values = v.values.to_numpy()
            arrays.append([values[off[j] : off[j + 1]] for j in range(len(v))])
        for p, of, kind, q, n, x, y in zip(*cols, *arrays, strict=True):
            if kind == 0:
                pivot, own, lead = p, np.sort(x), None
                continue
            if p != pivot:
                raise ValueError("a pivot's set is missing")
            if kind == 1:
                lead, whole = of, np.sort(x)
                base = _common(own, whole)
                continue
            if of != lead:
                if of != pivot:
                    raise ValueError("the set that others are coded from is missing")
                lead, whole, base = of, own, len(own)
            i = base + _common(own, np.sort(x)) - _common(own, np.sort(y))
            a.append(p)
            b.append(q)
            ok.append(den * i >= num * (len(own) + n - i))
            if code and q == of and CODED * (len(own) + n - 2 * i) <= n:
                added.append(np.setdiff1d(whole, own, assume_unique=True))
                dropped.append(np.setdiff1d(own, whole, assume_unique=True))
            else:
                added.append(None)
                dropped.append(None)
        listed = lambda v: pa.array([None if s is None else s.tolist() for s in v], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_()), listed(added), listed(dropped)], ["a", "b", "linked", "added", "dropped"])


def list_pairs(comp: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of one index list, sorted by n, that lie in different components and can be linked."""
    out = []
    rest = n - pos  # with the shared shingle, what can still agree
    starts = np.arange(0, len(n), BLOCK)
    block_rest, block_n = np.maximum.reduceat(rest, starts), np.minimum.reduceat(n, starts)
    for i in range(1, len(n)):
        least = -(-num * int(n[i]) // den)
        lo = int(np.searchsorted(n[:i], least))
        for b in range(lo // BLOCK, (i - 1) // BLOCK + 1):
            if min(int(block_rest[b]), int(rest[i])) < overlap_needed(int(n[i]), max(int(block_n[b]), least), num, den):
                continue  # no position of this block leaves enough
            j = np.arange(max(lo, b * BLOCK), min(i, (b + 1) * BLOCK))
            need = overlap_needed(n[j], n[i], num, den)
            j = j[(comp[j] != comp[i]) & (np.minimum(rest[j], rest[i]) >= need) & (np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= n[j] + n[i] - 2 * need)]
            out += [(int(node[x]), int(node[i])) for x in j]
    return out


def _short_lists(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, comp, node, n, pos, parities), whole tokens in order."""
    held = None

    def emit(x: dict) -> list[tuple[int, int]]:
        pairs = []
        cuts = np.flatnonzero(np.diff(x["token"])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(x["token"])], strict=True):
            if hi - lo > 1:
                pairs += list_pairs(*(x[c][lo:hi] for c in ("comp", "node", "n", "pos")), np.stack([x[b][lo:hi] for b in BITS], 1).view(np.uint64), num, den)
        return list(set(pairs))

    def table(pairs):
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held:
            x = {c: np.concatenate([held[c], x[c]]) for c in x}
        if not len(x["token"]):
            continue
        last = int(np.flatnonzero(x["token"] != x["token"][-1])[-1] + 1) if (x["token"] != x["token"][-1]).any() else 0
        held = {c: v[last:] for c, v in x.items()}  # at most SHORT_LIST rows and a batch
        if last:
            yield table(emit({c: v[:last] for c, v in x.items()}))
    if held:
        yield table(emit(held))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp), comp the smallest node reachable: alternating large and small stars."""
    now = runtime.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, now = now, runtime.materialize(small, "stars")
        runtime.drop_table(old)
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = state


class _Join:
    """State of one run: the sets that remain, which pairs were compared, which nodes are in which component."""

    def __init__(self, num: int, den: int, sets: DataFrame):
        self.num, self.den, self.sets = num, den, sets
        self.tried: DataFrame | None = None
        self.coded: DataFrame | None = None
        self.comp: DataFrame | None = None

    def verify(self, pairs: DataFrame, code: bool = False) -> None:
        """Compares (a, b) pairs that were not compared before; new links join components."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = runtime.materialize(pairs, "pairs")
        # each pair goes to its busier side's group; groups are cut into parts of about 500 rows, each with the pivot
        degree = pairs.select(F.col("a").alias("p")).union(pairs.select("b")).groupBy("p").agg(F.count("*").alias("d"))
        both = pairs.join(degree.select(F.col("p").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("p").alias("b"), F.col("d").alias("db")), "b")
        swap = F.col("db") > F.col("da")
        both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("p"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("q"), F.ceil(F.greatest("da", "db") / 500).alias("parts"))
        both = both.withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("parts")
        none = F.array().cast("array<bigint>")
        if self.coded is None:
            both = both.select("p", "part", "q", F.col("q").alias("lead"), F.lit(None).cast("bigint").alias("qn"), none.alias("x"), none.alias("y"))
        else:
            both = both.join(self.coded, F.col("q") == F.col("node"), "left").select("p", "part", "q", F.coalesce("lead", "q").alias("lead"), F.col("cn").alias("qn"), F.coalesce("added", none).alias("x"), F.coalesce("dropped", none).alias("y"))
        both = runtime.materialize(both, "oriented")
        # whole sets: the pivots' own, and those that members are coded from (their own, if of none)
        asked = both.select("p", "part", F.lit(None).cast("bigint").alias("lead"), F.lit(0).alias("kind"), F.col("p").alias("node")).union(
            both.where("lead <> p").select("p", "part", "lead", F.lit(1), "lead")).distinct()
        wanted = asked.select("node").union(both.select("q")).distinct()
        sets = self.sets.select("node", "n", "tokens")
        if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # then only the wanted sets are shuffled
            sets = sets.join(F.broadcast(wanted), "node", "left_semi")
        whole = asked.join(sets, "node").select("p", "part", "lead", "kind", F.lit(None).cast("bigint").alias("q"), "n", F.col("tokens").alias("x"), none.alias("y"))
        sizes = sets.select(F.col("node").alias("q"), "n")
        members = both.join(sizes, "q").select("p", "part", "lead", F.lit(2).alias("kind"), "q", "n", "x", "y")
        rows = whole.union(members).repartition("p", "part").sortWithinPartitions("p", "part", F.col("lead").asc_nulls_first(), "kind")
        num, den = self.num, self.den
        done = runtime.materialize(rows.select("p", "lead", "kind", "q", "n", "x", "y").mapInArrow(lambda it: _compare(it, num, den, code), DONE), "compared")
        runtime.drop_table(both)
        runtime.drop_table(pairs)
        met = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        self.tried = met if self.tried is None else self.tried.union(met)
        if code:
            best = F.struct((F.size("added") + F.size("dropped")).alias("s"), F.col("a").alias("lead"), "added", "dropped")
            self.coded = runtime.materialize(done.where("added is not null").groupBy(F.col("b").alias("node")).agg(F.min(best).alias("m")).join(self.sets.select("node", F.col("n").alias("cn")), "node")
                                             .select("node", "cn", "m.lead", "m.added", "m.dropped"), "coded")
        new = self.with_comp(self.with_comp(done.where("linked").select("a", "b"), "a").drop("a").withColumnRenamed("comp", "a"), "b").drop("b").withColumnRenamed("comp", "b").where("a <> b")
        if new.isEmpty():
            return
        found = runtime.materialize(components(new), "contracted")
        if self.comp is None:
            self.comp = found
        else:  # old components take the name of the new one they are part of
            moved = self.comp.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            old, self.comp = self.comp, runtime.materialize(moved.union(found.join(self.comp.select("node"), "node", "left_anti")), "components")
            runtime.drop_table(old)
            runtime.drop_table(found)

    def with_comp(self, rows: DataFrame, col: str = "node") -> DataFrame:
        if self.comp is None:
            return rows.withColumn("comp", F.col(col))
        return rows.join(self.comp.withColumnRenamed("node", col), col, "left").withColumn("comp", F.coalesce("comp", col))


def _sizes_fit(l1: str, l2: str, num: int, den: int) -> str:
    """Whether sizes and parities of two sets leave a link possible."""
    apart = " + ".join(f"bit_count({l1}.{b} ^ {l2}.{b})" for b in BITS)
    return f"{den} * least({l1}.n, {l2}.n) >= {num} * greatest({l1}.n, {l2}.n) and {apart} <= {l1}.n + {l2}.n - 2 * {_overlap(l1, l2, num, den)}"


def _overlap(l1: str, l2: str, num: int, den: int) -> str:
    return f"(({num} * ({l1}.n + {l2}.n) + {num + den - 1}) div {num + den})"


def _bound(l1: str, l2: str, num: int, den: int) -> str:
    """As _sizes_fit, and the position filter of two index entries."""
    return f"{_sizes_fit(l1, l2, num, den)} and least({l1}.n - {l1}.pos, {l2}.n - {l2}.pos) >= {_overlap(l1, l2, num, den)}"


def _index(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Prefix entries (token, node, n, pos), rarest shingle first; those of one set's own shingles are counted, not kept."""
    entries = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = entries.join(shared, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("s"))
    prefix = f"n - ({num} * n + {den - 1}) div {den} + 1"
    own = own.withColumn("alone", F.col("n") - F.size("s")).withColumn("take", F.expr(f"{prefix} - alone").cast("int")).where("take > 0")
    lists = own.select("node", "n", "alone", F.posexplode(F.slice("s", F.lit(1), F.col("take"))).alias("i", "e")).select(F.col("e.token").alias("token"), "node", "n", (F.col("alone") + F.col("i")).alias("pos"))
    # an entry needs a partner that its position and size do not rule out
    best = lists.groupBy("token").agg(F.count("*").alias("c"), F.max(F.col("n") - F.col("pos")).alias("mr"), F.min("n").alias("mn")).where("c > 1")
    return lists.join(best, "token").where(f"least(n - pos, mr) >= {_need(num, den)}").select("token", "node", "n", "pos")


def _need(num: int, den: int) -> str:
    """The least overlap of an entry of n with the shortest partner of its list (mn)."""
    return f"(({num} * (n + greatest(mn, ({num} * n + {den - 1}) div {den})) + {num + den - 1}) div {num + den})"


def _joined(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, t1, t2, n, c1, c2); classes (c1, c2, n, t1, own: smallest id); members (c1, c2, comp) of components
    of two classes or more, None if there are none."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"), text.alias("text"))
    sent = own.mapInArrow(lambda it: _first_pass(it, k, buckets, num, den), SCHEMA).repartition("bucket")
    first = runtime.materialize(sent.mapInArrow(lambda it: _second_pass(it, num, den), KINDS), "shingled")
    rows = first.where("seen is null").drop("cls", "seen")
    classes = runtime.materialize(rows.where("n > 0").groupBy("c1", "c2").agg(F.min("n").alias("n"), F.min("t1").alias("t1"), F.min("doc_id").alias("own")), "classes")
    seen = first.where("seen is not null").groupBy("cls").agg(F.sum("seen").alias("seen"))
    d = f"n - ({num} * n + {den - 1}) div {den}"
    likely = classes.withColumn("cls", F.col("c1").bitwiseAND(F.lit(LOW48))).join(seen, "cls").where(f"seen >= least(n, 2 * ({d}) + {1 + EXTRA}) - ({d})")
    wanted = runtime.materialize(likely.select("t1"), "wanted")
    texts = own.select("t1", "text")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(wanted) if few else wanted, "t1", "left_semi")
    sets = runtime.materialize(texts.mapInArrow(lambda it: _whole_sets(it, k), SETS).dropDuplicates(["c1", "c2"]).withColumn("node", F.monotonically_increasing_id()), "sets")
    runtime.release(spark)
    state = _Join(num, den, sets)

    keys = sets.select("node", "n", *BITS, F.posexplode("mins").alias("band", "key"))
    pivots = keys.groupBy("band", "key").agg(F.min(F.struct("node", "n", *BITS)).alias("p"), F.count("*").alias("size")).where("size > 1")
    star = keys.alias("x").join(pivots, ["band", "key"]).where("x.node <> p.node and " + _sizes_fit("x", "p", num, den)).select(F.col("p.node").alias("a"), F.col("x.node").alias("b"))
    state.verify(star, code=True)

    lists = runtime.materialize(_index(sets, num, den), "lists")
    runtime.release(spark)
    # long lists first: most of a large group's sets are one component before short lists give all of their pairs
    tokens = runtime.materialize(lists.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > SHORT_LIST).select("token"), "long")
    parts = [lists] if tokens.isEmpty() else [runtime.materialize(lists.join(tokens, "token", how), "now") for how in ("left_semi", "left_anti")]
    for now in parts:
        take = max(1, PIVOTS // 8)
        while not now.isEmpty():
            groups = state.with_comp(now).withColumn("rest", F.col("n") - F.col("pos"))
            tops = (groups.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("rest").alias("mr"), F.min("n").alias("mn"))
                    .groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("size"), F.max("mr").alias("mr"), F.min("mn").alias("mn")).where("comps > 1"))
            # an entry whose position leaves too little for the list's best partner can match nothing there
            open_ = groups.join(tops.select("token", F.col("top.comp").alias("top_comp"), "size", "mr", "mn"), "token").where(f"least(rest, mr) >= {_need(num, den)}")
            open_ = open_.select("token", "node", "n", "pos", "comp", "top_comp", "size").join(sets.select("node", *BITS), "node")
            open_ = runtime.materialize(open_, "open-lists")
            short = open_.where(F.col("size") <= SHORT_LIST).select("token", "comp", "node", "n", "pos", *BITS).repartition("token").sortWithinPartitions("token", "n", "node")
            pairs = short.mapInArrow(lambda it: _short_lists(it, num, den), "a bigint, b bigint")
            long = open_.where(F.col("size") > SHORT_LIST)
            # pivots of the largest component meet the sets outside it alone, and soon bring most of them in
            by = Window.partitionBy("token").orderBy(F.expr("comp = top_comp").desc(), F.xxhash64("node"), "node")
            heads = long.withColumn("r", F.row_number().over(by)).where(F.col("r") <= take)
            heads = runtime.materialize(heads.select("token", "node", "n", "pos", "comp", *BITS), "heads")
            pairs = pairs.union(long.alias("x").join(heads.alias("y"), "token").where("x.comp <> y.comp and " + _bound("x", "y", num, den)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
            state.verify(pairs)
            old, now = now, runtime.materialize(long.select("token", "node", "n", "pos").join(heads.select("token", "node"), ["token", "node"], "left_anti"), "now")
            for used in (old, open_, heads):
                runtime.drop_table(used)
            take *= 8
            runtime.release(spark)
    runtime.drop_table(lists)

    members = None
    if state.comp is not None:
        names = state.comp.union(state.comp.select("comp", "comp").distinct())
        members = runtime.materialize(sets.select("c1", "c2", "node").join(names, "node").select("c1", "c2", "comp"), "members")
    runtime.drop_table(sets)
    return rows, classes, members


def join(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row; sets link when den * intersection >= num * union."""
    rows, classes, members = _joined(docs, k, num, den, id_col, text_col)
    named = classes.select("c1", "c2", "own")
    if members is not None:
        heads = members.join(named, ["c1", "c2"]).groupBy("comp").agg(F.min("own").alias("head"))
        heads = members.join(heads, "comp").select("c1", "c2", "head")
        named = named.join(heads, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("head", "own").alias("own"))
    out = rows.join(named, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("own")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(runtime.table(spark, sf_dir, "documents"), k=4, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) END AS l FROM w),
s AS MATERIALIZED (SELECT doc_id, len(l) AS n, unnest(l) AS x FROM l),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(d, o) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.o)
SELECT l.doc_id, len(l.l)::BIGINT AS n_shingles, coalesce((SELECT min(o) FROM r WHERE r.d = l.doc_id), l.doc_id) AS component_id FROM l
"""


def deduplicate(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays, with all its columns: that of the smallest id (rows without one come last), of equal
    ids that of the smallest text hash, of rows that repeat id and text any one. Rows without words are groups of their
    own and all stay."""
    rows, classes, members = _joined(docs, k, num, den, id_col, text_col)
    group: Column = F.concat_ws(":", "c1", "c2")
    keyed = rows.where("n > 0")
    if members is not None:
        keyed = keyed.join(members, ["c1", "c2"], "left")
        group = F.coalesce(F.col("comp").cast("string"), group)
    one = keyed.groupBy(group.alias("g"), "doc_id", "t1", "t2").agg(F.count("*").alias("copies"))
    stay = one.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2", "copies")).alias("s"))
    stay = runtime.materialize(stay.select(F.col("s.doc_id").alias("doc_id"), "s.t1", "s.t2", "s.copies"), "kept")
    names = runtime.free_names(docs.columns, "dd_id", "dd_t1", "dd_t2", "dd_copies")
    i, t1, t2, copies = names
    text = F.col(text_col).cast("string")
    own = docs.withColumns({i: F.col(id_col).cast("bigint"), t1: F.xxhash64(text), t2: F.xxhash64(F.lit("2"), text)})
    keep = stay.select(F.col("doc_id").alias("k_id"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("copies").alias(copies))
    kept = own.join(keep, (own[t1] == keep["k1"]) & (own[t2] == keep["k2"]) & own[i].eqNullSafe(keep["k_id"]), "left").drop("k_id", "k1", "k2")
    wordless = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if stay.where("copies > 1").isEmpty():
        return kept.where(F.col(copies).isNotNull() | wordless).select(*docs.columns)
    single = kept.where((F.col(copies) == 1) | wordless)
    return single.unionByName(kept.where(F.col(copies) > 1).dropDuplicates([i, t1, t2])).select(*docs.columns)
