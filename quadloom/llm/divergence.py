"""How far the sources of a language lie apart in their words, by two-dimensional group-block tiling.

Every (lang, source) group is a count vector over its language's kept terms (those in at least ``min_docs`` of its
documents), smoothed to integer shares p. The divergence of two groups is the sum of floor((p-q)^2 / (p+q)) over all kept
terms, absent ones too.

Terms are counted inside tasks before the first shuffle. A language's terms fall by their hash into chunks of about
``CHUNK`` terms, its groups into blocks of about ``BLOCK`` groups; a group's counts in a chunk are one packed vector. Each
vector goes to every tile (block by block) of its block; a tile's task walks over its chunks one after the other and adds
up the submatrix of its pairs, so that it holds the vectors of two blocks in one chunk, whatever the vocabulary's size.
``BAND`` successive chunks are a task's share; the submatrices of a tile's bands are summed. No source, language or term
is gathered anywhere: a source of a third of all rows is a vector like the others.

All arithmetic is exact in longs: shares by long division in three steps of 1000.

Edge cases: null text, language and source count as ''. Groups without terms have equal shares; a language without kept
terms gives divergence 0 and no terms; a language of one source gives no pairs. Repeated rows count as documents each. Very
long texts are counted whole. Other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime

#: Production parameters of the query.
MIN_DOCS, SCALE_STEPS, TOP = 10, 3, 10
#: Terms of a chunk and groups of a block (both about, as hashes deal them), chunks of a task.
CHUNK, BLOCK, BAND = 4096, 32, 8
#: Terms that a counting task holds before it hands them on.
HELD = 200_000
#: Letters of ASCII and all else beyond it; texts are bytes whose A-Z are lower-cased.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LONG_TEXT = 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) as far as this task knows; a row without term for each group."""
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = [None, *(t.decode() for t in n)]
            size = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.string()),
                                              pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            key = (lang.as_py(), source.as_py())
            n, docs = found.get(key) or found.setdefault(key, (Counter(), Counter()))
            low = text.as_py().lower()
            own = Counter(TERM.findall(low) if len(low) <= LONG_TEXT else (m.group() for m in TERM.finditer(low)))
            n.update(own)
            docs.update(own.keys())
        if sum(len(n) for n, _ in found.values()) > HELD:
            yield from rows()
            found.clear()
    yield from rows()


def count_terms(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n occurrences, docs rows that hold it; and a row with a null term for every group."""
    runtime.ship(docs.sparkSession)
    runtime.small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"))],
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    found = own.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, whole: str) -> Column:
    """1 + floor(10^9 * (n + 2) / whole), digit by digit, so that no product leaves a long."""
    rest, out = F.expr(f"{n} + 2"), F.lit(1).cast("bigint")
    for step in range(SCALE_STEPS):
        rest = rest * 1000
        out = out + F.call_function("div", rest, F.col(whole)) * 1000 ** (SCALE_STEPS - 1 - step)
        rest = rest % F.col(whole)
    return out


def _shares(n: np.ndarray, whole: int) -> np.ndarray:
    """The same for arrays."""
    rest, out = n.astype(np.int64) + 2, np.ones(len(n), np.int64)
    for step in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, whole)
        out += digit * 1000 ** (SCALE_STEPS - 1 - step)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Submatrices of tiles whose rows come by tile, chunk and source: lang, a, b, value, with a and b in two blocks or, on
    the diagonal, in one."""
    tile, chunk = None, None
    vectors: list[tuple[str, int, np.ndarray]] = []  # source, block, shares of the chunk's terms
    total: dict[tuple[str, str], int] = {}

    def add() -> None:
        first = [(s, v) for s, b, v in vectors if b == tile[1]]
        second = first if tile[1] == tile[2] else [(s, v) for s, b, v in vectors if b == tile[2]]
        if not second:
            return
        matrix = np.stack([v for _, v in second])
        for k, (source, p) in enumerate(first):
            q = matrix[k + 1 :] if second is first else matrix
            for (other, _), value in zip(second[k + 1 :] if second is first else second, ((q - p) ** 2 // (q + p)).sum(axis=1).tolist(), strict=True):
                total[source, other] = total.get((source, other), 0) + value

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(total), pa.string()), pa.array([a for a, _ in total], pa.string()),
                                           pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "a", "b", "value"])

    for batch in batches:
        packed = batch.column(10)
        for r, (lang, i, j, band, c, source, block, whole, base, size) in enumerate(zip(*[x.to_pylist() for x in batch.columns[:10]], strict=True)):
            now = (lang, i, j, band)
            if now != tile or c != chunk:
                if tile is not None:
                    add()
                    vectors.clear()
                    if now != tile:
                        yield rows()
                        total.clear()
                tile, chunk = now, c
            shares = np.full(size, base, np.int64)
            own = packed[r].values
            if own is not None and len(own):
                at, n = own.flatten()
                shares[at.to_numpy(zero_copy_only=False)] = _shares(n.to_numpy(zero_copy_only=False), whole)
            vectors.append((source, block, shares))
    if tile is not None:
        add()
        yield rows()


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence (part pair), and the group's
    terms above the language's share (part term), the ``top`` that diverge most."""
    counts = runtime.materialize(count_terms(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    groups = counts.where("term is null").select("lang", "source")
    # a row for each language
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    langs = runtime.materialize(langs.select("lang", "v", (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole"), F.expr(f"(v + {CHUNK - 1}) div {CHUNK}").alias("chunks"), F.expr(f"(g + {BLOCK - 1}) div {BLOCK}").alias("blocks")), "languages")
    # terms get their place in a chunk: a window over some CHUNK rows
    terms = kept.join(langs.select("lang", "chunks", "lang_whole"), "lang").withColumn("chunk", F.expr("pmod(xxhash64(term), chunks)"))
    terms = terms.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks")
    entries = runtime.materialize(counts.where("term is not null").drop("docs").join(terms, ["lang", "term"]), "term-entries")
    sizes = entries.groupBy("lang", "chunk").agg((F.max("at") + 1).alias("size"))
    wholes = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(langs.drop("lang_whole"), "lang")
    wholes = runtime.materialize(wholes.select("lang", "source", (F.coalesce("own", F.lit(0)) + 2 * F.col("v")).alias("whole"), "chunks", "blocks", F.expr("pmod(xxhash64(source), blocks)").alias("block")), "groups")

    # packed vectors, a row for each group and chunk of its language, those without counts too
    packed = entries.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("packed"))
    grid = wholes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("chunks", F.lit(1)) - 1)))
    grid = grid.join(packed, ["lang", "source", "chunk"], "left").join(sizes, ["lang", "chunk"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    grid = grid.withColumn("base", F.when(F.col("whole") > 0, share("0", "whole")).otherwise(0))
    tiles = grid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr(f"chunk div {BAND}").alias("band"), "chunk", "source", "block", "whole", "base", "size", "packed")
    matrix = (tiles.repartition("lang", "i", "j", "band").sortWithinPartitions("lang", "i", "j", "band", "chunk", "source")
              .mapInArrow(_tiles, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = matrix.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    over = entries.join(wholes.select("lang", "source", "whole"), ["lang", "source"]).withColumns({"p": share("n", "whole"), "q": share("lang_n", "lang_whole")}).where("n > 0 and p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))  # cut before the shuffle too


def op11_group_block_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(runtime.table(spark, sf_dir, "documents"))


#: All numbers are wide, so that no product overflows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS nl FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.nl), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
ng AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT ng.lang, ng.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (ng.n + 2 * v.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (k.nl + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM ng JOIN v ON v.lang = ng.lang JOIN kept k ON k.lang = ng.lang LEFT JOIN c ON c.lang = ng.lang AND c.source = ng.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT pair.lang, pair.source, 'pair' AS part, pair.item, coalesce(dist.value, 0) AS value
  FROM pair LEFT JOIN dist ON dist.lang = pair.lang AND dist.source = pair.source AND dist.item = pair.item
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
"""
