"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of columns (domain, language, source). Each node shares its budget among its children
by weight; what a child cannot use (its tokens times ``max_epochs``) goes to its siblings by their weights, and only
what none of them can use goes back to the node's own siblings. Each leaf then takes a token-prefix of its seeded
epochs: every full epoch that fits, and of the next epoch's order (by a keyed digest of epoch and id) the documents
that begin before the remaining budget ends.

All steps are DataFrame operations. No window runs over a leaf: per leaf, 4,096 buckets of the digest are summed, the one
where the prefix ends is cut into 4,096 again as long as it has more than BUCKET_ROWS rows, and only then ordered.

Edge cases: null or empty texts have 0 tokens; they belong to the prefix when their place in the order comes before
its end. Null keys count as ''. Keys without a weight have ``default_weight``; a weight of 0 takes nothing. Rows that
repeat an id share a place in the order and stand or fall together (a null id counts as ''). An empty table or a
budget of 0 gives no rows. Other columns are kept as they are, whatever their names; an added column whose name is taken
gets a number behind it.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime

#: Production parameters of the query and the pipeline.
DOMAINS = {"reference": ["src0", "src1", "src2"], "forum": [f"src{i}" for i in range(3, 8)]}
OTHER_DOMAIN = "web"
WEIGHTS: list[dict[str, float]] = [
    {"reference": 3.0, "forum": 2.0, "web": 5.0},
    {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    {"src0": 2.0, "src1": 1.0, "src2": 1.0},
]
LEVELS = ["domain", "lang", "source"]
SEED, MAX_EPOCHS, BUDGET_SHARE = "mix-1", 2, 0.6
#: Rows of one bucket that a task may order.
BUCKET_ROWS = 4096

TOKEN = "[^ \\t\\n\\r\\f]+"


def domain_of(source: Column) -> Column:
    out = F.lit(OTHER_DOMAIN)
    for name, members in DOMAINS.items():
        out = F.when(source.isin(members), F.lit(name)).otherwise(out)
    return out


def _weight(col: str, weights: Mapping[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, w in weights.items():
        out = F.when(F.col(col) == k, F.lit(float(w))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], budget: str = "budget") -> DataFrame:
    """Water-filling: ``cap`` and ``w`` per node, ``budget`` of its parent -> ``alloc``. Nodes fill in the order of
    cap / w; a node is full if its share of what the fuller-filled ones left reaches its cap."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(True))
    order = by.orderBy(F.expr("cap / w"), "w", "cap", *[c for c in nodes.columns if c not in ("cap", "w", budget)])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = nodes.where("w > 0 and cap > 0").withColumns({
        "c_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_left": F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    x = x.withColumn("full", F.expr(f"cap * w_left <= ({budget} - c_before) * w"))
    x = x.withColumns({"c_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0)),
                       "w_rest": F.sum(F.when(~F.col("full"), F.col("w"))).over(by)})
    return x.withColumn("alloc", F.expr(f"case when full then cap else ({budget} - c_full) * w / w_rest end")).drop("c_before", "w_left", "full", "c_full", "w_rest", budget)


def allocate(leaves: DataFrame, levels: list[str], weights: list[Mapping[str, float]], budget: Column, *, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """Leaves (levels, tokens) -> levels, tokens, alloc. Each level's budgets are written, so that plans stay small."""
    leaves = leaves.withColumn("cap", F.when(F.array_min(F.array(*[_weight(c, w, default_weight) for c, w in zip(levels, weights, strict=True)])) > 0, F.col("tokens").cast("double") * max_epochs).otherwise(0.0))
    leaves = runtime.materialize(leaves, "mix-caps")
    # the root: one row per table
    budgets = leaves.agg(F.least(budget.cast("double"), F.sum("cap")).alias("budget"))
    for d in range(1, len(levels) + 1):
        path = levels[:d]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path[-1], weights[d - 1], default_weight))
        nodes = nodes.crossJoin(F.broadcast(budgets)) if d == 1 else nodes.join(budgets, path[:-1])  # one row
        budgets = runtime.materialize(share_out(nodes, path[:-1]).select(*path, F.col("alloc").alias("budget")), "mix-budgets")
    return leaves.select(*levels, "tokens").join(budgets.withColumnRenamed("budget", "alloc"), levels)


def _ends(part: DataFrame, own: list[str]) -> DataFrame:
    """Rows (own, rest, h, tokens) -> per leaf the last digest that begins before ``rest`` and the tokens before it.
    The bucket of digests where the prefix ends is cut by three more digits until it holds few rows."""
    found, known = None, 0
    while True:
        inside = part if found is None else part.join(found, own).where(F.substring("h", 1, known) == F.col("bucket")).drop("bucket", "rows_in")
        if found is None:
            inside = inside.withColumn("base", F.lit(0).cast("bigint"))
        elif known >= 30 or (found.agg(F.max("rows_in")).first()[0] or 0) <= BUCKET_ROWS:
            break
        known += 3
        sums = inside.groupBy(*own, "rest", "base", F.substring("h", 1, known).alias("bucket")).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows_in"))
        upto = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 4,096 rows a leaf
        sums = sums.withColumn("after", F.col("base") + F.sum("n").over(upto)).where("after - n < rest and after >= rest")
        found = runtime.materialize(sums.select(*own, "bucket", "rows_in", F.expr("after - n").alias("base")), "mix-buckets")
    same = inside.groupBy(*own, "rest", "base", "h").agg(F.sum("tokens").alias("n"))
    order = Window.partitionBy(*own).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("before", F.col("base") + F.sum("n").over(order) - F.col("n")).where("before < rest")
    return same.groupBy(*own).agg(F.max("h").alias("last_h"), F.max("before").alias("last_before"))


def mix(docs: DataFrame, levels: list[str], weights: list[Mapping[str, float]], *, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
        max_epochs: int = MAX_EPOCHS, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE, default_weight: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once per epoch, with ``epoch``, ``tokens`` and ``take_tokens`` (with a
    number behind the name where a column has it already). The budget is ``budget_tokens``, or ``budget_share`` of all
    tokens."""
    added = runtime.free_names(docs.columns, "epoch", "tokens", "take_tokens")
    # the user's columns travel as one, so that no name can clash
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("tokens"),
                        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("mix_id"), *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(f"mix_{i}") for i, c in enumerate(levels)])
    own = [f"mix_{i}" for i in range(len(levels))]
    small = runtime.materialize(keyed.select("mix_id", "tokens", *own), "mix-tokens")
    leaves = small.groupBy(*own).agg(F.sum("tokens").alias("tokens"))
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.floor(F.sum("tokens") * F.lit(float(budget_share)))
    leaves = allocate(leaves, own, weights, budget, max_epochs=max_epochs, default_weight=default_weight)
    # rounding apart, alloc is at most max_epochs * tokens
    leaves = leaves.withColumn("alloc", F.floor(F.col("alloc") + 1e-6)).withColumn("full_epochs", F.least(F.expr("alloc div tokens"), F.lit(max_epochs)))
    leaves = runtime.materialize(leaves.withColumn("rest", F.col("alloc") - F.col("full_epochs") * F.col("tokens")).withColumnRenamed("tokens", "leaf_tokens"), "mix-leaves")

    def digest(epoch: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.col("mix_id")).cast("binary"))

    part = small.join(leaves.where("rest > 0"), own).select(*own, "rest", "tokens", digest(F.col("full_epochs")).alias("h"))
    plan = runtime.materialize(leaves.join(_ends(part, own), own, "left"), "mix-plan")  # one row per leaf

    out = keyed.join(plan, own).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full_epochs").cast("int"))))
    out = out.withColumn("h", digest(F.col("epoch"))).where((F.col("epoch") < F.col("full_epochs")) | (F.col("h") <= F.col("last_h")))
    cut = (F.col("epoch") == F.col("full_epochs")) & (F.col("h") == F.col("last_h"))
    take = F.when(cut, F.least("tokens", F.col("rest") - F.col("last_before"))).otherwise(F.col("tokens"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[c.alias(n) for c, n in zip((F.col("epoch"), F.col("tokens"), take), added, strict=True)])


def mix_documents(docs: DataFrame, domain: str = "domain") -> DataFrame:
    """The production mixture; ``domain``: a free name for the column of that level."""
    return mix(docs.withColumn(domain, domain_of(F.col("source"))), [domain, *LEVELS[1:]], WEIGHTS)


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix_documents(docs).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens")


def _case(col: str, weights: Mapping[Any, float], default: str = "1.0") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in weights.items()) + f" ELSE {default} END"


def _oracle() -> str:
    """The same rows from DuckDB."""
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + f" ELSE '{OTHER_DOMAIN}' END"
    ctes = [f"d AS (SELECT doc_id, {domain} AS domain, lang, source, coalesce(lang, '') AS k_lang, coalesce(source, '') AS k_source, {domain} AS k_domain, "
            f"coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS tokens FROM documents)",
            f"leaves AS (SELECT k_domain, k_lang, k_source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL)",
            f"b0 AS (SELECT least(floor(sum(tokens) * {BUDGET_SHARE}), sum(cap)) AS budget FROM leaves)"]
    for i, c in enumerate(LEVELS):
        path = [f"k_{x}" for x in LEVELS[: i + 1]]
        p, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
        using = f"JOIN b{i} USING ({', '.join(path[:-1])})" if i else "CROSS JOIN b0"
        ctes += [f"n{i} AS (SELECT n.*, budget FROM (SELECT {p}, sum(cap) AS cap, {_case(path[-1], WEIGHTS[i])} AS w FROM leaves GROUP BY {p}) n {using})",
                 f"o{i} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, w, cap, {p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before, "
                 f"sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, w, cap, {p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM n{i} WHERE w > 0 AND cap > 0)",
                 f"f{i} AS (SELECT *, cap * w_left <= (budget - c_before) * w AS is_full FROM o{i})",
                 f"b{i + 1} AS (SELECT {p}, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {parent}), 0)) * w / sum(w) FILTER (NOT is_full) OVER (PARTITION BY {parent}) END AS budget FROM f{i})"]
    key = ", ".join(f"k_{c}" for c in LEVELS)
    ctes += [f"a AS (SELECT {key}, tokens AS leaf_tokens, floor(budget + 1e-6)::BIGINT AS alloc FROM leaves JOIN b{len(LEVELS)} USING ({key}))",
             f"e AS (SELECT *, least(alloc // leaf_tokens, {MAX_EPOCHS}) AS full_epochs, alloc - least(alloc // leaf_tokens, {MAX_EPOCHS}) * leaf_tokens AS rest FROM a)",
             f"r AS (SELECT d.*, epoch, full_epochs, rest, md5(concat('{SEED}', '|', epoch, '|', coalesce(doc_id::VARCHAR, ''))) AS h FROM d JOIN e USING ({key}), LATERAL unnest(range(0, full_epochs + 1)) AS u(epoch))",
             f"s AS (SELECT *, sum(tokens) OVER (PARTITION BY {key}, epoch ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY {key}, epoch, h) AS before FROM r)"]
    return "WITH " + ",\n".join(ctes) + ("\nSELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, tokens::BIGINT AS tokens, CASE WHEN epoch < full_epochs THEN tokens ELSE least(tokens, rest - before) END::BIGINT AS take_tokens "
                                         "FROM s WHERE epoch < full_epochs OR before < rest")


ORACLE = _oracle()
