"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain - language - source tree. At every node it is shared among
the children by weight, but no child gets more than its subtree holds in ``MAX_EPOCHS`` epochs;
what one child cannot take goes to its siblings first, and only what all siblings cannot take is
missing at their parent, whose own siblings then take it (capacities are summed bottom-up, so the
top-down shares already know them). The level of each water-fill has a closed form over the
children sorted by capacity per weight, so the whole plan is window functions over the leaves.

A leaf with budget b and t tokens gives b div t whole epochs and then a prefix of the next one:
documents in the order of md5(seed/epoch/doc_id), doc_id, as long as the running sum of tokens
stays within the rest. The cut is found without a window over a whole leaf: 4096 hash buckets
per leaf are summed, and only the bucket that holds the cut is sorted.

Tokens are those of a column that the caller counts (``tokens``); without one they are estimated by
script, ceil(dense characters / 1.5 + others / 4). The tables at hand name no domain, so the default
``domain_of`` makes one of a source's number; any other column expression can stand in for it.

Defined cases: a document without tokens (a null or empty text, or none counted) is not selected; a
null language or source counts as the leaf named ``none``, a source without a number as domain
``misc``; a null doc_id sorts as -1 within its leaf; rows that repeat a doc_id in one leaf stand or
fall together at the cut; texts of any length count whole; an unknown name has weight 1 and a weight
of 0 excludes; an empty table gives an empty result. The caller's columns travel inside one struct,
so they are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import DENSE_RANGES, count_dense
from lectern.llm._small import small

SEED, MAX_EPOCHS, SHARE = 7, 3, 1.0
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("d"), (number % 3).cast("string")), F.lit("misc"))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(int(v))).otherwise(out)
    return out.cast("bigint")


def estimated_tokens(text: Column) -> Column:
    """ceil(dense / 1.5 + others / 4) in whole numbers; 0 for a null text."""
    dense, size = count_dense(text), F.length(text)
    return F.coalesce(F.floor((F.lit(5) * dense + F.lit(3) * size + 11) / 12), F.lit(0)).cast("bigint")


def with_leaf(docs: DataFrame, tokens: str | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(row, domain, lang, source, tokens, id): ``docs`` packed into ``row`` beside its leaf; ``tokens`` names a column that holds their number."""
    source = docs["source"].cast("string")
    number = estimated_tokens(docs["text"].cast("string")) if tokens is None else F.coalesce(docs[tokens].cast("bigint"), F.lit(0))
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), domain(source).alias("domain"), F.coalesce(docs["lang"].cast("string"), F.lit("none")).alias("lang"),
        F.coalesce(source, F.lit("none")).alias("source"), number.alias("tokens"), F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1)).alias("id"),
    )


def _fill(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Water-fill: ``nodes`` has parent columns, name, cap and budget of the parent; budget becomes its own."""
    w = _weight(F.col(name), weights)
    nodes = nodes.withColumn("w", w).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    nodes = nodes.withColumn("r", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(0.0))
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("r", name).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0))
    level = F.when(left > 0, (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0)).cast("double")) / left.cast("double"))
    nodes = nodes.withColumn("level", level)
    nodes = nodes.withColumn("level", F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(whole))
    share = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    return nodes.withColumn("budget", share).drop("w", "r", "level")


def leaf_plan(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] = SOURCE_WEIGHTS) -> DataFrame:
    """``leaves`` (level columns, tokens) with budget, epochs (whole ones) and rest (tokens of the next one)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    weights = (domain_weights, lang_weights, source_weights)
    nodes = total
    for depth, name in enumerate(LEVELS):
        own, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        caps = leaves.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = caps.join(nodes.select(*parent, "budget"), parent) if parent else caps.crossJoin(nodes)
        nodes = _fill(nodes, parent, name, weights[depth])
    nodes = nodes.withColumn("budget", F.floor("budget"))
    return nodes.select(*LEVELS, "tokens", "budget", F.expr("if(tokens > 0, budget div tokens, 0)").alias("epochs"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest"))


def _order(seed: int, epochs: str = "epochs") -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(epochs).cast("string"), F.col("id").cast("string")))


def plan(docs: DataFrame, seed: int = SEED, tokens: str | None = None, domain: Callable[[Column], Column] = domain_of, **budget) -> DataFrame:
    """Per leaf: epochs to take whole, and the last (hash, id) of the next epoch's prefix (null: none)."""
    slim = with_leaf(docs, tokens, domain).select(*LEVELS, "tokens", "id").where("tokens > 0").checkpoint()
    leaves = small(leaf_plan(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), **budget).checkpoint())
    hashed = slim.join(leaves.drop("tokens", "budget").where("rest > 0"), list(LEVELS)).withColumn("h", _order(seed)).withColumn("b", F.substring("h", 1, 3))
    leaf = Window.partitionBy(*LEVELS)
    sums = hashed.groupBy(*LEVELS, "b").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.max(F.struct("h", "id")).alias("top"))
    sums = sums.withColumn("upto", F.sum("t").over(leaf.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).checkpoint()
    whole = sums.where("upto <= rest").groupBy(*LEVELS).agg(F.max("top").alias("cut"))
    edge = sums.where("upto > rest and upto - t < rest").select(*LEVELS, "b", (F.col("upto") - F.col("t")).alias("before"))
    inside = hashed.join(small(edge.checkpoint()), [*LEVELS, "b"]).withColumn("run", F.col("before") + F.sum("tokens").over(leaf.orderBy("h", "id")))
    part = inside.where("run <= rest").groupBy(*LEVELS).agg(F.max(F.struct("h", "id")).alias("cut"))
    cuts = whole.unionByName(part).groupBy(*LEVELS).agg(F.max("cut").alias("cut"))
    return leaves.join(cuts, list(LEVELS), "left").select(*LEVELS, "epochs", "cut")


def take(docs: DataFrame, planned: DataFrame, seed: int = SEED, tokens: str | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(row, epoch, domain, lang, source, tokens): a row of ``docs`` for each copy that the plan takes.

    Where ``docs`` lacks the column of the counts that ``planned`` was made with, documents with a text are those with tokens.
    """
    rows = with_leaf(docs, tokens, domain).where("tokens > 0")
    chosen = small(planned.withColumnRenamed("epochs", "whole").checkpoint())
    rows = rows.join(chosen, list(LEVELS)).withColumn("h", _order(seed, "whole"))
    rows = rows.withColumn("copies", F.col("whole") + F.coalesce((F.struct("h", "id") <= F.col("cut")).cast("bigint"), F.lit(0))).where("copies > 0")
    return rows.select("row", F.explode(F.expr("sequence(0L, copies - 1)")).alias("epoch"), *LEVELS, "tokens")


def select_mix(docs: DataFrame, counted: DataFrame | None = None, tokens: str | None = None, seed: int = SEED, domain: Callable[[Column], Column] = domain_of, **budget) -> DataFrame:
    """The columns of ``docs``, a row for each copy. ``counted`` (doc_id, lang, source, ``tokens``) may stand in for ``docs`` in the plan, so that texts are counted once."""
    planned = plan(docs if counted is None else counted, seed, tokens, domain, **budget)
    return take(docs, planned, seed, tokens if counted is None else None, domain).select("row.*")


def report(docs: DataFrame, tokens: str | None = None, seed: int = SEED, domain: Callable[[Column], Column] = domain_of, **budget) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, tokens) of every copy taken."""
    slim = docs.select("doc_id", "lang", "source", tokens or "text")
    return take(slim, plan(slim, seed, tokens, domain, **budget), seed, tokens, domain).select("row.doc_id", "epoch", *LEVELS, "tokens")


def _sql_weight(name: str, weights: dict[str, int]) -> str:
    return "CASE " + "".join(f"WHEN {name} = '{k}' THEN {v} " for k, v in weights.items()) + "ELSE 1 END" if weights else "1"


def _sql_fill(cte: str, source: str, parent: list[str], name: str, weights: dict[str, int]) -> str:
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    upto = f"OVER ({part} ORDER BY r, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = ", ".join([*parent, name])
    return f"""
{cte}_a AS (SELECT *, CASE WHEN w > 0 THEN cap0 ELSE 0 END AS cap, CASE WHEN w > 0 THEN cap0::DOUBLE / w::DOUBLE ELSE 0 END AS r
  FROM (SELECT *, {_sql_weight(name, weights)} AS w FROM {source})),
{cte}_b AS (SELECT *, (sum(w) OVER ({part}) - coalesce(sum(w) {upto}, 0)) AS lft, (budget0 - coalesce(sum(cap) {upto}, 0)::DOUBLE) AS num FROM {cte}_a),
{cte}_c AS (SELECT *, CASE WHEN lft > 0 THEN num / lft::DOUBLE END AS lv FROM {cte}_b),
{cte}_d AS (SELECT *, max(CASE WHEN lv <= r THEN lv END) OVER ({part}) AS level FROM {cte}_c),
{cte} AS (SELECT {cols}, tokens, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS budget FROM {cte}_d)"""


_SQL_DENSE = "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in DENSE_RANGES) + "]"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) % 3), 'misc') AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce((5 * (length(text) - length(regexp_replace(text, '{_SQL_DENSE}', '', 'g'))) + 3 * length(text) + 11) // 12, 0) AS tokens, coalesce(doc_id, -1) AS id FROM documents),
s AS (SELECT * FROM d WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MAX_EPOCHS} AS cap0 FROM s GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens)::BIGINT AS tokens, sum(cap0)::BIGINT AS cap0, (SELECT sum(tokens)::DOUBLE * {SHARE} FROM s) AS budget0 FROM leaves GROUP BY domain),
{_sql_fill("f1", "n1", [], "domain", DOMAIN_WEIGHTS)},
n2 AS (SELECT l.domain, l.lang, sum(l.tokens)::BIGINT AS tokens, sum(cap0)::BIGINT AS cap0, any_value(f1.budget) AS budget0 FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, l.lang),
{_sql_fill("f2", "n2", ["domain"], "lang", LANG_WEIGHTS)},
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, cap0, f2.budget AS budget0 FROM leaves l JOIN f2 USING (domain, lang)),
{_sql_fill("f3", "n3", ["domain", "lang"], "source", SOURCE_WEIGHTS)},
p AS (SELECT domain, lang, source, floor(budget)::BIGINT // tokens AS epochs, floor(budget)::BIGINT % tokens AS rest FROM f3),
h AS (SELECT s.*, epochs, rest, md5('{SEED}/' || epochs || '/' || id) AS h FROM s JOIN p USING (domain, lang, source)),
c AS (SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM h)
SELECT doc_id, epoch, domain, lang, source, tokens FROM (SELECT *, unnest(range(copies)) AS epoch FROM c WHERE copies > 0)
"""
