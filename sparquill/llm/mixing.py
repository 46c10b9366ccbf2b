"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. A source's share of a budget is filled with its
documents in the order of their hashes, as long as their tokens fit. That order is never
produced: tokens are summed by source and hash bucket, prefix sums over the buckets find the
one in which the share is used up, and only the documents in that boundary bucket are split
further, until single hash values remain. What results is a threshold for each source and
budget; a filter on the hash then takes the documents. Smaller budgets have lower thresholds,
so their documents are among those of the larger ones.

The full mix has SHARE of the tokens of the weighted sources. Each gives its weight's part of it; one
that has less gives all it has, and the others fill up by their weights, so that no small source
shrinks the mix. By default a source weighs the TEMPERATURE-th power of its tokens: large sources
stay the largest, small ones count for more than their size. Budgets are fractions of the full mix.

Defined results: given weights are those of the sources that occur; a source with no weight takes no
part. An empty table gives an empty mix. Very long texts count like any. Columns of any name pass
through; ``out`` may not be one of them. A null source is a source of its own, weighted under None. Rows with equal ids have equal
hashes and are taken or left together; so are those whose id is null. A null text has 0 tokens.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import col, fresh, written
from sparquill.sources import table

HASH_BITS = 60
#: Bits of the hash by which each step splits: the whole corpus first, then the boundary buckets alone.
LEVELS = (12, 24, 24)
BUDGETS = (0.25, 0.5, 1.0)
#: Of all tokens, those in the full mix, and the power of a source's tokens that is its weight.
SHARE = 0.8
TEMPERATURE = 0.7
#: Thresholds are broadcast up to this many rows, about 10 MB; beyond it Catalyst chooses the join.
MAX_BROADCAST_ROWS = 100_000


def id_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Tokens of a text: its pieces between spaces and line ends, 0 for null."""
    blanks = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) > 0, blanks + 1).otherwise(0).cast("long")


def _weights(totals: DataFrame, weights: Mapping | None) -> DataFrame:
    """(source, tokens, weight) of the sources of totals that have a weight."""
    if weights is None:
        return totals.withColumn("weight", F.pow(F.col("tokens").cast("double"), TEMPERATURE)).where("weight > 0")
    kind = totals.schema["source"].dataType.simpleString()
    asked = totals.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
    asked = asked.withColumn("name", F.col("name").cast(kind))
    return totals.join(asked, F.col("source").eqNullSafe(F.col("name"))).drop("name").where("weight > 0 AND tokens > 0")


def levels(given: DataFrame, budgets: Sequence[float], share: float = SHARE) -> dict[float, float]:
    """For each budget the tokens a unit of weight at which sources give budget * share of all tokens.

    Sources with less than that give all they have. Each step closes those that are short at the level so far; as the
    level only rises, few steps settle it, and each is one sum over a row a source.
    """
    total = (given.agg(F.sum("tokens")).first()[0] or 0) * share
    level = {b: 0.0 for b in sorted(set(map(float, budgets)))}
    while total:
        sums = []
        for i, (b, x) in enumerate(level.items()):
            short = F.col("tokens") <= F.lit(x) * F.col("weight")
            sums += [F.sum(F.when(short, F.col("tokens"))).alias(f"t{i}"), F.sum(F.when(~short, F.col("weight"))).alias(f"w{i}")]
        row = given.agg(*sums).first()
        new = {b: (b * total - (row[f"t{i}"] or 0)) / row[f"w{i}"] if row[f"w{i}"] else x for i, (b, x) in enumerate(level.items())}
        if all(abs(new[b] - level[b]) <= 1e-12 * abs(new[b]) for b in new):
            break
        level = new
    return level


def thresholds(docs: DataFrame, weights: Mapping | None = None, budgets: Sequence[float] = BUDGETS, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """(source, budget, below): the documents of source with a hash under ``below`` fill its share of budget."""
    tokens = words(col("text")) if tokens is None else tokens
    rows = docs.select(col(source_col).alias("source"), id_hash(col(id_col)).alias("h"), tokens.alias("tokens"))
    shift = HASH_BITS - LEVELS[0]
    hist = written(rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("tokens")), "mix-histogram")
    totals = written(_weights(hist.groupBy("source").agg(F.sum("tokens").alias("tokens")), weights), "mix-totals")
    level = F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.lit(x).alias("level")) for b, x in levels(totals, budgets).items())))
    # left: what of the share is still free; at: the lowest hash not yet decided
    open_ = totals.select("source", "tokens", "weight", level.alias("x")).select("source", "x.budget", F.floor(F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("x.level")) + 1e-6).alias("left"), F.lit(0).cast("long").alias("at"))
    width = HASH_BITS
    by = Window.partitionBy("source", "budget").orderBy("b")
    for level, bits in enumerate(LEVELS):
        width -= bits
        same = F.col("source").eqNullSafe(F.col("_s"))
        if level:
            # The boundary buckets alone: a small share of the hashes, the same for all later levels.
            if level == 1:
                edge = open_.select(F.col("source").alias("_s"), F.shiftright("at", shift).alias("_b")).distinct()
                edge = F.broadcast(edge) if edge.count() <= MAX_BROADCAST_ROWS else edge
                rows = written(rows.join(edge, same & (F.shiftright("h", shift) == F.col("_b")), "left_semi"), "mix-boundary")
            hist = rows.groupBy("source", F.shiftright("h", width).alias("b")).agg(F.sum("tokens").alias("tokens"))
        start = F.shiftright("at", width)
        part = hist.withColumnRenamed("source", "_s").join(open_, same & (F.col("b") >= start) & (F.col("b") < start + F.lit(1 << bits)))
        part = part.withColumn("sum", F.sum("tokens").over(by))
        full = part.where(F.col("sum") > F.col("left")).groupBy("source", "budget").agg(F.min(F.struct("b", (F.col("left") - F.col("sum") + F.col("tokens")).alias("left"))).alias("x"))
        # A source whose buckets all fit takes everything of the interval.
        found = full.select(F.col("source").alias("_s"), F.col("budget").alias("_g"), F.shiftleft("x.b", width).alias("_at"), F.col("x.left").alias("_left"))
        end = F.col("at") + F.lit(1 << (width + bits)) if level else F.lit(1 << HASH_BITS)
        open_ = open_.join(found, same & (F.col("budget") == F.col("_g")), "left").select("source", "budget", F.coalesce("_left", F.lit(0)).alias("left"), F.coalesce("_at", end).alias("at"))
        open_ = written(open_, f"mix-level{level}")
    return open_.select("source", "budget", F.col("at").alias("below"))


def mix(docs: DataFrame, weights: Mapping | None = None, budgets: Sequence[float] = BUDGETS, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, out: str | None = None) -> DataFrame:
    """The documents of the largest budget; with out, the smallest budget that takes each in a column of that name."""
    if out and fresh(docs, out) != out:
        raise ValueError(f"docs has a column {out}")
    found = thresholds(docs, weights, budgets, id_col, source_col, tokens)
    s, g = fresh(docs, "_mix_source"), fresh(docs, "_mix_budgets")
    per = found.groupBy(F.col("source").alias(s)).agg(F.array_sort(F.collect_list(F.struct("below", "budget"))).alias(g))
    per = written(per, "mix-thresholds")
    per = F.broadcast(per) if per.count() <= MAX_BROADCAST_ROWS else per
    h = id_hash(col(id_col))
    fits = F.filter(col(g), lambda x: h < x["below"])
    taken = docs.join(per, col(source_col).eqNullSafe(col(s))).where(h < F.array_max(F.transform(col(g), lambda x: x["below"])))
    columns = [col(c) for c in docs.columns]
    return taken.select(*columns, F.array_min(F.transform(fits, lambda x: x["budget"])).alias(out)) if out else taken.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, out="budget").select("doc_id", "source", "budget")


_H = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
SQL_WORDS = "(CASE WHEN length(text) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END)"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, {_H} AS h, {SQL_WORDS} AS tokens FROM documents
), totals AS (
  SELECT source, sum(tokens)::BIGINT AS tokens, pow(sum(tokens)::DOUBLE, {TEMPERATURE}) AS weight FROM d GROUP BY source HAVING sum(tokens) > 0
), budgets AS (
  SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS budget
), steps AS (
  SELECT budget, source, tokens, weight, (budget * {SHARE} * sum(tokens) OVER (PARTITION BY budget) - coalesce(sum(tokens) OVER (PARTITION BY budget ORDER BY tokens / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY budget ORDER BY tokens / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals, budgets
), level AS (
  SELECT budget, max(level) AS level FROM steps WHERE level * weight < tokens GROUP BY budget
), shares AS (
  SELECT s.source, s.budget, floor(least(s.tokens::DOUBLE, coalesce(s.weight * l.level, s.tokens)) + 1e-6) AS share FROM steps s LEFT JOIN level l USING (budget)
), sums AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d
)
SELECT doc_id, sums.source, min(budget)::DOUBLE AS budget
FROM sums JOIN shares ON sums.source IS NOT DISTINCT FROM shares.source
WHERE upto <= share
GROUP BY doc_id, sums.source
"""
