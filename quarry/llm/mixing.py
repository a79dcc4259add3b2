"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source s gets a mean repetition rate ``weight_s * total / n_s``.  A document is
repeated Poisson(rate) times; the draw inverts the distribution at a uniform number
hashed from (seed, doc_id), so it is the same on every run and every partitioning.
The copies are dealt out by a hash of (seed, doc_id, copy) and sorted by it inside each
partition: a global shuffle in one exchange, with no hot source in any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle, table

#: A rate beyond this is drawn as a sum of independent draws, so exp(-rate) never underflows.
MAX_MEAN = 64.0


def uniform(seed: int, *parts: Column) -> Column:
    """(0, 1) from the first 48 bits of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, source: str = "source") -> DataFrame:
    """A row per source: n, weight, rate, and the cumulative Poisson distribution of
    ``rate / draws`` for its ``draws`` independent draws.

    Without ``weights`` the target weight is in proportion to n ** alpha.  With them,
    weights of the sources present are scaled to sum to 1; a source not named gets 0.
    Null is a source of its own (name it ``None``)."""
    counts = settle(docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        raw = F.lit(0.0)
        for k, v in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(raw)
    counts = counts.withColumn("raw", raw)
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("n").alias("n")).first()  # one row
    target = float(total if total is not None else sums["n"] or 0)
    rated = counts.withColumn("weight", F.col("raw") / F.lit(float(sums["raw"] or 1.0) or 1.0)).withColumn("rate", F.col("weight") * F.lit(target) / F.col("n"))
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_MEAN))).cast("int"))
    mean = F.col("rate") / F.col("draws")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    return rated.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["cdf"]).drop("raw")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` plus copy_no (1, 2, ...) and rate; a document may come 0 times.

    Rows alike in doc_id draw alike.  A null doc_id or source is a value of its own.  Extra
    columns pass through; an input column named copy_no or rate is replaced.  An empty
    table gives an empty table."""
    rates = settle(source_rates(docs, weights, alpha, total), "mix-rates").select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    # files of known size: the planner broadcasts them if small, else joins by shuffle
    j = docs.drop("copy_no", "rate").join(rates, F.col("source").eqNullSafe(F.col("__source")), "inner")
    draw = lambda i: F.size(F.filter("__cdf", lambda c: c < uniform(seed, F.col("doc_id"), i)))
    once = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__draws") - 1), F.lit(0), lambda s, i: s + draw(i))
    j = j.withColumn("__u", uniform(seed, F.col("doc_id"), F.lit(0)))
    j = j.withColumn("__n", once + F.when(F.col("__draws") > 1, more).otherwise(0)).filter("__n > 0")
    out = j.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long")))).withColumn("rate", F.round("__rate", 6))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy_no").cast("string")))
    return out.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key").drop("__source", "__rate", "__draws", "__cdf", "__u", "__n", "__key")


def op9_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Documents repeated towards weights in proportion to the square root of source size."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT sum(pow(n, 0.5)) AS raw, sum(n)::DOUBLE AS total FROM c),
r AS (SELECT source, pow(n, 0.5) / raw * total / n AS rate FROM c, s),
d AS (SELECT source, rate, greatest(1, ceil(rate / 64.0))::INT AS draws FROM r),
p AS (SELECT source, k, sum(exp(CASE WHEN k = 0 THEN 0 ELSE k * ln(rate / draws) END - rate / draws - lgamma(k + 1)))
        OVER (PARTITION BY source ORDER BY k) AS cdf FROM d, generate_series(0, 300) g(k)),
u AS (SELECT x.doc_id, x.text, x.lang, x.source, x.n_chars, d.rate, i,
        (('0x' || substr(md5('42|' || coalesce(x.doc_id::VARCHAR, 'null') || '|' || i), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
      FROM (SELECT *, row_number() OVER () AS rid FROM documents) x JOIN d ON x.source IS NOT DISTINCT FROM d.source, generate_series(0, 200) h(i) WHERE i < d.draws),
q AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf < u.u) AS k FROM u),
m AS (SELECT doc_id, text, lang, source, n_chars, rate, sum(k) AS n FROM q GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy_no, round(rate, 6) AS rate
FROM m, generate_series(1, 1000) e(copy_no) WHERE copy_no <= n
"""
