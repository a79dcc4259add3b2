"""Scale helpers shared by the operators.

* ``settle`` — write to the shared folder and read back.
* ``ordered_scan`` / ``ordered_fill`` — running sum, or nearest value before and
  after, over an order restarted per key.  The rows are written once in ranges
  of (key, whole order), a window runs inside each (key, range), and what
  earlier ranges carry over comes from a table with one row per (key, range).
  No key lands in one task, the input runs once, and re-run tasks see the same
  ranges.  Callers pass narrow rows and join back.
* ``global_rank`` — 1-based row number over a total order (ordered_scan of 1).
* ``hash_parts`` — exact cuts of a hash order from counts by hash prefix; only
  the rows of the prefixes that a cut falls into are ranked.
* ``bucketed_range_join`` — equi join on (key, block width, block) plus an exact
  residual; an interval is at most two rows, hot files spread over many blocks.
* ``bucket_sweep`` — every threshold of a grid in one pass: bucket each score
  once, count (bucket, label), suffix-sum the tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path

_B = "_q_bucket"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; keeps the left keys."""
    other = right.select(*[F.col(c).alias(f"_q_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(other[f"_q_r_{k}"]) for k in keys]
    return left.join(other, cond, how).drop(*[f"_q_r_{k}" for k in keys])


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: what the plan reads more than once, or what
    must be the same in every read, is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None) -> DataFrame:
    """``df`` in ranges of (keys, order), written once, with the number of each row's range.

    Spark samples the bounds over all the columns, so rows that are equal in the first ones
    are split by the next; a hot key covers many ranges, small keys share one.  The bounds are
    those of the one write, so all later reads agree on them."""
    n = int(buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return settle(df.repartitionByRange(n, *keys, *order).withColumn(_B, F.spark_partition_id()), "ordered")


def ordered_scan(
    df: DataFrame,
    order_cols: Sequence[str],
    value_col: str | Sequence[str] | None = None,
    partition_cols: Sequence[str] = (),
    out_col: str | Sequence[str] = "_cum",
    inclusive: bool = True,
    num_partitions: int | None = None,
    total_col: str | None = None,
) -> DataFrame:
    """Running sum of one or more columns (of 1 without ``value_col``).

    ``order_cols`` must make the order total inside each partition key; keys and
    order values may be null.  Values are cast to long, null counts as 0;
    ``inclusive=False`` leaves the row's own value out.  Result: ``df`` plus
    ``out_col``.  ``num_partitions`` is the number of buckets a key is split into;
    ``total_col`` adds the first column's sum over the whole key.
    """
    keys, order = [*partition_cols, _B], list(order_cols)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    cols = [value_col] if value_col is None or isinstance(value_col, str) else list(value_col)
    b = _bucketed(df, partition_cols, order, num_partitions)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = b
    values = [F.coalesce(F.col(c).cast("long"), F.lit(0)) if c else F.lit(1).cast("long") for c in cols]
    for v, o in zip(values, outs):
        scanned = scanned.withColumn(o, F.sum(v).over(w))
    # the last running sum of a bucket is its total; the exchange under it is reused
    last = F.struct(*order)
    totals = scanned.groupBy(*keys).agg(*[F.max_by(o, last).alias(f"_q_t{i}") for i, o in enumerate(outs)])
    before = Window.partitionBy(*(partition_cols or [F.lit(0)])).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    whole_key = Window.partitionBy(*(partition_cols or [F.lit(0)]))
    carry = totals.select(*keys, *[F.sum(f"_q_t{i}").over(before).alias(f"_q_c{i}") for i in range(len(outs))],
                          *([F.sum("_q_t0").over(whole_key).alias(total_col)] if total_col else []))
    j = join_null_safe(scanned, carry, keys)
    for i, (v, o) in enumerate(zip(values, outs)):
        whole = F.col(o) + F.coalesce(F.col(f"_q_c{i}"), F.lit(0))
        j = j.withColumn(o, whole if inclusive else whole - v)
    return j.drop(_B, *[f"_q_c{i}" for i in range(len(outs))])


def global_rank(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (), out_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based row number over a total order (optionally restarted per key)."""
    return ordered_scan(df, order_cols, None, partition_cols, out_col, True, num_partitions)


def ordered_fill(df: DataFrame, order_cols: Sequence[str], value_col: str, partition_cols: Sequence[str] = (),
                 prev_col: str = "_prev", next_col: str = "_next", num_partitions: int | None = None) -> DataFrame:
    """Last non-null value at or before each row (``prev_col``) and first
    non-null at or after it (``next_col``), per key."""
    keys, order = [*partition_cols, _B], list(order_cols)
    b = _bucketed(df, partition_cols, order, num_partitions)
    w = Window.partitionBy(*keys)
    # the next value is the last one in falling order: a frame that reaches to the end is evaluated anew for every row
    up, down = w.orderBy(*order), w.orderBy(*[F.desc(c) for c in order])
    so_far = (Window.unboundedPreceding, 0)
    scanned = (b.withColumn(prev_col, F.last(value_col, ignorenulls=True).over(up.rowsBetween(*so_far)))
               .withColumn(next_col, F.last(value_col, ignorenulls=True).over(down.rowsBetween(*so_far))))
    at = F.struct(*order)
    ends = scanned.groupBy(*keys).agg(F.max_by(prev_col, at).alias("_q_last"), F.min_by(next_col, at).alias("_q_first"))
    by = Window.partitionBy(*(partition_cols or [F.lit(0)]))
    others = (Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, F.last("_q_last", ignorenulls=True).over(by.orderBy(_B).rowsBetween(*others)).alias("_q_p"),
        F.last("_q_first", ignorenulls=True).over(by.orderBy(F.desc(_B)).rowsBetween(*others)).alias("_q_n"))
    j = join_null_safe(scanned, carry, keys)
    return (j.withColumn(prev_col, F.coalesce(prev_col, "_q_p")).withColumn(next_col, F.coalesce(next_col, "_q_n"))
            .drop(_B, "_q_p", "_q_n"))


def hash_parts(df: DataFrame, strata: Sequence[str], digest: str, key: str, cuts, out_col: str = "_part") -> DataFrame:
    """Number of cuts below each row's rank in its stratum, ranked by (digest, key).

    ``digest`` is a lower-case hex column; ``cuts(n)`` gives the cut ranks (rank >
    cut counts) as columns, ascending, from the stratum size column ``n``.  Counts
    by the first three digits decide every row whose prefix holds no cut; only
    the prefixes that a cut falls into (1/4096 of a stratum each) are ranked."""
    strata, pre = list(strata), "_q_pre"
    d = df.withColumn(pre, F.substring(digest, 1, 3))
    counts = d.groupBy(*strata, pre).agg(F.count(F.lit(1)).alias("_q_n"))
    whole = Window.partitionBy(*(strata or [F.lit(0)]))  # at most 4,096 rows a stratum
    counts = counts.select(
        *strata, pre, "_q_n", F.sum("_q_n").over(whole).alias("_q_size"),
        F.coalesce(F.sum("_q_n").over(whole.orderBy(pre).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_q_lo"))
    at = cuts(F.col("_q_size"))
    hi = F.col("_q_lo") + F.col("_q_n")
    edge = F.lit(False)
    for c in at:
        edge = edge | ((F.col("_q_lo") < c) & (c < hi))
    below = lambda rank, strict: sum(((rank > c if strict else rank >= c).cast("int") for c in at), F.lit(0))
    j = join_null_safe(d, counts.withColumn("_q_edge", edge), [*strata, pre], "inner")
    clear = j.filter(~F.col("_q_edge")).withColumn(out_col, below(F.col("_q_lo"), False))
    rank = F.col("_q_lo") + F.row_number().over(Window.partitionBy(*strata, pre).orderBy(digest, key))
    split = j.filter("_q_edge").withColumn("_q_rank", rank).withColumn(out_col, below(F.col("_q_rank"), True)).drop("_q_rank")
    return clear.unionByName(split).drop(pre, "_q_n", "_q_size", "_q_lo", "_q_edge")


#: Growth of the block widths of ``bucketed_range_join``, and their number.
_GROWTH, _WIDTHS = 16, 8


def _widths(bucket: int) -> list[int]:
    return [bucket * _GROWTH**i for i in range(_WIDTHS)]


def _block(col: str, width: Column) -> Column:
    """Number of the block that a place falls into, also under 0."""
    return ((F.col(col) - F.pmod(F.col(col), width)) / width).cast("long")


def _blocks(intervals: DataFrame, start_col: str, end_col: str, bucket: int) -> DataFrame:
    """A row for each block that an interval stands in (_q_w: its width, _q_b)."""
    length = F.col(end_col) - F.col(start_col) + 1
    widths = _widths(bucket)
    width = F.coalesce(*[F.when(length <= w, F.lit(w)) for w in widths], F.lit(widths[-1])).cast("long")
    iv = intervals.filter(length > 0).withColumn("_q_w", width)
    return iv.withColumn("_q_b", F.explode(F.sequence(_block(start_col, F.col("_q_w")), _block(end_col, F.col("_q_w")))))


def bucketed_range_join(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    point_col: str,
    start_col: str,
    end_col: str,
    bucket: int = 256,
) -> DataFrame:
    """Join points to intervals with start <= point <= end on ``key``.

    The line is cut into blocks of eight widths, ``bucket`` and 16 times more each time.
    An interval stands in the blocks of the first width that is not under its length, two at
    most, however long it is; a point asks its block of every width.  The equi key is (key,
    width, block), so a hot file is spread over many tasks.  An interval longer than the
    widest block stands in as many of them as it covers.
    """
    iv = _blocks(intervals, start_col, end_col, bucket)
    places = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), _block(point_col, F.lit(w)).alias("b")) for w in _widths(bucket)])
    pt = points.withColumn("_q_p", F.explode(places)).withColumn("_q_w", F.col("_q_p.w")).withColumn("_q_b", F.col("_q_p.b")).drop("_q_p")
    cond = [pt[key] == iv[key], pt["_q_w"] == iv["_q_w"], pt["_q_b"] == iv["_q_b"],
            pt[point_col] >= iv[start_col], pt[point_col] <= iv[end_col]]
    return pt.join(iv, cond).drop(iv[key]).drop("_q_w", "_q_b")


def grid_bucket(score: Column, grid: Sequence[float], inclusive: bool = True) -> Column:
    """Number of grid thresholds passed by ``score`` (>= if inclusive else >)."""
    arr = F.array(*[F.lit(float(t)) for t in grid])
    if inclusive:
        return F.size(F.filter(arr, lambda t: t <= score))
    return F.size(F.filter(arr, lambda t: t < score))


def bucket_sweep(
    scored: DataFrame,
    grid: Sequence[float],
    score_col: str = "score",
    label_col: str = "label",
    inclusive: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts at every grid threshold in one pass over the rows.

    Each row is bucketed once (number of thresholds it passes); the
    (key, bucket, label) counts are tiny, so suffix sums over them give every
    threshold without re-scanning.  Returns (by..., threshold, tp, fp, fn, tn).
    """
    by = list(by)
    counts = (
        scored.select(*by, grid_bucket(F.col(score_col), grid, inclusive).alias("_b"),
                      F.col(label_col).cast("int").alias("_l"))
        .groupBy(*by, "_b")
        .agg(F.count_if(F.col("_l") == 1).alias("_pos"), F.count_if(F.col("_l") != 1).alias("_neg"))
    )
    # bucket b passes thresholds 1..b
    contrib = (
        counts.filter(F.col("_b") >= 1)
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_b"))))
        .groupBy(*by, "_j")
        .agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    )
    grid_arr = F.array(*[F.lit(float(t)) for t in grid])
    frame = (
        counts.groupBy(*by)
        .agg(F.sum("_pos").cast("long").alias("_P"), F.sum("_neg").cast("long").alias("_N"))
        .select(*by, "_P", "_N", F.posexplode(grid_arr).alias("_p0", "threshold"))
        .withColumn("_j", F.col("_p0") + 1)
    )
    out = frame.join(contrib, on=[*by, "_j"], how="left")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("long")
    fp = F.coalesce(F.col("fp"), F.lit(0)).cast("long")
    return out.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"),
                      (F.col("_P") - tp).alias("fn"), (F.col("_N") - fp).alias("tn"))
