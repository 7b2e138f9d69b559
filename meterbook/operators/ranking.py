"""Order-based operators: ranks, running sums, nth occurrence, quantiles by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook.operators.keyed import keyed_join, summarise, with_totals
from meterbook.session import stage

_ROW_BITS = 33
#: Ranges of one round of a selection.
RADIX = 4096


def small_rank(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank of rows that are few per key by nature (days, months, models, activities)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))


def ordered_positions(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    rank: str = "rank",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Exact rank, and running sums ``{output: column}``, over a total order.

    No window spans more than one partition of a range-partitioned sort, so a
    key that holds a third of all rows is spread like any other.  The sorted rows
    are staged once, because the partition sizes and the rows have to come
    from the same partitioning.
    """
    sums = sums or {}
    keys = [F.col(k) for k in by]
    placed = stage(df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    tallies = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = tallies.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    # one row per sort task: safe to broadcast at any data size
    located = placed.join(F.broadcast(offsets), "_part")
    within = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    located = located.withColumn("_at", F.col("_rows_before") + within + 1)
    if sums:
        upto = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
        located = located.withColumns({f"_run_{n}": F.col(f"_before_{n}") + F.sum(c).over(upto) for n, c in sums.items()})
    if by:
        starts = located.groupBy(*by).agg(
            (F.min("_at") - 1).alias("_start"),
            *[F.min_by(F.col(f"_run_{n}") - F.col(c), "_at").alias(f"_base_{n}") for n, c in sums.items()],
        )
        located = keyed_join(located, starts, by)
    else:
        located = located.withColumns({"_start": F.lit(0), **{f"_base_{n}": F.lit(0) for n in sums}})
    out = {rank: F.col("_at") - F.col("_start")}
    out.update({n: F.col(f"_run_{n}") - F.col(f"_base_{n}") for n in sums})
    return located.withColumns(out).select(*df.columns, *out)


def occurrence_number(
    df: DataFrame, key: str, order: str, block: int = 65536, name: str = "occurrence"
) -> DataFrame:
    """Which copy of ``key`` a row is, counted from 0 in the order of ``order``.

    ``order`` is a non-negative integer, unique within a key.  Rows are numbered
    inside blocks of the order, and blocks carry the counts before them, so
    a key with a huge number of copies is numbered by many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    within = W.partitionBy(key, "_block").orderBy(order)
    numbered = blocked.withColumn("_within", F.row_number().over(within) - 1)
    tallies = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # only keys that reach a second block have an offset to add
    offsets = tallies.withColumn("_before", F.sum("_rows").over(earlier)).where("_before IS NOT NULL").drop("_rows")
    joined = numbered.join(offsets, [key, "_block"], "left")
    number = (F.col("_within") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint")
    return joined.withColumn(name, number).drop("_block", "_within", "_before")


def rank_quantiles(
    ranked: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Linear-interpolation quantiles of rows already ranked by ``value`` descending.

    Only the rows next to each cut point are read off, so no task holds all values.
    Output: one ``p<percent>`` column per probability.
    """
    sizes = summarise(ranked, by, _n=F.count(F.lit(1)))
    rows = with_totals(ranked.select(*by, rank, F.col(value).cast("double").alias("_v")), sizes, by)
    ascending = F.col("_n") - F.col(rank)
    aggregates = {}
    for p in probabilities:
        index = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(index), F.ceil(index)
        name = quantile_name(p)
        aggregates[f"{name}_low"] = F.max(F.when(ascending == low, F.col("_v")))
        aggregates[f"{name}_high"] = F.max(F.when(ascending == high, F.col("_v")))
        aggregates[f"{name}_part"] = F.max(index - low)
    cuts = summarise(rows, by, **aggregates)
    picked = []
    for p in probabilities:
        n = quantile_name(p)
        low, high, part = (F.col(f"{n}_{x}") for x in ("low", "high", "part"))
        picked.append((low + (high - low) * part).alias(n))
    return cuts.select(*by, *picked)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Linear-interpolation quantiles of amounts of ``digits`` decimal places, by radix selection on counts.

    Each round counts the rows of ``RADIX`` equal ranges between the bounds of every
    wanted rank and keeps the range that holds the rank, until ranges are one unit
    wide.  Rows are read once a round and combined on the map side; neither a
    sort nor a task sees all of them.  Output: one ``p<percent>`` column per probability.
    """
    unit = 10**digits
    rows = stage(df.where(F.col(value).isNotNull()).select(*by, F.round(F.col(value).cast("double") * unit).cast("bigint").alias("_v")))
    bounds = summarise(rows, by, _n=F.count(F.lit(1)), _low=F.min("_v"), _high=F.max("_v"))
    ranks = []
    for p in probabilities:
        index = (F.col("_n") - 1) * F.lit(float(p))
        for side, end in (("low", F.floor(index)), ("high", F.ceil(index))):
            ranks.append(F.struct(F.lit(f"{quantile_name(p)}_{side}").alias("name"), end.cast("bigint").alias("left"), (index - F.floor(index)).alias("part")))
    widest = bounds.agg(F.max(F.col("_high") - F.col("_low") + 1)).first()[0]  # one number
    found = bounds.where("_n > 0").select(*by, F.inline(F.array(*ranks)), "_low", F.lit(widest or 1).cast("bigint").alias("_width"))
    width = widest or 1
    while width > 1:
        step = -(-width // RADIX)
        found = _narrowed(rows, found, step, by)
        width = step
    picked = []
    for p in probabilities:
        low, high, part = (F.max(F.when(F.col("name") == f"{quantile_name(p)}_{side}", F.col(c))) for side, c in (("low", "_low"), ("high", "_low"), ("low", "part")))
        low, high = low.cast("double") / unit, high.cast("double") / unit
        picked.append((low + (high - low) * part).alias(quantile_name(p)))
    return found.groupBy(*by).agg(*picked) if by else found.agg(*picked)


def _narrowed(rows: DataFrame, found: DataFrame, step: int, by: Sequence[str]) -> DataFrame:
    """Wanted ranks (name, left: rows before it, from ``_low`` on) with the range of ``step`` values that holds them."""
    wanted = found.select(*by, "_low", "_width").distinct()
    # a key has a few ranges at a time, those of its quantiles
    packed = summarise(wanted, by, _ranges=F.collect_set(F.struct("_low", "_width")))
    near = with_totals(rows, packed, by).select(*by, "_v", F.explode("_ranges").alias("_range"))
    inside = near.where((F.col("_v") >= F.col("_range._low")) & (F.col("_v") < F.col("_range._low") + F.col("_range._width")))
    part = F.floor((F.col("_v") - F.col("_range._low")) / F.lit(step)).cast("bigint")
    counted = inside.groupBy(*by, F.col("_range._low").alias("_low"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # RADIX entries at most
    tables = counted.groupBy(*by, "_low").agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_parts"))
    joined = keyed_join(found, tables, [*by, "_low"])
    empty = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("part"))

    def walk(acc: Column, x: Column) -> Column:
        here = acc["part"].isNull() & (F.col("left") < acc["before"] + x["_n"])
        return F.struct(
            F.when(acc["part"].isNull() & ~here, acc["before"] + x["_n"]).otherwise(acc["before"]).alias("before"),
            F.when(here, x["_part"]).otherwise(acc["part"]).alias("part"),
        )

    placed = joined.withColumn("_found", F.aggregate("_parts", empty, walk))
    return placed.select(
        *by, "name", (F.col("left") - F.col("_found.before")).alias("left"), "part", (F.col("_low") + F.col("_found.part") * step).alias("_low"), F.lit(step).cast("bigint").alias("_width")
    )


def quantile_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def small_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same quantiles over rows that are few per key (days), in one aggregate."""
    return summarise(
        df, by, **{quantile_name(p): F.percentile(F.col(value).cast("double"), F.lit(float(p))) for p in probabilities}
    )


def top_share(ranked: DataFrame, value: str, ks: Sequence[int], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Sum of the first k ranked rows over the sum of all rows, for each k."""
    whole = F.sum(F.col(value))
    return summarise(
        ranked,
        by,
        **{
            f"top_{k}_share": F.try_divide(
                F.sum(F.when(F.col(rank) <= k, F.col(value))).cast("double"), whole.cast("double")
            )
            for k in ks
        },
    )


def first_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Report head: the first k rows of an order, found without a full sort."""
    return df.orderBy(*order).limit(k)
