"""Running totals, ranks and exact quantiles that do not put a whole column into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.session import cut_lineage, stage

ONE_TASK_ROWS = 5_000_000
#: Groups whose statistics are broadcast to the rows at most.
BROADCAST_GROUPS = 100_000
#: Steps of the binary search: up to 2^17 - 1 cuts.
STEPS = [1 << i for i in range(16, -1, -1)]
#: Values that are left in a bracket when they are gathered and sorted.
SMALL = 20_000
#: Cuts of a bracket in one round of narrowing, and the accuracy of their sketch.
GRID, GRID_ACCURACY = 500, 10_000


def bin_index(cuts: Column, x: Column) -> Column:
    """How many of the sorted ``cuts`` are at or below ``x``: a binary search with a fixed number of steps."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in STEPS]), F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= x, at + step).otherwise(at),
    )


def hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def measured(df: DataFrame, label: str) -> DataFrame:
    """``df`` (one row per group), written once, and marked for a broadcast if it has at most ``BROADCAST_GROUPS`` rows."""
    df = stage(df, label)
    return hinted(df, df.count() <= BROADCAST_GROUPS)


def choose_bins(rows: int, one_task_rows: int = ONE_TASK_ROWS) -> int:
    return max(1, -(-rows // one_task_rows))


def cumulative(steps: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], bins: int = 1,
               following: str | None = None) -> DataFrame:
    """Add ``{w}_cum``: the total of ``w`` over rows of the same ``keys`` with a value at or below this one.

    ``steps`` has one row per (keys, value), so a value that repeats a billion times is one row here.
    With ``bins > 1`` the rows are dealt by range of (keys, value) into so many parts and written once, so that all
    passes see the same parts: each part is one small window per key, and the totals of the parts before it are added.
    ``following`` names a column for the next larger value of the same keys.
    """
    by = [col(k) for k in keys]
    if bins <= 1:
        ordered = Window.partitionBy(*by).orderBy(col(value))
        run = ordered.rowsBetween(Window.unboundedPreceding, 0)
        out = {f"{c}_cum": F.sum(c).over(run) for c in weights}
        if following:
            out[following] = F.lead(col(value)).over(ordered)
        return steps.withColumns(out)
    binned = stage(steps.repartitionByRange(bins, *by, col(value)).withColumn("_bin", F.spark_partition_id()), "parts")
    ordered = Window.partitionBy(*by).orderBy("_bin")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in weights], F.min(col(value)).alias("_m"))
    offsets = totals.select(
        *by, "_bin", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in weights],
        F.lead("_m").over(ordered).alias("_carry"),
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(col(value))
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    columns = {f"{c}_cum": F.sum(c).over(run) + F.col(f"_o_{c}") for c in weights}
    if following:
        columns[following] = F.coalesce(F.lead(col(value)).over(inside), F.col("_carry"))
    # offsets: one row per key and part that it reaches into
    out = binned.join(offsets, [*keys, "_bin"]).withColumns(columns)
    return out.drop("_bin", "_carry", *[f"_o_{c}" for c in weights])


def quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], rows: int | None = None,
              one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles per key group: columns ``keys``, ``n``, ``q`` (array, as ``probs``).

    ``percentile`` keeps every distinct value of a group in one buffer, so it is used only when the whole
    input is small. Otherwise ``bracketed_quantiles`` narrows brackets until few values are left.
    """
    long = long.where(col(value).isNotNull())
    rows = long.count() if rows is None else rows
    by = [col(k) for k in keys]
    if rows <= one_task_rows:
        return long.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.percentile(col(value), F.array(*[F.lit(float(p)) for p in probs])).alias("q")
        )
    return bracketed_quantiles(long, keys, value, probs)


def per_column(df: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``feature`` plus one column per statistic: all columns in one aggregate, rows are not multiplied."""
    one = df.agg(*[f(col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in stats.items()])
    cells = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in stats]) for i, c in enumerate(cols)
    ]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _inside(x: Column, lo: Column, hi: Column) -> Column:
    return F.when((x > lo) & (x < hi), x)


def _tally(x: Column, lo: Column, hi: Column) -> Column:
    """How many values lie below, at the lower end, strictly inside and at the upper end of a bracket."""
    return F.struct(
        F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("at_lo"),
        F.count(_inside(x, lo, hi)).alias("inside"), F.count_if((x == hi) & (lo < hi)).alias("at_hi"),
    )


def _gathered(x: Column, lo: Column, hi: Column) -> Column:
    return F.sort_array(F.collect_list(_inside(x, lo, hi)))


def _grid(x: Column, lo: Column, hi: Column) -> Column:
    return F.percentile_approx(_inside(x, lo, hi), [i / GRID for i in range(1, GRID)], GRID_ACCURACY)


def _narrowed(b: Column, tally: Column, grid: Column) -> Column:
    """The part of a bracket that holds its two ranks, one cut of the grid wider on either side."""
    n = tally["inside"]
    first, last = b["t"] - tally["below"] - tally["at_lo"], b["u"] - tally["below"] - tally["at_lo"]
    left = (F.floor(first * GRID / n) - 1).cast("int")
    right = (F.ceil((last + 1) * GRID / n) + 1).cast("int")
    low = F.when(first >= n, b["hi"]).when((first < 0) | (left < 1), b["lo"]).otherwise(F.get(grid, left - 1))
    high = F.when(last < 0, b["lo"]).when((last >= n) | (right >= GRID), b["hi"]).otherwise(F.get(grid, right - 1))
    share = (F.least(right, F.lit(GRID)) - F.greatest(left, F.lit(0))) / GRID + 2 / GRID_ACCURACY
    most = F.when((first >= n) | (last < 0), 0.0).otherwise(F.least(share, F.lit(1.0)) * n)
    return F.struct(b["t"].alias("t"), b["u"].alias("u"), low.alias("lo"), high.alias("hi"), most.alias("most"))


def _picked(b: Column, tally: Column, values: Column, frac: Column) -> Column:
    """The value at a rank between two rows, from the tally and the sorted inner values of its bracket."""
    def at(rank: Column) -> Column:
        start = tally["below"] + tally["at_lo"]
        missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
        return (
            F.when(rank < tally["below"], missed).when(rank < start, b["lo"])
            .when(rank < start + tally["inside"], F.get(values, (rank - start).cast("int")))
            .when(rank < start + tally["inside"] + tally["at_hi"], b["hi"]).otherwise(missed)
        )

    return at(b["t"]) + (at(b["u"]) - at(b["t"])) * frac


def _first_brackets(n: Column, ends: Column, probs: Sequence[float], slack: float) -> list[Column]:
    """Brackets from a sketch: ``ends`` holds the least value, the lower and upper ends as ``probs``, the largest value.

    A short column, where the slack is less than a row wide, is its own bracket.
    """
    k = len(probs)
    tight = n * slack >= 2
    out = []
    for j, p in enumerate(probs):
        spot = (n - 1) * F.lit(float(p))
        lo = F.when(tight, F.get(ends, F.lit(1 + j))).otherwise(F.get(ends, F.lit(0)))
        hi = F.when(tight, F.get(ends, F.lit(1 + k + j))).otherwise(F.get(ends, F.lit(1 + 2 * k)))
        most = F.when(tight, n * min(1.0, slack * 8 / 3)).otherwise(n.cast("double"))
        out.append(F.struct(F.floor(spot).cast("long").alias("t"), F.ceil(spot).cast("long").alias("u"), lo.alias("lo"),
                            hi.alias("hi"), most.alias("most")))
    return out


def _ends(x: Column, probs: Sequence[float], accuracy: int) -> Column:
    slack = 3.0 / accuracy
    low, high = [max(0.0, p - slack) for p in probs], [min(1.0, p + slack) for p in probs]
    return F.percentile_approx(x, [0.0, *low, *high, 1.0], accuracy)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10_000,
                     small: int = SMALL) -> DataFrame:
    """Exact, linearly interpolated quantiles of whole columns: ``feature, n, q`` (array, as ``probs``).

    A sketch brackets every quantile. A pass then counts the values below, at the ends of and strictly inside each
    bracket; where at most ``small`` lie inside, they are gathered, else they are bracketed again by a sketch of their own,
    which leaves less than a thousandth of them whatever their distribution. Copies of a bracket's ends are counted, never
    gathered. That is three scans up to some 25 million rows and two more for each factor of a thousand; no column is
    sorted or held, and the driver sees a few numbers per column and pass. Missing values (NULL, NaN) do not count.
    """
    base = df.select(*[
        F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)
    ])
    spark = df.sparkSession
    sketch = base.agg(*[e for i in range(len(cols)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), _ends(F.col(f"c{i}"), probs, accuracy).alias(f"e{i}"))])
    first = sketch.select(*[F.col(f"n{i}") for i in range(len(cols))], *[
        b.alias(f"b{i}_{j}") for i in range(len(cols))
        for j, b in enumerate(_first_brackets(F.col(f"n{i}"), F.col(f"e{i}"), probs, 3.0 / accuracy))
    ]).first()
    counts = [first[f"n{i}"] for i in range(len(cols))]
    open_ = {(i, j): first[f"b{i}_{j}"] for i, n in enumerate(counts) for j in range(len(probs)) if n}
    ends = {at: (r["lo"], r["hi"]) for at, r in open_.items()}
    found: dict[tuple[int, int], list[float]] = {}
    while ends:
        tallies = base.agg(*[_tally(F.col(f"c{i}"), F.lit(lo), F.lit(hi)).alias(f"t{i}_{j}") for (i, j), (lo, hi) in ends.items()]).first()
        reads, some = {}, F.lit(False)
        for (i, j), (lo, hi) in ends.items():
            below, at_lo, inside, at_hi = tallies[f"t{i}_{j}"]
            first_, last = (open_[i, j][rank] - below - at_lo for rank in ("t", "u"))
            if first_ < -at_lo or last >= inside + at_hi:
                raise RuntimeError("quantile outside its bracket")
            x = _inside(F.col(f"c{i}"), F.lit(lo), F.lit(hi))
            if last < 0 or first_ >= inside or inside <= small:
                found[i, j] = [lo if k < 0 else hi if k >= inside else None for k in (first_, last)]
                if None in found[i, j]:
                    values = F.sort_array(F.collect_list(x))
                    reads[i, j] = F.array(*[F.get(values, F.lit(min(max(k, 0), inside - 1))) for k in (first_, last)])
            else:
                slack = 3 / GRID_ACCURACY
                reads[i, j] = F.percentile_approx(
                    x, [max(0.0, (first_ - 1) / inside - slack), min(1.0, (last + 2) / inside + slack)], GRID_ACCURACY)
            if (i, j) in reads:
                some = some | x.isNotNull()
        row = base.where(some).agg(*[v.alias(f"r{i}_{j}") for (i, j), v in reads.items()]).first() if reads else {}
        closer = {}
        for i, j in reads:
            got = row[f"r{i}_{j}"]
            if (i, j) in found:
                found[i, j] = [g if f is None else f for f, g in zip(found[i, j], got)]
            else:
                below, at_lo, inside, _ = tallies[f"t{i}_{j}"]
                first_, last = (open_[i, j][rank] - below - at_lo for rank in ("t", "u"))
                closer[i, j] = (ends[i, j][0] if first_ < 0 else got[0], ends[i, j][1] if last >= inside else got[1])
        ends = closer

    def between(i: int, j: int) -> float:
        spot, (a, z) = (counts[i] - 1) * probs[j], found[i, j]
        return a + (z - a) * (spot - spot // 1)

    rows = [(c, counts[i], [between(i, j) for j in range(len(probs))] if counts[i] else None) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, n long, q array<double>")


def bracketed_quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                        accuracy: int = 100_000, small: int = SMALL) -> DataFrame:
    """As ``column_quantiles``, per key group (missing keys are a group): columns ``keys``, ``n``, ``q``.

    The brackets are a written table, one row per group; only groups that still have a wide bracket are read again.
    """
    small = max(small, 2 * GRID)
    spots = range(len(probs))
    x = col(value).cast("double")
    rows = long.select(*[col(k) for k in keys], x.alias("_x")).where(F.col("_x").isNotNull())
    renamed = [f"_k{i}" for i in range(len(keys))]
    sketch = rows.groupBy(*[col(k).alias(r) for k, r in zip(keys, renamed)]).agg(
        F.count(F.lit(1)).alias("n"), _ends(F.col("_x"), probs, accuracy).alias("_e"))
    brackets = _first_brackets(F.col("n"), F.col("_e"), probs, 3.0 / accuracy)
    state = stage(sketch.select(*renamed, "n", *[b.alias(f"_b{j}") for j, b in enumerate(brackets)]), "brackets")
    few = state.count() <= BROADCAST_GROUPS
    most = F.greatest(*[F.col(f"_b{j}.most") for j in spots], F.lit(0.0))

    def passed(groups: DataFrame, read: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """The groups with the tally ``_t{j}`` and the reading ``_v{j}`` of each bracket."""
        same = reduce(and_, [col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)], F.lit(True))
        # one row per group on the right
        met = rows.join(hinted(groups, few), same)
        return met.groupBy(*renamed).agg(
            F.first("n").alias("n"), *[F.first(f"_b{j}").alias(f"_b{j}") for j in spots],
            *[_tally(F.col("_x"), F.col(f"_b{j}.lo"), F.col(f"_b{j}.hi")).alias(f"_t{j}") for j in spots],
            *[read(F.col("_x"), F.col(f"_b{j}.lo"), F.col(f"_b{j}.hi")).alias(f"_v{j}") for j in spots],
        )

    while (state.agg(F.max(most)).first()[0] or 0) > small:
        closer = passed(state.where(most > small), _grid).select(*renamed, "n", *[
            F.when(F.col(f"_b{j}.most") > small, _narrowed(F.col(f"_b{j}"), F.col(f"_t{j}"), F.col(f"_v{j}")))
            .otherwise(F.col(f"_b{j}")).alias(f"_b{j}") for j in spots])
        state = stage(state.where(most <= small).unionByName(closer), "brackets")
    spot = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    return passed(state, _gathered).select(
        *[F.col(r).alias(k) for k, r in zip(keys, renamed)], "n",
        F.array(*[_picked(F.col(f"_b{j}"), F.col(f"_t{j}"), F.col(f"_v{j}"), spot[j] - F.floor(spot[j])) for j in spots]).alias("q"),
    )


def running_before(df: DataFrame, order: Sequence[str], weight: str, out: str, rows: int | None = None,
                   one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add ``out``: the total ``weight`` of all rows that sort strictly before this one, over the whole table.

    Meant for aggregated tables (one row per entity or name). A table that fits one task uses a window;
    a larger one is range-sorted and written to the checkpoint folder, so that the per-part totals and
    the rows see the same parts, and each part is summed on its own.
    """
    rows = df.count() if rows is None else rows
    keys = [col(o) for o in order]
    if rows <= one_task_rows:
        w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("long"))
    tagged = cut_lineage(df.orderBy(*keys).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted part
    parts = tagged.groupBy("_part").agg(F.sum(weight).alias("_t")).select(
        "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(F.broadcast(parts), "_part")
        .withColumn(out, (F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_o")).cast("long"))
        .drop("_part", "_o")
    )


def dense_codes(names: DataFrame, name: str, code: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Distinct ``name`` values numbered from 0 in alphabetical order."""
    distinct = names.select(col(name)).where(col(name).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return running_before(distinct, [name], "_one", code, one_task_rows=one_task_rows).drop("_one")
