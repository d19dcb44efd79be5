"""Per-entity window work that stays bounded when one entity holds much of the table.

A plain ``Window.partitionBy(entity)`` puts a whole entity into one task. Before planning, the layout
probe counts rows per entity (a map-side combined count). Entities that fit take the plain window.
Those that do not are cut into time slots of about equal depth (rows of one instant stay together), and results across slot borders are rebuilt exactly:

* bounded frames (lag, rolling, sequences) need the ``reach`` rows before a slot, so only the first and last
  ``reach`` rows of each slot go through a second, small window;
* unbounded frames (fills, positions) need one carried value per slot, taken from a table with one row per slot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.operators.ordering import bin_index
from tidemark.session import stage
from tidemark.spec import PanelSpec

#: Slots of an entity at most; ``bin_index`` finds one of twice as many.
MAX_PIECES = 65_536
#: Cuts of all hot entities in a broadcast at most; beyond, rows meet their cuts by a shuffle.
BROADCAST_CUTS = 1_000_000
ALL = "_all"


@dataclass(frozen=True)
class Layout:
    """``hot`` holds one row per oversized entity with its time cuts, or is None when all entities fit; ``few`` says that it
    may be broadcast."""

    hot: DataFrame | None = None
    few: bool = True


PLAIN = Layout()


def entity_columns(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, list[str]]:
    """The partition columns of the panel; a constant one for the global mode."""
    if spec.entity:
        return df, list(spec.entity)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def micros(df: DataFrame, spec: PanelSpec) -> Column:
    """Event time as an orderable number (numbers pass through)."""
    if isinstance(df.schema[spec.time].dataType, T.NumericType):
        return col(spec.time).cast("double")
    t = col(spec.time)
    if isinstance(df.schema[spec.time].dataType, T.TimestampNTZType):  # by its own fields: no session zone may reorder it
        whole = F.unix_date(t.cast("date")).cast("double") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60
        return whole + F.extract(F.lit("SECOND"), t).cast("double")
    return F.unix_micros(t.cast("timestamp")).cast("double")


def probe_layout(df: DataFrame, spec: PanelSpec) -> Layout:
    """Count rows per entity and, where an entity is too large for one task, choose its time cuts.

    An entity is hot when it exceeds ``hot_rows``, and gets two slots for each ``hot_rows`` of its rows. The driver sees one
    total row; the cuts are a written table, broadcast only if it holds at most ``BROADCAST_CUTS`` numbers.
    """
    df, keys = entity_columns(df, spec)
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]
    if top is None or top <= spec.hot_rows:
        return PLAIN
    pieces = min(2 * -(-top // spec.hot_rows), MAX_PIECES)
    own = F.least(F.ceil(2 * F.col("_n") / spec.hot_rows), F.lit(pieces)).cast("int")
    hot = stage(counts.where(F.col("_n") > spec.hot_rows).select(
        *[col(k).alias(f"_h{i}") for i, k in enumerate(keys)], own.alias("_own")), "hot")
    few = hot.agg(F.sum("_own")).first()[0] <= BROADCAST_CUTS
    probs = [i / pieces for i in range(1, pieces)]
    cuts = (
        df.select(*[col(k) for k in keys], micros(df, spec).alias("_t"))
        .join(F.broadcast(hot) if few else hot, _same(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(F.percentile_approx("_t", probs, max(10_000, 4 * pieces)).alias("_all_cuts"), F.first("_own").alias("_pieces"))
    )
    # smaller entities take every so many of the cuts
    mine = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1),
                       lambda i: F.get("_all_cuts", F.floor(i * pieces / F.col("_pieces")).cast("int") - 1))
    return Layout(stage(cuts.select(*[col(k) for k in keys], F.array_distinct(mine).alias("_cuts")), "cuts"), few)


def _same(keys: Sequence[str]) -> Column:
    """Entity columns equal to their ``_h{i}`` copies; a missing entity equals itself, since it may be hot too."""
    return reduce(and_, [col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])


def plain_window(keys: Sequence[str], spec: PanelSpec, descending: bool = False) -> WindowSpec:
    order = [col(o).desc() if descending else col(o).asc() for o in spec.order]
    return Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)


def _split(df: DataFrame, keys: Sequence[str], layout: Layout, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """(rows of entities that fit, rows of hot entities with their ``_slot``)."""
    table = layout.hot.select(*[col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_cuts")
    table = F.broadcast(table) if layout.few else table
    cold = df.join(table, _same(keys), "left_anti")
    hot = df.join(table, _same(keys), "inner").withColumn("_slot", bin_index(F.col("_cuts"), micros(df, spec)))
    hot = hot.select(*[col(c) for c in df.columns], "_slot")
    return cold, hot


def framed(df: DataFrame, spec: PanelSpec, make: Callable[[WindowSpec], dict[str, Column]], reach: int,
           layout: Layout | None = None) -> DataFrame:
    """Add ``make(window)`` columns whose row frames look back at most ``reach`` rows."""
    base, keys = entity_columns(df, spec)
    layout = probe_layout(df, spec) if layout is None else layout
    whole = plain_window(keys, spec)
    if layout.hot is None:
        return base.withColumns(make(whole)).drop(ALL)
    cold, hot = _split(base, keys, layout, spec)
    slot_keys = [*keys, "_slot"]
    up = plain_window(slot_keys, spec)
    size = F.count(F.lit(1)).over(Window.partitionBy(*[col(k) for k in slot_keys]))
    marked = hot.withColumns({"_first": F.row_number().over(up), "_size": size})
    inner = marked.withColumns(make(up)).where(F.col("_first") > reach)
    border = (
        marked.where((F.col("_first") <= reach) | (F.col("_first") > F.col("_size") - reach))
        .withColumns(make(whole))
        .where(F.col("_first") <= reach)
    )
    out = cold.withColumns(make(whole))
    for part in (inner, border):
        out = out.unionByName(part.select(*[col(c) for c in out.columns]))
    return out.drop(ALL)


def with_neighbours(df: DataFrame, spec: PanelSpec, cols: Sequence[str], layout: Layout | None = None) -> DataFrame:
    """Add ``_pos`` (1-based position in the entity) and, per column i, the structs ``_prev_i`` / ``_next_i``.

    Each struct is (position, value) of the nearest non-missing value at or before / at or after the row.
    """
    base, keys = entity_columns(df, spec)
    layout = probe_layout(df, spec) if layout is None else layout
    if layout.hot is None:
        numbered = base.withColumn("_pos", F.row_number().over(plain_window(keys, spec)).cast("long"))
        return _nearest(numbered, keys, spec, cols).drop(ALL)

    cold, hot = _split(base, keys, layout, spec)
    cold = cold.withColumn("_pos", F.row_number().over(plain_window(keys, spec)).cast("long"))
    cold = _nearest(cold, keys, spec, cols)

    slot_keys = [*keys, "_slot"]
    earlier = Window.partitionBy(*[col(k) for k in keys]).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*[col(k) for k in keys]).orderBy(F.col("_slot").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = hot.withColumn("_local", F.row_number().over(plain_window(slot_keys, spec)).cast("long"))

    def seen(i: int, c: str) -> Column:
        return F.when(col(c).isNotNull(), F.struct(F.col("_local").alias("pos"), col(c).alias("val")))

    slots = local.groupBy(*[col(k) for k in slot_keys]).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(seen(i, c)).alias(f"_l{i}") for i, c in enumerate(cols)],
        *[F.min(seen(i, c)).alias(f"_f{i}") for i, c in enumerate(cols)],
    )
    slots = slots.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))

    def shifted(s: str) -> Column:
        c = F.col(s)
        return F.when(c.isNotNull(), F.struct((c["pos"] + F.col("_off")).alias("pos"), c["val"].alias("val")))

    slots = slots.withColumns(
        {n: shifted(n) for i in range(len(cols)) for n in (f"_l{i}", f"_f{i}")}
    ).withColumns({
        **{f"_cp{i}": F.last(f"_l{i}", True).over(earlier) for i in range(len(cols))},
        **{f"_cn{i}": F.last(f"_f{i}", True).over(later) for i in range(len(cols))},
    })
    carry_cols = [f"_c{d}{i}" for i in range(len(cols)) for d in ("p", "n")]
    # one row per slot, never more than there are cuts and entities; many columns are left to the optimizer
    carry = slots.select(*[col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_hs"), "_off", *carry_cols)
    carry = F.broadcast(carry) if layout.few and len(cols) <= 4 else carry
    joined = local.join(carry, _same(keys) & (F.col("_slot") == F.col("_hs")), "left")
    joined = joined.withColumn("_pos", F.col("_local") + F.col("_off"))
    near = _nearest(joined, slot_keys, spec, cols).withColumns({
        **{f"_prev_{i}": F.coalesce(F.col(f"_prev_{i}"), F.col(f"_cp{i}")) for i in range(len(cols))},
        **{f"_next_{i}": F.coalesce(F.col(f"_next_{i}"), F.col(f"_cn{i}")) for i in range(len(cols))},
    })
    return cold.unionByName(near.select(*[col(c) for c in cold.columns])).drop(ALL)


def _nearest(df: DataFrame, keys: Sequence[str], spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    # a descending window with a running frame is linear; an "unbounded following" frame is quadratic
    up = plain_window(keys, spec).rowsBetween(Window.unboundedPreceding, 0)
    down = plain_window(keys, spec, descending=True).rowsBetween(Window.unboundedPreceding, 0)

    def seen(c: str) -> Column:
        return F.when(col(c).isNotNull(), F.struct(F.col("_pos").alias("pos"), col(c).alias("val")))

    return df.withColumns({
        **{f"_prev_{i}": F.last(seen(c), True).over(up) for i, c in enumerate(cols)},
        **{f"_next_{i}": F.last(seen(c), True).over(down) for i, c in enumerate(cols)},
    })


def drop_neighbours(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop("_pos", *[f"_{d}_{i}" for i in range(len(cols)) for d in ("prev", "next")])
