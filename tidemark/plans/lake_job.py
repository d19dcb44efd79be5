"""The lake job: ingest, clean, features; each stage also on its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.operators import features, fill, frames, rows
from tidemark.operators.panel import probe_layout
from tidemark.operators.preprocess import clean_panel
from tidemark.operators.quality import null_profile
from tidemark.session import stage
from tidemark.sources.filelog import new_commit
from tidemark.sources.lake import CLEAN, DATE, FEATURES, RAW, Lake, with_date
from tidemark.sources.manifest import Manifest
from tidemark.sources.state import Watermark, WatermarkTable
from tidemark.sources.storage import exists
from tidemark.spec import PanelSpec


PROGRESS = "layer string, date date, status string, at timestamp"


@dataclass
class LakeJob:
    """Stages over one panel. ``measures`` are the columns that are filled, lagged and rolled."""

    spark: SparkSession
    root: str
    spec: PanelSpec
    measures: tuple[str, ...]
    pipeline: str = "lake"
    lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24)
    windows: tuple[int, ...] = (6, 12, 24)
    fill_limit: int = 3
    policy: str = "append"
    key: tuple[str, ...] = ()
    rules: Sequence[Callable[[DataFrame], DataFrame]] = field(default_factory=tuple)

    def __post_init__(self):
        self.lake = Lake(self.spark, self.root)
        self.marks = WatermarkTable(self.spark, f"{self.lake.root}/_state/watermarks")
        self.manifests = f"{self.lake.root}/_state/manifests"
        self.progress = f"{self.lake.root}/_state/progress"

    def mark(self, layer: str, dates: Sequence[date], status: str) -> None:
        """Note that a layer's dates are ``done`` or (their source changed) ``dirty``."""
        if dates:
            now = datetime.now(timezone.utc)
            rows_ = [(layer, d, status, now) for d in dates]
            self.spark.createDataFrame(rows_, PROGRESS).coalesce(1).write.mode("append").parquet(self.progress)

    def pending(self, source: str, target: str) -> list[date]:
        """Source dates the target has not processed since they last changed.

        A processed date may well have no rows in the target (its lags reach before the first day), so the notes decide,
        and only dates without one are looked up among the partitions.
        """
        status: dict[date, str] = {}
        if exists(self.spark, self.progress):
            # one row per date
            notes = self.spark.read.schema(PROGRESS).parquet(self.progress).where(F.col("layer") == target)
            status = {r["date"]: r["s"] for r in notes.groupBy("date").agg(F.max_by("status", "at").alias("s")).collect()}
        have = set(self.lake.dates(target))
        return [d for d in self.lake.dates(source)
                if status.get(d) == "dirty" or (d not in status and d not in have)]

    def ingest(self, source: DataFrame | Callable[[datetime | None], DataFrame]) -> list[date]:
        """Rows that ``raw`` does not hold yet; returns the dates written, none when nothing is new.

        Rows at or before the watermark are late: they follow ``policy`` like those newer than it. A row that is stored
        already, by ``key`` or else in all columns, is not written again. Rows without a readable time go to the
        rejected ones. The manifest counts all of these. A callable source gets the watermark, so it can push it
        down, and then decides itself how late a row may be. The batch is closed at its own latest time before anything is
        written: rows landing meanwhile belong to the next run. On an error the manifest says so and the error goes on;
        the watermark then stays where it was.
        """
        manifest = Manifest(self.pipeline)
        time = self.spec.time
        try:
            mark = self.marks.get(self.pipeline)
            df = source(mark.last_success_at) if callable(source) else source
            df = rows.ensure_time(df, time)
            df = rows.chain(rows.drop_all_missing(df), *self.rules)
            new = rows.is_after(df, time, mark.last_success_at)
            n, top, high = df.agg(F.count(F.lit(1)), F.max(col(time)), F.max(F.when(new, col(time)))).first()
            written: list[tuple[date, int]] = []
            if n:
                batch = df if top is None else df.where(col(time).isNull() | (col(time) <= F.lit(top)))
                # noted first: a run that dies while it writes is caught up by the next one
                late = with_date(batch.where(~new & col(time).isNotNull()), time)
                if mark.last_success_at is not None and self.policy == "append":
                    self.mark(CLEAN, distinct_dates(self.lake.unknown(late, RAW, self.key)), "dirty")
                self.mark(CLEAN, batch_dates(batch.where(new), time), "dirty")
                written = self.lake.write(
                    batch, RAW, time, self.policy, self.key, once=True,
                    note=lambda day, table, k: manifest.add(day, table, k, self.lake.path(table)))
                for day, k in written:
                    manifest.add(day, RAW, k, f"{self.lake.path(RAW)}/date={day}")
            if written or high is not None:
                last = max((d for d in (*(d for d, _ in written), mark.last_partition_date) if d), default=None)
                if high is None:
                    high = mark.last_success_at.astimezone(timezone.utc)
                elif isinstance(df.schema[time].dataType, T.TimestampType):
                    high = high.astimezone(timezone.utc)
                self.marks.update(Watermark(self.pipeline, _utc(high), last, sum(k for _, k in written)))
            manifest.succeed()
            return [d for d, _ in written]
        except Exception as error:
            manifest.fail(error)
            raise
        finally:
            manifest.save(self.spark, self.manifests)

    def missing_report(self, layer: str = RAW) -> DataFrame:
        return null_profile(self.lake.read(layer))

    def clean(self, dates: Sequence[date] | None = None) -> list[date]:
        """All given (or pending) dates in one job: de-duplicate, interpolate, drop incomplete rows."""
        todo = list(dates or self.pending(RAW, CLEAN))
        if not todo:
            return []
        df = self.lake.read_dates(RAW, todo)
        # each date is cleaned on its own, so cleaning a date again gives the same rows
        daily = self.spec.with_(entity=(*self.spec.entity, DATE))
        layout = probe_layout(df, daily)  # on the rows as read: counting after the aggregate would run it twice
        out = rows.dedup(df, self.spec.time, tiebreak=self.spec.tiebreak)
        out = fill.interpolate(out, daily, self.measures, self.fill_limit, layout)
        out = rows.drop_any_missing(out)
        before = new_commit()
        written = [d for d, _ in self.lake.write(out, CLEAN, self.spec.time, replaced=todo)]
        self.mark(CLEAN, todo, "done")
        later = [d for d in self.lake.dates(CLEAN) if d > min(todo) and d not in set(todo)]
        touched = self.reached(self.changed(todo, before), later) if later else []
        self.mark(FEATURES, sorted({*todo, *touched}), "dirty")
        return written

    def changed(self, dates: Sequence[date], before: str) -> DataFrame:
        """The entities (``_e0``, ...) and dates whose clean rows differ from those before that commit."""
        log = self.lake.log(CLEAN)
        new, held = log.read(dates), set(log.dates(before))
        old = [d for d in dates if d in held]
        if old:
            was = log.read(old, before)
            was = was.select(*[col(c) if c in was.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])
            now = new.where(F.col(DATE).isin(old))
            differs = now.exceptAll(was).union(was.exceptAll(now)).union(new.where(~F.col(DATE).isin(old)))
        else:
            differs = new
        return differs.select(*_entity(self.spec), DATE).distinct()

    def reached(self, changes: DataFrame, later: Sequence[date]) -> list[date]:
        """Which of the sorted ``later`` dates have one of the next max(lag, window) rows after a change (entity and date).

        Rows are counted per entity and date, over so many dates at a time as an entity needs, twice as many in each step;
        entities that have found their rows leave.
        """
        k, found, at, step = max(*self.lags, *self.windows), set(), 0, 0
        open_ = stage(changes.withColumns({"_from": F.col(DATE), "_have": F.lit(0).cast("long")}).drop(DATE), "changes")
        names = [c for c in open_.columns if c.startswith("_e")]
        match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names], F.lit(True)) if names else F.lit(True)
        while at < len(later) and not open_.isEmpty():
            step = max(2 * step, 2 * k)
            days, at = later[at:at + step], at + step
            seen = self.lake.log(CLEAN).read(days).select(*_entity(self.spec), DATE).groupBy(*names, DATE).agg(F.count(F.lit(1)).alias("_n"))
            seen = seen.withColumnsRenamed({c: f"{c}_" for c in names})
            each = Window.partitionBy(*names, "_from").orderBy(DATE)
            after = stage(open_.join(seen, match & (F.col(DATE) > F.col("_from"))).withColumns({
                "_before": F.col("_have") + F.coalesce(F.sum("_n").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_upto": F.col("_have") + F.sum("_n").over(each.rowsBetween(Window.unboundedPreceding, 0))}), "after")
            # one row per date
            found |= {r[DATE] for r in after.where(F.col("_before") < k).select(DATE).distinct().collect()}
            far = after.groupBy(*[F.col(c).alias(f"{c}_") for c in names], F.col("_from").alias("_from_")).agg(F.max("_upto").alias("_upto"))
            left = open_.join(far, match & (F.col("_from") == F.col("_from_")), "left").where(F.coalesce("_upto", "_have") < k)
            open_ = stage(left.select(*names, "_from", F.coalesce("_upto", "_have").alias("_have")), "changes")
        return sorted(found)

    def features(self, dates: Sequence[date] | None = None, lookback: str = "partitions",
                 following: bool = True) -> list[date]:
        """Features of the given (or pending) dates, computed with the history before them.

        What ``clean`` changes it notes together with the dates that the changes reach, so pending dates are complete. For
        given dates, ``following`` adds those that their rows reach: the dates of each entity's next max(lag, window) rows.
        """
        todo = sorted(dates or self.pending(CLEAN, FEATURES))
        if not todo:
            return []
        have = self.lake.dates(CLEAN)
        if following and dates:
            given = self.lake.log(CLEAN).read(todo).select(*_entity(self.spec), DATE).distinct()
            todo = sorted({*todo, *self.reached(given, [d for d in have if d > todo[0] and d not in set(todo)])})
        real = sorted(set(todo) & set(have))
        written = []
        if real:
            out = lookback_features(self.lake, self.spec, self.measures, real, self.lags, self.windows, lookback)
            written = [d for d, _ in self.lake.write(out, FEATURES, self.spec.time, replaced=todo)]
        self.mark(FEATURES, todo, "done")
        return written

    def run(self, source: DataFrame | Callable | None = None, stage: str = "all",
            dates: Sequence[date] | None = None) -> dict[str, list[date]]:
        """Stage ``ingest``, ``clean``, ``features`` or ``all``; dates written pass from stage to stage.

        No new dates means every pending date, so an interrupted run is caught up.
        """
        if stage not in ("all", "ingest", "clean", "features"):
            raise ValueError(f"unknown stage {stage!r}")
        done: dict[str, list[date]] = {}
        if stage in ("all", "ingest"):
            done["ingest"] = self.ingest(source)
            dates = done["ingest"] if stage == "all" else dates
        if stage in ("all", "clean"):
            done["clean"] = self.clean(_with_pending(dates, self.pending(RAW, CLEAN)))
            dates = done["clean"] if stage == "all" else dates
        if stage in ("all", "features"):
            # dates that were cleaned just now are pending with all that they reach
            done["features"] = self.features(_with_pending(dates, self.pending(CLEAN, FEATURES)), following=stage == "features" and bool(dates))
        return done


def batch_dates(batch: DataFrame, time: str) -> list[date]:
    """The distinct dates of a batch: one row per date."""
    return distinct_dates(batch.select(F.to_date(col(time)).alias(DATE)))


def distinct_dates(dated: DataFrame) -> list[date]:
    """The distinct partition dates: one row per date."""
    return sorted(r[DATE] for r in dated.select(DATE).where(F.col(DATE).isNotNull()).distinct().collect())


def preprocess_raw(lake: Lake, spec: PanelSpec, numeric: Sequence[str], targets: Sequence[str] | None = None,
                   redundant: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """The whole raw layer, filled and clipped: (clean rows, clip bounds)."""
    df = lake.read(RAW).withColumns({c: col(c).cast("double") for c in numeric})
    return clean_panel(df, spec, numeric, targets, redundant, **options)


def inference_features(lake: Lake, spec: PanelSpec, numeric: Sequence[str], lags: Sequence[int] = (1, 3, 7),
                       windows: Sequence[int] = (3, 7), **options) -> DataFrame:
    """Raw layer to model-ready features in one plan: load, clean, build."""
    df, _ = preprocess_raw(lake, spec, numeric, **options)
    return features.build_features(df, spec, numeric, numeric, lags, windows)


def _with_pending(dates: Sequence[date] | None, pending: list[date]) -> list[date]:
    return sorted({*(dates or []), *pending})


def _utc(moment: datetime | date) -> datetime:
    """A zone-free event time read as UTC; a date as its midnight."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def lookback_features(lake: Lake, spec: PanelSpec, measures: Sequence[str], dates: Sequence[date],
                      lags: Sequence[int], windows: Sequence[int], lookback: str = "partitions",
                      layer: str = CLEAN) -> DataFrame:
    """Lags, rolling statistics and calendar encodings of ``dates``.

    ``partitions`` reads the last max(lags, windows) existing dates before them; ``rows`` takes exactly that many
    rows per entity, which is exact for sparse entities and reads further back for those. Dates far apart are computed on
    their own, each with its history; dates between near ones are read, not returned.
    """
    if lookback not in ("partitions", "rows"):
        raise ValueError("lookback is 'partitions' or 'rows'")
    k, have, parts = max(*lags, *windows), lake.dates(layer), []
    for group in date_groups(sorted(set(dates)), have, 2 * k):
        target = lake.read_dates(layer, [d for d in have if group[0] <= d <= group[-1]] or group)
        layout = probe_layout(target, spec)
        earlier = [d for d in have if d < group[0]]
        if lookback == "partitions":
            history = lake.log(layer).read(earlier[-k:])
        else:
            history = tail_rows(lake, layer, spec, target, earlier, k)
        df = history.unionByName(target, allowMissingColumns=True)
        built = features.build_features(df, spec, measures, measures, lags, windows, layout=layout)
        parts.append(built.where(F.col(DATE).isin(group)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def date_groups(dates: Sequence[date], have: Sequence[date], gap: int) -> list[list[date]]:
    """The sorted dates in runs between which more than ``gap`` of the existing dates lie."""
    place = {d: i for i, d in enumerate(have)}
    groups: list[list[date]] = []
    for d in dates:
        near = groups and place.get(d, 0) - place.get(groups[-1][-1], 0) <= gap
        if near:
            groups[-1].append(d)
        else:
            groups.append([d])
    return groups


def tail_rows(lake: Lake, layer: str, spec: PanelSpec, target: DataFrame, earlier: Sequence[date], k: int) -> DataFrame:
    """The last ``k`` rows of ``target``'s entities on the sorted ``earlier`` dates.

    Dates are read backwards, twice as many in each step, and only for the entities that still lack rows.
    """
    who = _entity(spec)
    names = [f"_e{i}" for i in range(len(spec.entity))]
    match = reduce(and_, [col(c).eqNullSafe(F.col(n)) for c, n in zip(spec.entity, names, strict=True)], F.lit(True))
    open_ = stage(target.select(*who).distinct().withColumn("_lack", F.lit(k).cast("long")) if names
                  else target.limit(1).select(F.lit(k).cast("long").alias("_lack")), "lacking")
    found, at, step = lake.log(layer).read([]), len(earlier), 0
    while at > 0 and not open_.isEmpty():
        step = max(2 * step, 2 * k)
        days, at = earlier[max(0, at - step):at], max(0, at - step)
        rows_ = lake.log(layer).read(days)
        near = frames.last_rows(rows_.join(open_.drop("_lack"), match, "left_semi") if names else rows_, spec, k)
        found = stage(found.unionByName(near, allowMissingColumns=True), "tail")
        counted = near.select(*[c.alias(f"{n}_") for c, n in zip(map(col, spec.entity), names, strict=True)]).groupBy(
            *[f"{n}_" for n in names]).agg(F.count(F.lit(1)).alias("_n"))
        same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], F.lit(True))
        left = open_.join(counted, same, "left").withColumn("_lack", F.col("_lack") - F.coalesce("_n", F.lit(0))).where("_lack > 0")
        open_ = stage(left.select(*names, "_lack"), "lacking")
    return frames.last_rows(found, spec, k)


def _entity(spec: PanelSpec) -> list[Column]:
    """The entity columns under the names ``_e0``, ``_e1``, ..."""
    return [col(c).alias(f"_e{i}") for i, c in enumerate(spec.entity)]
