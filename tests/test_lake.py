import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rows
from tidemark.plans.lake_job import LakeJob
from tidemark.session import scratch_path
from tidemark.sources import readers
from tidemark.sources.lake import CLEAN, FEATURES, RAW, Lake, with_date
from tidemark.sources.manifest import Manifest, load_all
from tidemark.sources.state import Watermark, WatermarkTable
from tidemark.spec import PanelSpec

SPEC = PanelSpec(("who",), "at", ("id",), targets=("x",))
START = datetime(2024, 1, 1)


def hours(spark, n, first=0, who=("a", "b")):
    data = [(w, START + timedelta(hours=first + i), first + i, float((first + i) % 7)) for i in range(n) for w in who]
    return spark.createDataFrame(data, "who string, at timestamp, id long, x double")


def job(spark, **kw):
    return LakeJob(spark, scratch_path(spark, "job"), SPEC, ("x",), lags=(1, 3), windows=(3,), **kw)


def content(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_raw_is_immutable_and_policies_count_what_they_write(spark):
    for policy, second in (("append", [(date(2024, 1, 1), 2), (date(2024, 1, 2), 2)]), ("skip", [(date(2024, 1, 2), 2)]),
                           ("side", [(date(2024, 1, 2), 2)])):
        lake = Lake(spark, scratch_path(spark, policy))
        assert lake.write(hours(spark, 23), RAW, "at", policy) == [(date(2024, 1, 1), 46)]
        assert lake.write(hours(spark, 2, first=23), RAW, "at", policy) == second
        assert lake.read(RAW).count() == 46 + sum(n for _, n in second)
        if policy == "side":
            assert lake.read("late_rows").count() == 2
    with pytest.raises(ValueError):
        lake.write(hours(spark, 1), RAW, "at", overwrite=True)
    with pytest.raises(ValueError):
        lake.write(hours(spark, 1), RAW, "at", "whatever")


def test_other_layers_replace_only_their_dates(spark):
    lake = Lake(spark, scratch_path(spark, "lake"))
    lake.write(hours(spark, 48), CLEAN, "at")
    assert lake.write(hours(spark, 1, first=24), CLEAN, "at") == [(date(2024, 1, 2), 2)]
    assert lake.read(CLEAN).count() == 48 + 2


def test_reads_skip_or_miss(spark):
    lake = Lake(spark, scratch_path(spark, "lake"))
    with pytest.raises(FileNotFoundError):
        lake.read(RAW)
    lake.write(hours(spark, 72), RAW, "at")
    assert lake.dates(RAW) == [date(2024, 1, d) for d in (1, 2, 3)]
    assert lake.read_date(RAW, "2024-01-02").count() == 48
    assert lake.read_range(RAW, "2024-01-02", "2030-01-01").count() == 96
    assert lake.read_dates(RAW, ["2024-01-03", "2025-01-01"]).count() == 48
    for miss in (lambda: lake.read_date(RAW, "2025-01-01"), lambda: lake.read_range(RAW, "2025-01-01", "2025-02-01"),
                 lambda: lake.read_dates(RAW, ["2025-01-01"])):
        with pytest.raises(FileNotFoundError):
            miss()
    assert lake.pending(RAW, CLEAN) == lake.dates(RAW)
    opened = lake.read_date(RAW, "2024-01-02").inputFiles()
    assert opened and all("/date=2024-01-02/" in f for f in opened)


def test_time_column_named_date(spark):
    lake = Lake(spark, scratch_path(spark, "lake"))
    df = hours(spark, 24).withColumnRenamed("at", "date")
    lake.write(df, RAW, "date")
    assert {"date", "event_time"} <= set(lake.read(RAW).columns)
    assert "event_time" in with_date(df, "date").columns


def test_watermark_upsert(spark):
    table = WatermarkTable(spark, scratch_path(spark, "marks"))
    assert table.get("p") == Watermark("p")
    table.update(Watermark("p", datetime(2024, 1, 1), date(2024, 1, 1), 5))
    table.update(Watermark("q", None, None, 1))
    table.update(Watermark("p", datetime(2024, 1, 2), date(2024, 1, 2), 7))
    assert table.get("p").rows_ingested == 7 and table.get("p").last_success_at == datetime(2024, 1, 2)
    assert table.current().count() == 2


def test_second_run_is_a_no_op(spark):
    work = job(spark)
    source = hours(spark, 60)
    done = work.run(source)
    assert done["ingest"] == done["clean"] == [date(2024, 1, d) for d in (1, 2, 3)]
    assert work.run(source) == {"ingest": [], "clean": [], "features": []}
    statuses = [r["status"] for r in load_all(spark, work.manifests).collect()]
    assert statuses == ["success", "success"]


def test_incremental_equals_full_rebuild(spark):
    source = hours(spark, 96)
    full = job(spark)
    full.run(source)
    for lookback in ("partitions", "rows"):
        steps = job(spark)
        for end in ("2024-01-02", "2024-01-03 07:00:00", "2025-01-01"):
            part = source.where(F.col("at") < end)
            steps.ingest(part)
            dates = [d for d in steps.lake.dates(RAW) if d not in set(steps.lake.dates(CLEAN)) or d == date(2024, 1, 3)]
            steps.clean(dates)
            steps.features(dates, lookback=lookback)
        assert content(steps.lake.read(FEATURES)) == content(full.lake.read(FEATURES)), lookback


def test_dates_without_features_do_not_stay_pending(spark):
    data = [(w, START + timedelta(days=i), i, float(i % 5)) for i in range(12) for w in "ab"]
    source = spark.createDataFrame(data, SPEC_SCHEMA)
    work = LakeJob(spark, scratch_path(spark, "job"), SPEC, ("x",), lags=(1, 7), windows=(3,))
    early = work.run(source.where(F.col("id") < 10))
    assert early["features"] == [date(2024, 1, d) for d in (8, 9, 10)]  # seven days lack their lags
    assert work.pending(CLEAN, FEATURES) == []
    late = work.run(source)
    assert late["features"] == [date(2024, 1, d) for d in (11, 12)]  # and nothing older was built again


def test_late_rows_make_a_processed_date_pending_again(spark):
    work = job(spark)
    work.run(hours(spark, 30))
    work.ingest(hours(spark, 40))
    assert work.pending(RAW, CLEAN) == [date(2024, 1, 2)]
    assert work.clean() == [date(2024, 1, 2)] and work.features() == [date(2024, 1, 2)]
    full = job(spark)
    full.run(hours(spark, 40))
    assert content(work.lake.read(FEATURES)) == content(full.lake.read(FEATURES))


def test_failed_run_keeps_the_mark_and_says_so(spark):
    work = job(spark, rules=(lambda d: d.select("nope"),))
    with pytest.raises(Exception):
        work.ingest(hours(spark, 3))
    assert work.marks.get("lake").last_success_at is None
    assert load_all(spark, work.manifests).first()["status"].startswith("failed")


def test_rerun_after_a_lost_watermark_adds_nothing_twice(spark):
    work = job(spark, key=("who", "id"))
    source = hours(spark, 30)
    work.lake.write(source, RAW, "at")  # a run that died before it moved the mark
    work.ingest(hours(spark, 40))
    assert work.lake.read(RAW).count() == 80
    assert work.marks.get("lake").rows_ingested == 20


def test_late_and_undated_rows_are_kept_and_counted(spark):
    first = hours(spark, 9)
    extra = spark.createDataFrame(
        [("a", START + timedelta(hours=3), 100, 1.0), ("a", START + timedelta(hours=11), 101, 2.0), ("b", None, 102, 3.0)],
        "who string, at timestamp, id long, x double")
    for policy in ("append", "side"):
        work = job(spark, policy=policy)
        work.ingest(first)
        for _ in range(2):  # the second time nothing is new
            work.ingest(first.unionByName(extra))
        late = set() if policy == "append" else {r["id"] for r in work.lake.read("late_rows").collect()}
        raw = [r["id"] for r in work.lake.read(RAW).collect()]
        assert set(raw) | late == {*range(9), 100, 101} and len(raw) + len(late) == 20
        assert [r["id"] for r in work.lake.read("rejected_rows").collect()] == [102]
        parts = load_all(spark, work.manifests).select(F.explode("partitions").alias("p"))
        assert parts.agg(F.sum("p.rows")).first()[0] == 21
        assert work.marks.get("lake").last_success_at == START + timedelta(hours=11 if policy == "append" or late else 8)


def test_callable_source_gets_the_mark(spark):
    work, seen = job(spark), []

    def source(mark):
        seen.append(mark)
        return hours(spark, 10)

    work.ingest(source)
    work.ingest(source)
    assert seen == [None, START + timedelta(hours=9)]


def test_clean_stage_rules(spark):
    data = [("a", START, 1, 5.0), ("a", START + timedelta(hours=1), 2, 5.0), ("a", START + timedelta(hours=2), 3, None),
            ("a", START + timedelta(hours=3), 4, 9.0), ("b", START, 5, None)]
    work = job(spark)
    work.ingest(spark.createDataFrame(data, SPEC_SCHEMA))
    work.clean()
    got = {r["id"]: r["x"] for r in work.lake.read(CLEAN).collect()}
    assert got == {1: 5.0, 3: 7.0, 4: 9.0}  # the equal later reading and the unfillable one are gone


SPEC_SCHEMA = "who string, at timestamp, id long, x double"


def test_manifest_round_trip(spark, tmp_path):
    m = Manifest("p")
    m.add(date(2024, 1, 1), RAW, 3, "f")
    m.succeed()
    again = Manifest.load(spark, m.save(spark, str(tmp_path)))
    assert again == m
    m.fail("boom")
    assert m.status == "failed: boom"


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1, 10, "x"), (2, 10, "x"), (2, 10, "x"), (3, 11, "x")], "t long, v long, k string")
    assert rows.dedup(df).count() == 3
    assert sorted(map(tuple, rows.dedup(df, "t").collect())) == [(1, 10, "x"), (3, 11, "x")]


def test_watermark_filter_and_checks(spark):
    df = hours(spark, 5, who=("a",))
    assert rows.after_watermark(df, "at", None).count() == 5
    assert rows.after_watermark(df, "at", START + timedelta(hours=3)).count() == 1
    with pytest.raises(KeyError):
        rows.ensure_time(df, "missing")
    text = spark.createDataFrame([("2024-01-01 05:00:00",), ("nonsense",)], "at string")
    assert rows.ensure_time(text, "at").where(F.col("at").isNull()).count() == 1


def test_readers(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.csv").write_text("date,x\n2024-01-02,2\n2024-01-01,bad\n")
    (folder / "a.csv").write_text("date,x\nnot a date,1\n")
    df = readers.read_source(spark, str(folder / "b.csv"), schema="date string, x string", ordered=True)
    assert [r["date"] for r in df.collect()] == [datetime(2024, 1, 1), datetime(2024, 1, 2)]
    assert readers.resolve_csv(spark, str(folder)).endswith("a.csv")
    assert readers.resolve_csv(spark, str(folder), "b.csv").endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        readers.resolve_csv(spark, str(folder), "c.csv")
    both = readers.SOURCES.read(spark, "folder", folder=str(folder), every=True, numeric=("x",), schema="date string, x string")
    assert both.count() == 3 and both.where(F.col("x").isNull()).count() == 1 and "source_file" in both.columns
    with pytest.raises(ValueError, match="available"):
        readers.SOURCES.create("carrier pigeon")
    with pytest.raises(ValueError):
        readers.read_source(spark, "postgresql://somewhere/db")
    options = readers.jdbc_options("jdbc:x", table="t", partition_column="id", lower=0, upper=9, partitions=3)
    assert options["numPartitions"] == "3" and options["dbtable"] == "t"
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"data": [{"date": "2024-01-01", "v": 1.0}, {"date": "2024-01-03", "v": 2.0}]}))
    got = readers.read_json_pages(spark, str(pages), "date string, v double", start=datetime(2024, 1, 2))
    assert [r["v"] for r in got.collect()] == [2.0]
    flat = readers.read_json_pages(spark, str(pages), "date string, v double",
                                   parse=lambda raw: raw.select(F.lit("2024-01-01").alias("date"), F.length("value").alias("v")))
    assert flat.count() == 1


def test_read_joins_the_columns_of_all_partitions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{lake.path('raw')}/date=2024-01-01")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{lake.path('raw')}/date=2024-01-02")
    with pytest.raises(FileNotFoundError):
        lake.read("raw")  # files that no commit has entered
    assert lake.log("raw").adopt() == 2 and lake.log("raw").adopt() == 0
    got = {(r["a"], r["b"]) for r in lake.read("raw").collect()}
    assert got == {(1, None), (2, "x")}


def dated(spark, rows):
    return spark.createDataFrame(rows, "date date, who string, x long")


def test_file_table(spark, tmp_path):
    """Commits, replaced and emptied dates, columns that widen, and files of writers that are not done."""
    log = Lake(spark, str(tmp_path / "lake")).log("clean")
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    first, counts = log.write(dated(spark, [(one, "a", 1), (one, "b", 2), (two, "a", 3)]), "append")
    assert counts == [(one, 2), (two, 1)] and log.dates() == [one, two]
    # a writer that has put its files but not committed them
    dated(spark, [(one, "z", 9)]).withColumn("commit", F.lit("9-dead")).write.mode("append").partitionBy("date", "commit").parquet(log.layer)
    assert log.read([one]).count() == 2 and log.read().count() == 3
    log.write(dated(spark, [(one, "c", 4)]), "replace", [one, two])
    assert log.dates() == [one] and [r.who for r in log.read().collect()] == ["c"]
    assert log.dates(first) == [one, two] and log.read(upto=first).count() == 3  # as it was
    log.write(dated(spark, [(two, "d", 5)]).withColumn("y", F.lit(1.5)), "append")
    assert {(r.who, r.x, r.y) for r in log.read().collect()} == {("c", 4, None), ("d", 5, 1.5)}
    assert {(r.date, r.rows) for r in log.counts().collect()} == {(one, 1), (two, 1)}
    assert log.write(dated(spark, []), "append")[1] == []
    with pytest.raises(ValueError):
        log.write(dated(spark, []), "upsert")


def test_columns_of_different_types():
    from pyspark.sql.types import StructType

    from tidemark.sources.filelog import merged

    assert merged([StructType.fromDDL("a int, b string"), StructType.fromDDL("a bigint, c double")]).simpleString() == "struct<a:bigint,b:string,c:double>"
    with pytest.raises(ValueError):
        merged([StructType.fromDDL("a int"), StructType.fromDDL("a string")])


def days(spark, who, first, n, value=1.0, start=0):
    rows = [(who, START + timedelta(days=first + i), start + i, value + i % 7) for i in range(n)]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def replaced_dates(work):
    """The dates of the last write of features."""
    entries = work.lake.log(FEATURES).entries()
    last = entries.agg(F.max("commit")).first()[0]
    return sorted({r.date for r in entries.where(F.col("commit") == last).collect()})


def test_a_late_row_rewrites_only_the_dates_it_reaches(spark):
    """A dense and a sparse entity; rows that come weeks late change the next k rows of their entity."""
    build = lambda: LakeJob(spark, scratch_path(spark, "job"), SPEC, ("x",), lags=(1, 3), windows=(2,))
    gap = days(spark, "dense", 10, 1, start=500)
    sparse = spark.createDataFrame([("sparse", START + timedelta(days=12 * i), 900 + i, float(i)) for i in range(6)], SPEC_SCHEMA)
    dense = days(spark, "dense", 0, 10).union(days(spark, "dense", 11, 51, start=20))
    late = spark.createDataFrame([("sparse", START + timedelta(days=13), 950, 7.5)], SPEC_SCHEMA)
    work, full = build(), build()
    work.run(dense.union(sparse))
    work.ingest(gap)
    work.clean()
    done = work.features(lookback="rows")
    near = [(START + timedelta(days=10 + i)).date() for i in range(4)]
    assert replaced_dates(work) == near and set(done) <= set(near)
    work.ingest(late)
    work.clean()
    work.features(lookback="rows")
    assert replaced_dates(work) == [(START + timedelta(days=d)).date() for d in (13, 24, 36, 48)]
    full.ingest(dense.union(sparse).union(gap).union(late))
    full.clean()
    full.features(lookback="rows")
    assert content(work.lake.read(FEATURES)) == content(full.lake.read(FEATURES))


def test_history_is_read_backwards_until_it_suffices(spark):
    from tidemark.plans.lake_job import date_groups, tail_rows

    lake = Lake(spark, scratch_path(spark, "lake"))
    rows = days(spark, "a", 0, 40).union(spark.createDataFrame([("b", START + timedelta(days=i), 700 + i, 1.0) for i in (0, 2, 5, 39)], SPEC_SCHEMA))
    lake.write(rows, CLEAN, "at")
    dates = lake.dates(CLEAN)
    tail = tail_rows(lake, CLEAN, SPEC, lake.read_date(CLEAN, dates[39]), dates[:39], 3)
    assert sorted((r.who, r.id) for r in tail.collect()) == [("a", 36), ("a", 37), ("a", 38), ("b", 700), ("b", 702), ("b", 705)]
    assert date_groups([dates[0], dates[3], dates[9]], dates, 4) == [[dates[0], dates[3]], [dates[9]]]
