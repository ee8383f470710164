"""Readers, sinks and streaming jobs on temporary folders."""

import json
from datetime import date, datetime
from decimal import Decimal

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import inventory, tokens
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import drops as D

GUID = "2b87f7b4-e1d9-35e4-fedc-338162c66672"


def manifest(folder, rows, version="1.2"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "manifest.json").write_text(json.dumps({
        "dataRowCount": rows, "exportConfig": {"exportName": "e", "dataVersion": version, "resourceId": f"/s/{GUID}"},
        "runInfo": {"runId": "r", "executionType": "x"}, "blobs": [{"blobName": "a", "dataRowCount": rows}]}, indent=1))


def test_discover_and_audit_drops(spark, tmp_path):
    for name, stated in (("31 July 2026", 3), ("30 June 2026", 5)):
        spark.range(3).select(F.lit("1.2").alias("x_SchemaEra")).write.parquet(str(tmp_path / name), mode="append")
        manifest(tmp_path / name, stated)
    manifests = readers.read_manifests(spark, str(tmp_path))
    found = readers.read_labelled_exports(spark, str(tmp_path)).withColumnRenamed("drop_id", "x_FixtureId")
    audit = {r["drop_id"]: r["verdict"] for r in inventory.drop_audit(
        found, manifests.select("drop_id", "rows_stated")).collect()}
    assert audit == {"31 July 2026": "MATCH", "30 June 2026": "MISMATCH"}
    expected = spark.createDataFrame([("31 July 2026",), ("31 May 2026",)], "drop_id string")
    assert [r[0] for r in readers.missing_drops(manifests, expected).collect()] == ["31 May 2026"]
    assert readers.read_export(spark, str(tmp_path / "31 July 2026"), str(tmp_path / "30 June 2026")).count() == 6


def test_csv_empty_is_null_and_header_is_checked(spark, tmp_path):
    good = tmp_path / "p.csv"
    good.write_text("BillingPeriodStart,BillingPeriodEnd,BillingPeriodStatus,BillingPeriodCreated,BillingPeriodLastUpdated,"
                    "InvoiceIssuerName\n2026-06-01T00:00:00+02:00,2026-07-01T00:00:00Z,Closed,,,X\n")
    row = readers.read_billing_periods(spark, str(good)).first()
    assert row["BillingPeriodCreated"] is None and row["BillingPeriodStart"].startswith("2026-06-01")
    bad = tmp_path / "bad.csv"
    bad.write_text(good.read_text().replace("BillingPeriodStart", "Start"))
    with pytest.raises(Exception):
        readers.read_billing_periods(spark, str(bad)).collect()


def test_companion_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(datetime(2026, 7, 1), "a,\"b\"")], "BillingPeriodStart timestamp_ntz, note string")
    sinks.write_companion(frame, str(tmp_path / "out"), ["BillingPeriodStart"])
    row = spark.read.option("escape", '"').csv(str(tmp_path / "out"), header=True).first()
    assert row["BillingPeriodStart"] == "2026-07-01T00:00:00Z" and row["note"] == 'a,"b"'


def test_gate_writes_nothing_on_a_leak(spark, tmp_path):
    frame = spark.createDataFrame([(f"/s/{GUID}", "")], "ResourceId string, x_Empty string")
    with pytest.raises(sinks.LeakFound):
        sinks.write_sanitised(frame, str(tmp_path / "bad"), spare=("ResourceId",))
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "bad"))
    assert all(spark.read.parquet(str(f)).count() == 0 for f in (tmp_path / "bad").glob("version-*"))
    meta = spark.createDataFrame([({"id": GUID},)], "exportConfig map<string,string>")
    version = sinks.write_sanitised(frame, str(tmp_path / "good"), meta)
    out = sinks.read_published(spark, str(tmp_path / "good")).first()
    assert GUID not in out["ResourceId"] and out["x_Empty"] == ""
    assert GUID not in str(spark.read.json(str(tmp_path / "good" / f"{version}_manifest")).first())


def test_a_failed_publication_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "layer")
    one, two = (spark.createDataFrame([(f"{n} {GUID}",)] * n, "ResourceId string") for n in (1, 2))
    sinks.write_sanitised(one, path)
    with pytest.raises(sinks.LeakFound):
        sinks.write_sanitised(two, path, spare=("ResourceId",))
    assert sinks.read_published(spark, path).count() == 1

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks.Z, "leak_scan", dies)
    with pytest.raises(RuntimeError):
        sinks.write_sanitised(two, path)
    assert sinks.read_published(spark, path).count() == 1  # two rows lie there, uncommitted
    monkeypatch.undo()
    sinks.write_sanitised(two, path)
    assert sinks.read_published(spark, path).count() == 2
    assert [(r["sequence"], r["rows"]) for r in sinks.published_versions(spark, path).orderBy("sequence").collect()] == [(1, 1), (2, 2)]


def test_one_hot_month_is_split_by_size(spark, tmp_path):
    frame = spark.range(20_000).select(F.lit("2026-07-01").cast("date").alias("BillingPeriodStart"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        sinks.write_unified(frame.unionByName(frame.limit(3).withColumn("BillingPeriodStart", F.lit("2026-08-01").cast("date"))),
                            str(tmp_path / "u"), rows_per_file=4_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "u" / "billing_month=2026-07").glob("*.parquet"))
    assert len(files) >= 6 and max(spark.read.parquet(str(f)).count() for f in files) <= 4_000
    assert spark.read.parquet(str(tmp_path / "u")).count() == 20_003


def test_unified_write_is_partitioned_by_month(spark, tmp_path):
    frame = fx.current_layer(spark)
    sinks.write_unified(frame, str(tmp_path / "u"))
    back = spark.read.parquet(str(tmp_path / "u"))
    assert back.count() == 76 and [r[0] for r in back.select("billing_month").distinct().collect()] == ["2026-07"]


def test_results_to_csv(spark, tmp_path):
    sinks.write_results(spark, "unused", {"one": lambda s, d: s.range(2)}, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "one"), header=True).count() == 2


def test_token_log_append_and_batch_output(spark, tmp_path):
    out = tmp_path / "batch.jsonl"
    out.write_text('{"response":{"body":{"usage":{"prompt_tokens":19200,"completion_tokens":1403791}}}}\n'
                   '{"response":null}\n')
    lines = readers.read_batch_output(spark, str(out))
    row = tokens.batch_usage_cost(lines.withColumn("call_n", F.lit("b1")), ["call_n"], F.col("response.body.usage")).first()
    assert row["responses"] == 2 and row["total_tokens"] == 1422991
    assert Decimal(row["est_cost_usd"]) == Decimal("0.281718")
    log = spark.createDataFrame([], schema.TOKEN_LOG_SCHEMA)
    entry = spark.createDataFrame([("b1", 19200, 1403791)], "call_n string, prompt_tokens long, extra long")
    for _ in range(2):
        sinks.append_usage(entry, log, str(tmp_path / "log"))
    back = readers.read_token_log(spark, str(tmp_path / "log"))
    assert back.count() == 2 and back.first()["prompt_tokens"] == 19200 and back.columns == log.columns


def test_latency_is_exact_around_gaps(spark):
    at = datetime.fromisoformat
    charges = spark.createDataFrame([(at(t),) for t in (
        "2020-01-01T00:00:00", "2024-01-01T05:00:00", "2024-01-01T09:00:00", "2024-01-05T00:00:00", "2024-02-01T00:00:00")],
        "used_at timestamp_ntz")
    ticks = spark.createDataFrame([(at(t),) for t in (
        "2024-01-01T06:00:00", "2024-01-01T08:00:00", "2024-01-04T02:00:00", "2024-01-05T00:00:00")], "tick timestamp_ntz")
    rows = {str(r["day"]): r for r in tokens.billing_latency(charges, ticks).collect()}
    assert rows["2020-01-01"]["max_days"] == 1461
    assert rows["2024-01-01"]["charges"] == 2 and Decimal(rows["2024-01-01"]["max_hours"]) == Decimal("65.0")
    assert Decimal(rows["2024-01-05"]["max_hours"]) == 0
    assert rows["2024-02-01"]["unlogged"] == 1 and rows["2024-02-01"]["max_hours"] is None


DROP = "month string, run_id int, id int"


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, DROP).coalesce(1).write.parquet(str(folder / name))


def test_redelivered_months_replace(spark, tmp_path):
    landing, target, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    landing.mkdir()
    schema_ = spark.createDataFrame([], DROP).schema

    def deliver():
        stream = D.read_drops(spark, str(landing), schema_).select("month", "run_id", "id")
        D.write_month_replacements(stream, target, checkpoint, "month", ["run_id"]).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(target).select("month", "run_id", "id").collect())

    drop(spark, landing, "a", [("2026-06", 1, 1), ("2026-07", 1, 2), ("2026-07", 1, 3)])
    assert deliver() == [("2026-06", 1, 1), ("2026-07", 1, 2), ("2026-07", 1, 3)]
    drop(spark, landing, "b", [("2026-07", 3, 9)])
    assert deliver() == [("2026-06", 1, 1), ("2026-07", 3, 9)]
    drop(spark, landing, "late", [("2026-07", 2, 7), ("2026-08", 2, 8)])  # an older run arriving last
    assert deliver() == [("2026-06", 1, 1), ("2026-07", 3, 9), ("2026-08", 2, 8)]
    # The index alone says what is held: with the target out of reach the same months are known.
    months = spark.createDataFrame([("2026-07",), ("2026-08",), ("2027-01",)], "month string")
    held = D.held_versions(spark, target, months, "month")
    assert {r["_month"]: r["_held"]["run_id"] for r in held.collect()} == {"2026-07": 3, "2026-08": 2}
    assert f"{target}/" not in held._jdf.queryExecution().toString().replace("__versions/", "")
    # All of it again from the start, as after a lost checkpoint, changes nothing.
    checkpoint = str(tmp_path / "again")
    assert deliver() == [("2026-06", 1, 1), ("2026-07", 3, 9), ("2026-08", 2, 8)]


def test_first_seen_ledger_never_forgets(spark, tmp_path):
    landing, ledger, kind = tmp_path / "in", str(tmp_path / "ledger"), "at timestamp, meter string, cost int"
    landing.mkdir()

    def land(name, *rows):
        if rows:
            spark.createDataFrame([(datetime(2026, m, 1, h), meter, 1) for m, h, meter in rows], kind).coalesce(1).write.parquet(str(landing / name))
        stream = D.read_drops(spark, str(landing), spark.createDataFrame([], kind).schema).select("at", "meter", "cost")
        D.write_first_seen(stream, ["meter"], "at", ledger, str(tmp_path / name)).awaitTermination(120)
        return sorted((str(r["meter"]), r["first_seen"].month, r["first_seen"].hour, r["row_count"]) for r in D.read_first_seen(spark, ledger).collect())

    global_checkpoint = tmp_path / "one"
    assert land("one", (7, 5, "a"), (7, 3, "a"), (7, 4, None)) == [("None", 7, 4, 1), ("a", 7, 3, 2)]
    (tmp_path / "two").symlink_to(global_checkpoint)  # the same checkpoint, so these are later batches
    assert land("two", (12, 1, "a"), (12, 2, "b"), (12, 9, None)) == [("None", 7, 4, 1), ("a", 7, 3, 2), ("b", 12, 2, 1)]
    (tmp_path / "three").symlink_to(global_checkpoint)
    assert land("three", (1, 1, "a"), (1, 1, "c")) == [("None", 7, 4, 1), ("a", 7, 3, 2), ("b", 12, 2, 1), ("c", 1, 1, 1)]
    assert {r["batch_id"]: r["n"] for r in spark.read.parquet(ledger).groupBy("batch_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 1}


def test_late_rows_are_set_aside(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    kind = "at timestamp_ntz, meter string, cost decimal(10,2)"

    def land(name, *days):
        spark.createDataFrame([(datetime(2026, 7, d), "m", Decimal(1)) for d in days], kind).coalesce(1).write.parquet(
            str(landing / name))
        stream = D.read_drops(spark, str(landing), spark.createDataFrame([], kind).schema).select("at", "meter", "cost")
        D.write_with_late_rows(stream, ["meter"], "at", "cost", 5, str(tmp_path / "totals"), str(tmp_path / "late"),
                               str(tmp_path / "cp")).awaitTermination(120)

    land("one", 10, 11)
    land("two", 8, 1)  # the 8th refreshes an earlier day; the 1st is beyond the bound
    totals = {str(r["day"]): r["row_count"] for r in D.read_daily_totals(spark, str(tmp_path / "totals"), ["meter"]).collect()}
    assert totals == {"2026-07-10": 1, "2026-07-11": 1, "2026-07-08": 1}
    late = spark.read.parquet(str(tmp_path / "late")).collect()
    assert [r["at"].date() for r in late] == [date(2026, 7, 1)]


def test_first_seen_and_window_streams(spark, tmp_path):
    landing = tmp_path / "in"
    rows = [(datetime(2026, 7, 1, h), "r1" if h < 5 else "r2", Decimal(h)) for h in range(8)]
    spark.createDataFrame(rows, "at timestamp, meter string, cost decimal(10,2)").write.parquet(str(landing))
    events = spark.readStream.schema("at timestamp, meter string, cost decimal(10,2)").parquet(str(landing))

    def run(frame, name, mode):
        query = (frame.writeStream.format("memory").queryName(name).outputMode(mode)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        query.awaitTermination(120)
        return spark.table(name).collect()

    seen = run(D.first_seen_stream(events, ["meter"]), "seen", "append")
    assert sorted(r["meter"] for r in seen) == ["r1", "r2"]
    daily = run(D.daily_window(events, ["meter"], "at", "cost", "1 day"), "daily", "complete")
    assert {(r["meter"], r["row_count"]) for r in daily} == {("r1", 5), ("r2", 3)}
    drift = D.row_count_drift(D.daily_window(spark.read.parquet(str(landing)), ["meter"], "at", "cost"), ["meter"])
    assert all(r["previous"] is None for r in drift.collect())


def test_latest_delivery_keeps_rows_without_month(spark):
    from ledgerloom.streaming.drops import latest_delivery

    rows = spark.createDataFrame([(None, 1, "old"), (None, 2, "new"), ("m", 1, "kept")], "month string, v int, x string")
    assert {r.x for r in latest_delivery(rows, "month", ["v"]).collect()} == {"new", "kept"}


def test_rows_without_time_are_set_aside(spark, tmp_path):
    from ledgerloom.streaming.drops import write_with_late_rows

    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp_ntz'2026-01-05 00:00:00' AS at, 'k' AS k, CAST(1 AS decimal(38,18)) AS amount"
              " UNION ALL SELECT NULL, 'k', CAST(2 AS decimal(38,18))").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    totals, late = str(tmp_path / "totals"), str(tmp_path / "late")
    write_with_late_rows(stream, ["k"], "at", "amount", 3, totals, late, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(totals).selectExpr("sum(row_count)").first()[0] == 1
    assert spark.read.parquet(late).count() == 1
