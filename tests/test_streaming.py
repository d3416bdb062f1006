import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from incidentry.operators import gate
from incidentry.streaming import alerts

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, k string, t timestamp_ntz"


def write_in_order(spark, folder, made, files):
    size = -(-len(made) // files)
    for i in range(files):
        spark.createDataFrame(made[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_replay_in_many_batches_equals_the_fold(spark, tmp_path):
    made = [(i, "hot" if i % 3 == 0 else f"k{i % 5}", START + timedelta(seconds=37 * i)) for i in range(240)]
    folder = str(tmp_path / "in")
    write_in_order(spark, folder, made, 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    gated = alerts.gate_stream(alerts.keyed_alerts(stream, ["k"], "t", "id"), 300)
    query = alerts.deliver(gated, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    delivered = sorted(r["alert_id"] for r in alerts.read_outbox(spark, str(tmp_path / "out")).collect())
    batch = gate.with_gate(spark.createDataFrame(made, SCHEMA), ["k"], "t", "id", 300)
    assert delivered == sorted(r["id"] for r in batch.where("allowed").collect())
    again = alerts.deliver(gated, str(tmp_path / "out"), str(tmp_path / "state"))
    again.awaitTermination()
    assert sorted(r["alert_id"] for r in alerts.read_outbox(spark, str(tmp_path / "out")).collect()) == delivered


class OneState:
    """The state of one group of keys, outside a stream."""

    hasTimedOut, exists, get, now = False, False, None, 10**12

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        self.until = at


def test_keys_of_a_group_are_decided_together(monkeypatch):
    """Two runs over 3000 keys, most with few alerts, against a plain loop; only busy keys are taken one by one."""
    calls, one = [], alerts._passing
    monkeypatch.setattr(alerts, "_passing", lambda *a: calls.append(1) or one(*a))
    dice, state, last = random.Random(3), OneState(), {}
    for run in range(2):
        keys = [f"k{dice.randrange(3000)}" for _ in range(6000)] + ["busy"] * 100 + ["hot"] * 17
        times = [None if dice.random() < 0.05 else START + timedelta(seconds=dice.randrange(20_000)) for _ in keys]
        rows = pd.DataFrame({"alert_key": keys, "alert_id": range(len(keys)), "channel": "sms", "reason": "r", "message": None, "event_time": pd.to_datetime(times)})
        got = next(alerts._gate_state(3600, 10**9)((0,), iter([rows[:2500], rows[2500:]]), state))
        expected = set()
        for i in sorted((i for i, t in enumerate(times) if t), key=lambda i: (times[i], i)):
            if keys[i] not in last or times[i] - last[keys[i]] >= timedelta(hours=1):
                last[keys[i]] = times[i]
                expected.add(i)
        assert set(got.loc[got["allowed"], "alert_id"]) == expected and len(got) == len(rows)
    assert len(calls) <= 4


def test_two_alerts_never_pass_within_the_cooldown(spark):
    made = [(i, "k", START + timedelta(seconds=11 * i)) for i in range(200)]
    passed = gate.with_gate(spark.createDataFrame(made, SCHEMA), ["k"], "t", "id", 60, 2, 10).where("allowed").orderBy("t").collect()
    gaps = [b["t"] - a["t"] for a, b in zip(passed, passed[1:])]
    assert min(gaps) >= timedelta(seconds=60)


INCIDENT = ("incident_id bigint, severity string, incident_type string, location string, "
            "incident_datetime timestamp_ntz, notification_delay_days double, reportable_bin int")


def incidents(spark, rows):
    made = [(i, "High", "Fall", "x", at, None, 0) for i, at in rows]
    return spark.createDataFrame(made, INCIDENT).withColumn("incident_date", F.col("incident_datetime"))


def hour(n):
    return START + timedelta(hours=n)


def test_route_reports_repeats(spark):
    rows = [(1, hour(0)), (1, hour(0)), (1, hour(0)), (2, hour(0)), (1, hour(2)), (1, hour(2.5)), (3, None)]
    results = sorted((r["incident_id"], r["result"]) for r in alerts.route(incidents(spark, rows), ["sms"]).collect())
    held, sent = "SMS skipped: cooldown.", "SMS queued."
    assert results == [(1, sent), (1, sent), (1, held), (1, held), (1, held), (2, sent), (3, held)]


def test_late_alerts_are_delivered(spark, tmp_path):
    folder, outbox, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    lines = []
    for rows in ([(1, hour(10)), (1, hour(10))], [(2, hour(11))], [(3, hour(0)), (1, hour(9))], [(4, hour(12)), (1, hour(11)), (5, None)]):
        incidents(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(incidents(spark, rows).schema).parquet(folder)
        alerts.deliver(alerts.route_stream(stream, ["sms", "email"]), outbox, state).awaitTermination()
    lines = sorted((r["alert_id"], r["result"]) for r in alerts.read_results(spark, outbox).where("channel = 'sms'").collect())
    held, sent = "SMS skipped: cooldown.", "SMS queued."
    assert lines == [(1, sent), (1, sent), (1, held), (1, held), (2, sent), (3, sent), (4, sent), (5, held)]
    first = alerts.read_outbox(spark, outbox).where("alert_id = 3 and channel = 'email'").collect()
    assert len(first) == 1 and first[0]["reason"] == "high_severity" and "Incident 3" in first[0]["message"] and len(first[0]["alert_key"]) == 64


def test_another_checkpoint_keeps_what_was_delivered(spark, tmp_path):
    outbox = str(tmp_path / "out")
    assert alerts.read_outbox(spark, outbox).count() == 0
    for number in (1, 2):
        folder = str(tmp_path / f"in{number}")
        incidents(spark, [(number, hour(0))]).write.parquet(folder)
        stream = spark.readStream.schema(incidents(spark, [(1, hour(0))]).schema).parquet(folder)
        alerts.deliver(alerts.route_stream(stream, ["sms"]), outbox, str(tmp_path / f"state{number}")).awaitTermination()
    assert sorted(r["alert_id"] for r in alerts.read_outbox(spark, outbox).collect()) == [1, 2]


def test_key_parts_do_not_run_together(spark):
    rows = spark.createDataFrame([("1", "23"), ("12", "3"), ("1", "23"), (None, "-"), ("-", None), ("", "0:")], "a string, b string")
    keys = [r[0] for r in rows.select(gate.alert_key("a", "b")).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 5


def test_levels_of_chunks(spark, monkeypatch):
    """Many chunks, put together two at a time, with gaps between them."""
    monkeypatch.setattr(gate, "FAN", 2)
    dice = random.Random(4)
    made = [(i, dice.choice("ab"), START + timedelta(seconds=dice.choice([0, 5000, 90_000]) + dice.randrange(3000))) for i in range(500)]
    df = spark.createDataFrame(made, SCHEMA)
    allowed = {r["id"] for r in gate.with_gate(df, ["k"], "t", "id", 60, 2, 10).where("allowed").collect()}
    last, expected = {}, set()
    for i, key, at in sorted(made, key=lambda row: (row[2], row[0])):
        if key not in last or at - last[key] >= timedelta(seconds=60):
            last[key] = at
            expected.add(i)
    assert allowed == expected


def test_channels_of_a_row_are_decided_apart():
    """A channel that comes later has let nothing pass; one that is left out keeps its last alert; state is some 20 bytes a key."""
    state, n = OneState(), 5000
    rows = pd.DataFrame({"alert_key": [f"k{i}" for i in range(n)], "alert_id": range(n), "event_time": pd.to_datetime([START + timedelta(minutes=7 * i) for i in range(n)])})

    def passed(channels, minutes):
        moved = rows.assign(event_time=rows["event_time"] + pd.Timedelta(minutes=minutes))
        moved.loc[0, "event_time"] = pd.NaT
        got = next(alerts._gate_state(3600, 10**9, ["alert_key", "alert_id"], channels)((0,), iter([moved]), state))
        assert list(got.columns) == ["alert_key", "alert_id", *[f"allowed{i}" for i in range(len(channels))]]
        assert not got.loc[got["alert_id"] == 0].iloc[0, 2:].any()
        return [int(got[f"allowed{i}"].sum()) for i in range(len(channels))]

    assert passed(["sms"], 0) == [n - 1]
    assert passed(["email", "sms"], 30) == [n - 1, 0]
    assert passed(["email"], 70) == [0]
    assert passed(["sms", "email"], 70) == [n - 1, 0]
    assert passed(["sms", "email"], 90) == [0, n - 1]
    assert len(state.get[0]) < 30 * n


def test_what_a_run_leaves_on_disk(spark, tmp_path):
    """No shuffle files; rows of an alert are shuffled once, without message and key; state and outbox stay small for each."""
    files, n = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), 20_000
    shuffles = lambda: {name for name in files.getAllFiles().mkString(" ").split() if "shuffle_" in name}
    size = lambda folder, ending: sum(f.stat().st_size for f in folder.rglob(f"*{ending}"))
    made = spark.range(n).selectExpr(
        "id AS incident_id", "'High' AS severity", "'Fall' AS incident_type", "'x' AS location", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 7) AS incident_datetime",
        "CAST(null AS DOUBLE) AS notification_delay_days", "0 AS reportable_bin", "timestamp_ntz'2024-01-01' AS incident_date",
    )
    folder, outbox, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    made.union(made).write.parquet(folder)
    before, sent = shuffles(), []
    schema, write = made.schema, alerts.drop_shuffles
    alerts.drop_shuffles = lambda batch: (sent.extend(f for f in shuffles() - before if f.endswith(".data")), write(batch))
    try:
        alerts.deliver(alerts.route_stream(spark.readStream.schema(schema).parquet(folder), ["sms", "email", "email"]), outbox, state).awaitTermination()
    finally:
        alerts.drop_shuffles = write
    assert sent and shuffles() <= before
    got = alerts.read_results(spark, outbox).groupBy("channel", "allowed").count().collect()
    assert {(r["channel"], r["allowed"]): r["count"] for r in got} == {("sms", True): n, ("sms", False): n, ("email", True): n, ("email", False): 3 * n}
    assert size(tmp_path / "state", ".delta") < 40 * n
    assert size(tmp_path / "out", ".parquet") < 8 * 6 * n
    keys = alerts.read_results(spark, outbox).select(F.col("alert_key") == gate.alert_key("alert_id", "reason", "channel"), F.length("alert_key")).distinct().collect()
    assert [tuple(row) for row in keys] == [(True, 64)]


def test_keys_of_other_parts_are_stored(spark, tmp_path):
    """Only a key that its row can make again is left out of the outbox."""
    made = spark.createDataFrame([(i, f"k{i % 3}", START + timedelta(hours=i)) for i in range(6)], SCHEMA)
    keyed = alerts.keyed_alerts(made, ["k"], "t", "id")
    for name, rows in (("other", keyed), ("mine", alerts.keyed_alerts(made.selectExpr("id", "k AS alert_reason", "'sms' AS channel", "t"), ["id", "alert_reason", "channel"], "t", "id"))):
        folder, outbox = str(tmp_path / name), str(tmp_path / f"{name}-out")
        rows.coalesce(1).write.parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder).withColumn("allowed", F.lit(True))
        alerts.deliver(stream, outbox, str(tmp_path / f"{name}-state")).awaitTermination()
        assert alerts.read_outbox(spark, outbox).exceptAll(rows.select(*alerts.ALERT_NAMES)).isEmpty() and alerts.read_outbox(spark, outbox).count() == 6
        assert spark.read.parquet(f"{outbox}/*/*").where("alert_key is null").count() == (6 if name == "mine" else 0)
