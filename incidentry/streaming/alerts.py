"""Routing alerts: policy, message, channels, cooldown gate and outbox, the same for tables and for streams."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from incidentry.functions.clock import micros
from incidentry.functions.wording import alert_reason
from incidentry.operators.gate import KEY_BYTES, alert_key, with_gate
from incidentry.operators.rules import with_alerts
from incidentry.session import drop_shuffles

CHANNEL_NAMES = {"sms": "SMS", "email": "Email"}
ALERT = "alert_key string, alert_id bigint, channel string, reason string, message string, event_time timestamp"
GATED = f"{ALERT}, allowed boolean"
ROUTED = f"{GATED}, result string"
ARRIVAL_DELAY = "1 hour"  # how far clocks may be apart
KEY_GROUPS = 1024
FEW_ROWS = 16
NEVER = -(1 << 63)
READ = (  # columns of an incident that policy, message and gate read
    "incident_id", "incident_date", "incident_datetime", "severity", "incident_type", "location", "notification_delay_days", "reportable_bin"
)
INCIDENT_KEY = ("incident_id", "alert_reason", "channel")


def _result(channel: Column, reason: Column, allowed: Column) -> Column:
    name = F.coalesce(*[F.when(channel == key, label) for key, label in CHANNEL_NAMES.items()], F.initcap(channel))
    return (
        F.when(reason.isNull(), "No alert: policy not matched.")
        .when(channel.isNull(), "No channels configured.")
        .when(allowed, F.concat(name, F.lit(" queued.")))
        .otherwise(F.concat(name, F.lit(" skipped: cooldown.")))
    )


def with_channels(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per alert and channel; rows without an alert, or without channels, stay single."""
    names = F.array(*[F.lit(name) for name in channels]).cast("array<string>")
    chosen = F.when(F.col("alert_reason").isNotNull(), names)
    return df.select("*", F.explode_outer(chosen).alias("channel"))


def planned(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Policy, message and channels of every incident; works on tables and on streams."""
    return with_channels(with_alerts(df), channels)


def route(df: DataFrame, channels: Sequence[str], time: str = "incident_datetime", cooldown_seconds: int = 3600) -> DataFrame:
    """What happens to every incident of a table: reason, message, channel and result line.

    Of repeated incidents exactly one passes; an incident without a time is held back.
    """
    routed = planned(df, channels)
    due = routed.where("channel is not null")
    gated = with_gate(due, INCIDENT_KEY, time, "incident_id", cooldown_seconds)
    idle = routed.where("channel is null").withColumn("allowed", F.lit(False))
    return gated.unionByName(idle).withColumn(
        "result", _result(F.col("channel"), F.col("alert_reason"), F.col("allowed"))
    )


def _passing(times: np.ndarray, last: int | None, cooldown: int) -> tuple[list[int], int | None]:
    """Places in sorted times at which an alert passes, and the time of the last one that did."""
    passed: list[int] = []
    place = 0 if last is None else int(np.searchsorted(times, last + cooldown))
    while place < len(times):
        passed.append(place)
        last = int(times[place])
        place = max(place + 1, int(np.searchsorted(times, last + cooldown)))
    return passed, last


def _gate_keys(codes: np.ndarray, times: np.ndarray, last: np.ndarray, cooldown: int) -> np.ndarray:
    """Which rows pass, of rows in the order of their key's code and time; ``last`` per code (NEVER: none has passed) is brought up to date in place.

    Keys with few rows are taken a row of each at a time, as nearly all keys have few; keys with more one by one.
    """
    passed = np.zeros(len(codes), dtype=bool)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(codes)))
    for place in np.flatnonzero(counts > FEW_ROWS).tolist():
        low, code = int(starts[place]), codes[starts[place]]
        found, reached = _passing(times[low : low + counts[place]], None if last[code] == NEVER else int(last[code]), cooldown)
        passed[low + np.array(found, dtype=int)] = True
        last[code] = reached
    for step in range(FEW_ROWS):
        rows = starts[(counts > step) & (counts <= FEW_ROWS)] + step
        if not len(rows):
            break
        before = last[codes[rows]]
        rows = rows[(before == NEVER) | (times[rows] >= before + cooldown)]
        passed[rows] = True
        last[codes[rows]] = times[rows]
    return passed


def _packed_state(names: list[str], keys: np.ndarray, last: np.ndarray, seen: np.ndarray) -> bytes:
    """Keys, the time each last passed (a row per channel) and when it was last seen; channels mostly agree, so a row is kept as its difference to the one before."""
    numbers = np.vstack([np.diff(last, axis=0, prepend=np.zeros((1, len(keys)), np.int64)), seen[None]])
    planes = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(len(numbers), -1, 8).transpose(0, 2, 1)
    return zstandard.compress(json.dumps(names).encode() + b"\n" + keys.tobytes() + planes.tobytes())


def _unpacked_state(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    head, _, body = zstandard.decompress(bytes(data)).partition(b"\n")
    names = json.loads(head)
    n = len(body) // (KEY_BYTES + 8 * (len(names) + 1))
    planes = np.frombuffer(body, np.uint8, offset=n * KEY_BYTES).reshape(len(names) + 1, 8, n)
    numbers = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(len(names) + 1, n)
    return names, np.frombuffer(body, f"S{KEY_BYTES}", n), np.cumsum(numbers[:-1], axis=0), numbers[-1]


def _gate_state(cooldown_seconds: int, idle_ms: int, carried: Sequence[str] | None = None, channels: Sequence[str] | None = None):
    """Decides a group of keys. With ``channels`` each row is an alert in all of them, decided by the channel's own times: ``allowed0``, ``allowed1`` and so on."""
    cooldown, own = cooldown_seconds * 1_000_000, [""] if channels is None else list(channels)
    shown = ["allowed"] if channels is None else [f"allowed{i}" for i in range(len(own))]

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # no key of the group has had an alert for so long
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        rows = pd.concat(list(batches), ignore_index=True)
        codes, keys = pd.factorize(rows["alert_key"])
        hashes = np.frombuffer(b"".join([hashlib.sha256(key.encode()).digest()[:KEY_BYTES] for key in keys.tolist()]), f"S{KEY_BYTES}")
        names, known, passed_at, seen = own, hashes[:0], np.zeros((len(own), 0), np.int64), np.zeros(0, np.int64)
        if state.exists:
            before, known, passed_at, seen = _unpacked_state(state.get[0])
            names = list(dict.fromkeys([*before, *own]))  # a channel that is new has let nothing pass
            passed_at = np.vstack([passed_at, np.full((len(names) - len(before), len(known)), NEVER)])
            live = seen > now - idle_ms
            known, passed_at, seen = known[live], passed_at[:, live], seen[live]
        last = np.full((len(names), len(keys)), NEVER)
        rest = np.ones(len(known), bool)
        if len(known):
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            met = known[place] == hashes
            last[:, met], rest[place[met]] = passed_at[:, place[met]], False

        timed = np.flatnonzero(rows["event_time"].notna().to_numpy())
        times = rows["event_time"].to_numpy("datetime64[us]")[timed].astype("int64")
        order = np.lexsort((rows["alert_id"].to_numpy()[timed], times, codes[timed]))
        timed, times = timed[order], times[order]
        allowed = np.zeros((len(own), len(rows)), dtype=bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, at in enumerate(last[names.index(name)] for name in own):
            alike = next((found for start, *found in done if np.array_equal(start, at)), None)
            if alike is None:
                start = at.copy()
                alike = [_gate_keys(codes[timed], times, at, cooldown), at]
                done.append((start, *alike))
            allowed[i, timed], at[:] = alike

        kept = last.max(axis=0) != NEVER
        known, seen = np.concatenate([known[rest], hashes[kept]]), np.concatenate([seen[rest], np.full(int(kept.sum()), now, np.int64)])
        passed_at, order = np.hstack([passed_at[:, rest], last[:, kept]]), np.argsort(known)
        state.update((_packed_state(names, known[order], passed_at[:, order], seen[order]),))
        state.setTimeoutTimestamp(now + idle_ms)
        together = np.argsort(rows["alert_id"].to_numpy(), kind="stable")  # what is written packs better if rows of an alert stand together
        yield rows[ALERT_NAMES if carried is None else list(carried)].assign(**dict(zip(shown, allowed))).iloc[together]

    return decide


ALERT_NAMES = [part.split(" ")[0] for part in ALERT.split(", ")]


def dealt(df: DataFrame, *by: str, key_groups: int = KEY_GROUPS) -> DataFrame:
    """The stream shuffled by hash groups of ``by``, columns that keys have in common, for ``gate_stream``: columns made afterwards are not shuffled."""
    arriving = df.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", ARRIVAL_DELAY)
    return arriving.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(key_groups))).repartition("_group")


def gate_stream(
    alerts: DataFrame, cooldown_seconds: int = 3600, idle_seconds: int | None = None, key_groups: int = KEY_GROUPS, channels: Sequence[str] | None = None
) -> DataFrame:
    """Stream of alerts (columns of ALERT, or others beside ``alert_key``, ``alert_id`` and ``event_time``) -> the same rows with ``allowed``. Every row comes out, however late it is.

    State per key is the event time of the last alert that passed. A row of the key that is older, or within the cooldown after it, is held
    back, like a row without a time. A key is forgotten when it has been idle for ``idle_seconds``: four cooldowns, a day at least. The
    watermark is on the time of arrival, as one on the event time would discard late rows before the gate sees them.

    With ``channels``, each named once, a row stands for an alert in each of them, its key is the same for all, and ``allowed`` is an array in their order, each
    decided by when that channel last let the key pass. So rows of all channels are shuffled and handed over once.

    Keys are handled ``key_groups`` hash groups at a time, as a call of a state function costs far more than a key. The state of a group is
    written whenever one of its keys has an alert, some 20 bytes a key, so choose their number for some thousand live keys each, and keep it
    with the checkpoint. Alerts may have been ``dealt`` before.
    """
    idle = max(86_400, 4 * cooldown_seconds) if idle_seconds is None else idle_seconds
    grouped = alerts if "_group" in alerts.columns else dealt(alerts, "alert_key", key_groups=key_groups)
    fields = [field for field in alerts.schema.fields if field.name not in ("_group", "_arrival")]
    names = [field.name for field in fields]
    flags = ["allowed"] if channels is None else [f"allowed{i}" for i in range(len(channels))]
    shape = T.StructType([*fields, *[T.StructField(flag, T.BooleanType()) for flag in flags]])
    decide = _gate_state(cooldown_seconds, 1000 * idle, names, channels)
    gated = grouped.groupBy("_group").applyInPandasWithState(decide, shape, "lasts binary", "append", GroupStateTimeout.EventTimeTimeout)
    return gated if channels is None else gated.select(*names, F.array(*flags).alias("allowed"))


def keyed_alerts(df: DataFrame, key_parts: Sequence[str], time: str, alert_id: str, *more: str | Column) -> DataFrame:
    """The columns the gate reads, and ``more``. ``channel``, ``alert_reason`` and ``alert_message`` are taken over where they are there."""
    here = {name: F.col(name) if name in df.columns else F.lit(None).cast("string") for name in ("channel", "alert_reason", "alert_message")}
    return df.select(
        alert_key(*key_parts).alias("alert_key"),
        F.col(alert_id).cast("bigint").alias("alert_id"),
        here["channel"].alias("channel"),
        here["alert_reason"].alias("reason"),
        here["alert_message"].alias("message"),
        F.timestamp_micros(micros(time)).alias("event_time"),
        *more,
    )


def route_stream(df: DataFrame, channels: Sequence[str], time: str = "incident_datetime", cooldown_seconds: int = 3600) -> DataFrame:
    """``route`` for a stream of incidents: the columns of ROUTED, a row per incident and channel.

    Incidents that match the policy are shuffled as they arrive; message, keys and rows per channel are made behind the shuffle.
    """
    names, matched = list(channels), alert_reason().isNotNull()
    idle = keyed_alerts(planned(df.where(~matched) if names else df, names), INCIDENT_KEY, time, "incident_id").withColumn("allowed", F.lit(False))
    routed = idle
    if names:
        due = with_alerts(dealt(df.where(matched), INCIDENT_KEY[0]))
        keyed = keyed_alerts(due, INCIDENT_KEY[:2], time, "incident_id", "_group", "_arrival", F.col(INCIDENT_KEY[0]).cast("string").alias("incident_id")).drop("channel")
        own = list(dict.fromkeys(names))
        passed = [F.col("allowed")[own.index(name)] & F.lit(cooldown_seconds <= 0 or name not in names[:i]) for i, name in enumerate(names)]  # one of equal alerts
        each = [F.struct(F.lit(name).alias("channel"), flag.alias("allowed")) for name, flag in zip(names, passed)]
        gated = gate_stream(keyed, cooldown_seconds, channels=own).withColumnRenamed("reason", "alert_reason")
        gated = gated.withColumn("each", F.explode(F.array(*each))).select("*", "each.channel", F.col("each.allowed").alias("passed"))
        line = [alert_key(*INCIDENT_KEY).alias("alert_key"), "alert_id", "channel", F.col("alert_reason").alias("reason"), "message", "event_time"]
        routed = gated.select(*line, F.col("passed").alias("allowed")).unionByName(idle)
    return routed.withColumn("result", _result(F.col("channel"), F.col("reason"), F.col("allowed")))


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """An id that is kept with the checkpoint, so that batch numbers of another checkpoint never meet those of this one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{checkpoint.rstrip('/')}-run")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        return files.listStatus(folder)[0].getPath().getName()
    run = uuid.uuid4().hex
    files.mkdirs(hadoop.Path(folder, run))
    return run


def _own_key() -> Column:
    """The key that a routed incident has, out of the columns of its row."""
    return alert_key("alert_id", "reason", "channel")


def deliver(routed: DataFrame, outbox: str, checkpoint: str) -> StreamingQuery:
    """Append a gated or routed stream to the outbox table and stop when the available input is used up.

    Each batch of each checkpoint owns one folder, which a replay overwrites, so an alert is not delivered twice and none of another
    run is lost. Rows that were held back are kept too, with ``allowed`` false. Sending is left to whatever reads the outbox, by ``read_outbox``:
    a key that is the hash of its own row's id, reason and channel, most of what a row would take, is not stored but made again there.
    """
    spark = routed.sparkSession
    run = _run_id(spark, checkpoint)
    lines = routed if "result" in routed.columns else routed.withColumn("result", F.lit(None).cast("string"))

    def write(batch: DataFrame, number: int) -> None:
        stored = batch.withColumn("alert_key", F.when(F.col("alert_key") != _own_key(), F.col("alert_key")))
        stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{outbox}/run={run}/batch={number}")
        drop_shuffles(batch)  # else they stay until the driver happens to collect its garbage

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_results(spark: SparkSession, outbox: str) -> DataFrame:
    """Every row that went through the gate; none for an outbox that is empty or not there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(outbox)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    stored = spark.read.schema(f"{ROUTED}, run string, batch bigint").option("basePath", outbox).parquet(outbox).drop("run", "batch")
    return stored.withColumn("alert_key", F.coalesce("alert_key", _own_key()))


def read_outbox(spark: SparkSession, outbox: str) -> DataFrame:
    """The alerts to send: key, id, channel, reason, message and time."""
    return read_results(spark, outbox).where("allowed").select(*ALERT_NAMES)
