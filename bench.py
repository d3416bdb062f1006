"""Times the headline work at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each entry is run once to warm up, then three times ($BENCH_RUNS); the median counts. Training, clusters, all-rows similarity and the stream are
timed once and left out of the total. Results are written to the noop sink. The
incident view over the order tables is stored once, as a raw table would be; preparation reads it, and reports read the prepared
table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import events
from incidentry.models import classifiers
from incidentry.operators import carers, clustering, correlation, forecast, gate, geography, reports, similarity
from incidentry.plans.prepare import prepare
from incidentry.session import clear_scratch, scratch_path
from incidentry.sources.incidents import write_prepared
from incidentry.sources.orders_view import incidents
from incidentry.streaming.alerts import deliver, read_outbox, route, route_stream

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("incidentry-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="incidentry-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def work(spark: SparkSession, raw: DataFrame, table: DataFrame) -> dict:
    """Name -> a function that builds and uses up the result."""
    alerts = table.withColumn("notification_delay_days", F.floor(F.col("report_delay_hours") / 24).cast("double"))
    frame = {
        "a1_executive_kpis": reports.executive_kpis,
        "a4_monthly_by_severity": reports.monthly_by_severity,
        "a7_hour_by_cause": reports.hour_by_cause,
        "a9_carer_workload": carers.carer_workload,
        "a10_carer_profile": carers.carer_profile,
        "a12_compliance_kpis": carers.compliance_kpis,
        "a13_compliance_by_carer": lambda d: carers.worst_compliance(carers.compliance_by_carer(d)),
        "a14_delay_by_carer": lambda d: carers.worst_delay(carers.delay_by_carer(d)),
        "a16_stages_by_carer": carers.stage_counts,
        "a17_factors_by_month": reports.factors_by_month,
        "a19_weekday_hour": reports.weekday_hour_matrix,
        "a21_type_profile": carers.risk_profile,
        "f15_high_risk_pairs": lambda d: carers.high_risk_pairs(carers.risk_network(d)),
        "a24_correlations": lambda d: correlation.correlation_matrix(
            d, ["participant_age", "severity_numeric", "reportable_bin", "hour", "report_delay_hours"]
        ),
        "m1_forecast_by_location": lambda d: forecast.forecast(d, 6, ["location"]),
        "g5_density": lambda d: geography.density(geography.map_points(d)),
    }
    jobs = {name: (lambda build=build: use(build(table))) for name, build in frame.items()}
    jobs["ml1_prepare"] = lambda: use(prepare(raw))
    jobs["st1_route"] = lambda: use(route(alerts, ["sms", "email"]))
    jobs["w7_cooldown"] = lambda: use(gate.with_gate(events(spark, FOLDER), ["user_id", "event_type"], "ts", "event_id", 86_400))

    def similar() -> None:
        vectors = similarity.unit_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), "vec_id", ["embedding"])
        use(similarity.similar(vectors, vectors.orderBy("id").limit(100), 5))

    jobs["si1_similar_100"] = similar
    return jobs


def long_work(spark: SparkSession, raw: DataFrame, table: DataFrame) -> dict:
    """Work that is timed once: training, clusters, all-rows similarity, and the alert stream."""
    alerts = table.withColumn("notification_delay_days", F.floor(F.col("report_delay_hours") / 24).cast("double"))

    def all_similar() -> None:
        use(similarity.similar_to_all(similarity.unit_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), "vec_id", ["embedding"]), 3))

    def stream() -> None:
        arrivals, outbox, state = (scratch_path(spark, name) for name in ("arrivals", "outbox", "state"))
        alerts.write.parquet(arrivals)
        deliver(route_stream(spark.readStream.schema(alerts.schema).parquet(arrivals), ["sms", "email"]), outbox, state).awaitTermination()
        use(read_outbox(spark, outbox))

    return {
        "ml6_ml7_train": lambda: classifiers.compare_models(table, cross_validate=False),
        "cl1_clusters": lambda: use(clustering.clusters(clustering.cluster_features(table), starts=3)),
        "si2_similar_to_all": all_similar,
        "st3_stream": stream,
    }


def main() -> None:
    spark = session()
    stored, path = scratch_path(spark, "raw"), scratch_path(spark, "prepared")
    incidents(spark, FOLDER).repartition(int(CPUS)).write.parquet(stored)
    raw = spark.read.parquet(stored)
    started = time.perf_counter()
    write_prepared(prepare(raw), path)
    once: dict[str, float] = {}
    seconds = {"write_prepared_cold": round(time.perf_counter() - started, 3)}
    table = spark.read.parquet(path)
    for name, job in work(spark, raw, table).items():
        job()
        times = []
        for _ in range(RUNS):
            started = time.perf_counter()
            job()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
    for name, job in long_work(spark, raw, table).items():
        started = time.perf_counter()
        job()
        once[name] = round(time.perf_counter() - started, 3)
    total = round(sum(value for name, value in seconds.items() if name != "write_prepared_cold"), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": total, "unit": "sec", "queries": seconds | once, "sf": FOLDER.rsplit("sf", 1)[-1]}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
