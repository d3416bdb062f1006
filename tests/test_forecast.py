from datetime import datetime

import pytest

from incidentry.operators.forecast import forecast


def series(spark, counts, start=(2020, 1)):
    made = []
    for i, n in enumerate(counts):
        year, month = start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1
        made += [(datetime(year, month, 3),)] * n
    return spark.createDataFrame(made, "incident_date timestamp_ntz")


def ahead(spark, counts, horizon=3, **options):
    got = forecast(series(spark, counts), horizon, **options).orderBy("date").collect()
    return [r for r in got if r["forecast"] is not None]


def test_single_month_has_no_band(spark):
    rows = ahead(spark, [4])
    assert [(r["forecast"], r["lower"], r["upper"]) for r in rows] == [(4.0, None, None)] * 3


def test_two_months_use_mean_and_at_least_root_of_mean(spark):
    row = ahead(spark, [4, 4])[0]
    assert row["forecast"] == 4.0 and row["upper"] == pytest.approx(4 + 1.96 * 2) and row["lower"] == pytest.approx(4 - 1.96 * 2)


def test_damped_line_for_a_few_months(spark):
    assert [r["forecast"] for r in ahead(spark, [10, 1, 50, 100])] == pytest.approx([110, 120, 130])
    assert [r["forecast"] for r in ahead(spark, [100, 90, 50, 10])] == pytest.approx([9, 8, 7])


def test_season_repeats_and_gap_months_count_as_zero(spark):
    counts = [1, 0, 0, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    rows = ahead(spark, counts, 14)
    assert [r["forecast"] for r in rows] == counts + counts[:2]


def test_trend_is_capped_and_zero_base_gives_ten_percent(spark):
    rising = ahead(spark, [10] * 12 + [20] * 12, 1)[0]
    assert rising["forecast"] == pytest.approx(22)
    sparse = ahead(spark, [1] + [0] * 12 + [5] * 12, 1)[0]
    assert sparse["forecast"] == pytest.approx(5.5)


def test_log_space_is_capped(spark):
    rows = ahead(spark, [1, 1, 1, 30], 6, log_space=True)
    assert all(0 <= r["lower"] <= r["forecast"] <= 90 and r["upper"] <= 120 for r in rows)


def test_flat_repeats_last_month(spark):
    assert [r["forecast"] for r in ahead(spark, [3, 9, 7], 2, flat=True)] == [7.0, 7.0]
