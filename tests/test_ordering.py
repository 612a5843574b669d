import numpy as np
import pytest

from tidegauge.operators import ordering


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(rng.permutation(n), rng.normal(size=n))], "id bigint, v double")


def test_ordinal_counts_every_row_once(spark):
    got = sorted((r["id"], r["rn"]) for r in ordering.with_ordinal(table(spark, 500), "id").collect())
    assert got == [(i, i) for i in range(500)]


def test_running_total_in_pieces_equals_whole(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i, 1 + i % 5) for i in range(300)], "g int, o bigint, k bigint")
    whole = {(r.g, r.o): r.s for r in ordering.running_total(df, ["g"], ["o"], "k", "s").collect()}
    monkeypatch.setattr(ordering, "ONE_TASK", 0)
    assert {(r.g, r.o): r.s for r in ordering.running_total(df, ["g"], ["o"], "k", "s").collect()} == whole


def test_fraction_split_rules(spark):
    df = ordering.fraction_split(ordering.with_ordinal(table(spark, 101), "id"))
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 60, "validation": 20, "test": 21}
    with pytest.raises(ValueError):
        ordering.fraction_split(df, 0.5, 0.2, 0.2)
    with pytest.raises(ValueError):
        ordering.fraction_split(table(spark, 2).withColumnRenamed("id", "rn"))


@pytest.mark.parametrize(
    "n, size, least, drop, expected",
    [(1000, 500, None, False, (2, 1000)), (1100, 500, None, False, (2, 1100)), (1250, 500, None, False, (3, 1250)), (1100, 500, None, True, (2, 1000)), (100, 500, None, False, (1, 100)), (1001, 500, 2, False, (2, 1001)), (1002, 500, 2, False, (3, 1002))],
)
def test_last_window(n, size, least, drop, expected):
    assert ordering.last_window(n, size, least, drop) == expected


def test_calendar_windows_drop_small_periods(spark):
    df = spark.sql("SELECT timestamp('2024-01-05') AS t UNION ALL SELECT timestamp('2024-01-06') UNION ALL SELECT timestamp('2024-02-01') UNION ALL SELECT timestamp('2024-04-01') UNION ALL SELECT timestamp('2024-04-02')")
    got = sorted({(r["window_index"], r["window_label"]) for r in ordering.calendar_windows(df, "t", "M", 2).collect()})
    assert got == [(0, 0), (1, 2)]
    with pytest.raises(ValueError):
        ordering.calendar_windows(df.selectExpr("1 AS t"), "t")


def test_sample_matches_numpy(spark):
    df = ordering.with_ordinal(table(spark, 300), "id")
    assert sorted(r["rn"] for r in ordering.sample_rows(df, 300, 50, 7).collect()) == list(ordering.drawn(300, 50, 7))


def test_window_guard(spark):
    df = spark.range(3).withColumnRenamed("id", "window_index")
    ordering.require_windows(df, 3)
    with pytest.raises(ValueError):
        ordering.require_windows(df, 4)
