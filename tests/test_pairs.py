import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimcheck.operators import comoments, correlate, ranks


def table(spark, rows, columns, missing, seed=1, ties=None):
    draw = np.random.default_rng(seed)
    values = draw.normal(size=(rows, columns)) + draw.normal(size=(rows, 1)) + 1e6 * np.arange(columns)
    if ties:
        values = np.round(draw.normal(size=(rows, columns)) * ties)
    values[draw.random(size=values.shape) < missing] = np.nan
    frame = pd.DataFrame(values, columns=[f"c{i}" for i in range(columns)])
    return frame, spark.createDataFrame(frame).repartition(5)


def close(found, wanted, name):
    got = {(r.var1, r.var2): r[name] for r in found.collect()}
    columns = list(wanted.columns)
    want = {(a, b): wanted.loc[a, b] for i, a in enumerate(columns) for b in columns[i + 1 :] if not np.isnan(wanted.loc[a, b])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


@pytest.mark.parametrize("columns,missing", [(7, 0.0), (7, 0.3), (70, 0.1)])
def test_comoments(spark, columns, missing):
    frame, df = table(spark, 700, columns, missing)
    close(correlate.pearson(df), frame.corr(), "r")


def test_many_columns_are_few_tiles(spark):
    frame, df = table(spark, 60, 500, 0.0)
    found = correlate.pearson(df)
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 200_000
    assert found.count() == 500 * 499 // 2
    row = found.where("var1 = 'c3' AND var2 = 'c444'").first()
    assert row.n == 60 and row.r == pytest.approx(frame["c3"].corr(frame["c444"]), abs=1e-7)


def test_tiles_take_several_scans_and_states_can_be_merged_later(spark, monkeypatch):
    monkeypatch.setattr(comoments, "TILE", 3)
    monkeypatch.setattr(comoments, "TILES", 4)
    frame, df = table(spark, 300, 10, 0.2)
    close(correlate.pearson(df), frame.corr(), "r")
    names, tiles = df.columns, comoments.tiles_of(list(range(10)), list(range(10)), half=True)
    days = [comoments.states(df.where(f"pmod(hash(c0), 3) = {i}"), names, tiles) for i in range(3)]
    close(comoments.correlation(comoments.merged(days[0].union(days[1]).union(days[2]), tiles), names, "r"), frame.corr(), "r")


def test_constant_missing_and_infinite_values(spark):
    rows = [(float(i), 0.1, 5.0 if i % 2 else None, float("inf") if i == 3 else float(i * i), None, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, same double, some double, odd double, none double, b double")
    got = {(r.var1, r.var2): (r.n, round(r.r, 6)) for r in correlate.pearson(df).collect()}
    assert got == {("a", "b"): (20, round(float(np.corrcoef(range(20), [i % 2 for i in range(20)])[0, 1]), 6))}
    assert correlate.pearson(df.limit(0)).isEmpty() and correlate.pearson(df.select("a")).isEmpty() and correlate.spearman(df.limit(0)).isEmpty()


@pytest.mark.parametrize("columns,missing,ties", [(5, 0.0, None), (5, 0.3, 1), (12, 0.1, 3), (4, 0.9, 1)])
def test_spearman(spark, columns, missing, ties):
    frame, df = table(spark, 900, columns, missing, ties=ties)
    frame["same_gaps"] = frame["c1"] * 2 + frame["c0"].fillna(0)  # lacks what c1 lacks
    df = df.withColumn("same_gaps", F.col("c1") * 2 + F.coalesce(F.nanvl("c0", F.lit(0.0)), F.lit(0.0)))
    close(correlate.spearman(df), frame.corr(method="spearman"), "rho")


def test_small_steps(spark, monkeypatch):
    for module in (comoments, ranks):
        monkeypatch.setattr(module, "ROWS", 3)
    frame, df = table(spark, 100, 4, 0.3, ties=1)
    close(correlate.spearman(df), frame.corr(method="spearman"), "rho")
    close(correlate.pearson(df), frame.corr(), "r")


def test_a_value_of_half_the_rows_is_dealt_out(spark, monkeypatch):
    seen, keep = [], ranks.whole_ranks
    monkeypatch.setattr(ranks, "whole_ranks", lambda parts: (seen.extend(parts), keep(parts))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 2 = 0, 7.0D, double(id % 13)) a", "if(id % 2 = 1, -0.0D, double(id % 3)) b")
        frame = df.toPandas()
        close(correlate.spearman(df), (frame + 0.0).corr(method="spearman"), "rho")
        heavy = [p.part for p in seen if p.column == 0 and p.first_value <= 7.0 <= p.last_value]
        assert len(heavy) >= 2 and max(sum(p.ranks[0] for p in seen if p.part == part) for part in {p.part for p in seen}) < 60_000
        got = sorted((r.a, r.b) for r in correlate.average_ranks(df, ["a", "b"]).collect())
        assert got == sorted(map(tuple, (frame + 0.0).rank().to_numpy().tolist()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_over_several_partitions():
    parts = [(0, 2, [10.0], 1.0, [4.0], 1.0, [4.0]), (0, 0, [10.0], 0.0, [6.0], 1.0, [4.0]), (0, 1, [10.0], 1.0, [10.0], 1.0, [10.0]), (1, 2, [2.0], 1.0, [1.0], 2.0, [1.0])]
    parts[0] = (0, 2, [10.0], 1.0, [4.0], 5.0, [1.0])
    found = ranks.whole_ranks(parts)
    assert [None if x is None else x[0] for x in found[0, 0]] == [0.0, 3.5, 6 + (18 + 1) / 2]
    assert [None if x is None else x[0] for x in found[1, 0]] == [10.0, 15.5, None] and [x[0] for x in found[2, 0]] == [20.0, 15.5, 30.0] and [x[0] for x in found[2, 1]] == [0.0, 1.0, 2.0]
