import math

import pytest
from pyspark.sql import functions as F

from claimcheck.functions.distributions import chi2_upper, f_upper, t_two_sided
from claimcheck.operators import associate, correlate, groups, profile, truth

AGE = [25, 30, 35, 40, 45, 50, 55, 60, 65, 70]
INCOME = [50000, 52000, 51000, 53000, 52000, 54000, 53000, 55000, 54000, 56000]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(a, 180 + 2 * (a - 25), i, "x" if k % 2 else "y", 7.0) for k, (a, i) in enumerate(zip(AGE, INCOME))]
    return spark.createDataFrame(rows, "age long, cholesterol long, income long, kind string, same double")


def test_tails():
    assert t_two_sided(2.0, 1e6) == pytest.approx(0.0455, abs=1e-4)
    assert t_two_sided(1.0, 1.0) == pytest.approx(0.5)
    assert f_upper(3.0, 2.0, 10.0) == pytest.approx((10 / (10 + 2 * 3)) ** 5)
    assert chi2_upper(3.0, 2.0) == pytest.approx(math.exp(-1.5))
    assert chi2_upper(40.0, 4.0) == pytest.approx(math.exp(-20) * 21, rel=1e-9)
    assert 0 < t_two_sided(40.0, 100.0) < 1e-60


def test_correlations(people):
    found = {(r.var1, r.var2): r for r in correlate.correlation_tests(people).collect()}
    pair = found["age", "cholesterol"]
    assert pair.pearson.r == pytest.approx(1.0) and pair.direction == "positive" and pair.strength == "strong"
    pair = found["age", "income"]
    assert 0.9 < pair.pearson.r < 0.91 and pair.pearson.p == pytest.approx(0.0003, abs=2e-4)
    assert not any("same" in k for k in found)  # a constant column has no correlation


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, float("nan")), (None, 1.0), (4.0, 7.0)], "a double, b double")
    row = correlate.pearson(df).first()
    assert row.n == 3 and row.r == pytest.approx(7.6666667 / math.sqrt(4.6666667 * 12.6666667))
    assert correlate.spearman(df).first().rho == pytest.approx(1.0)


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 1, 3, 2, 3, 1)], "a double")
    assert sorted(r.a for r in correlate.average_ranks(df, ["a"]).collect()) == [1.5, 1.5, 3.0, 5.0, 5.0, 5.0]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0, 9.0], [0.1 * i for i in range(1001)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = profile.quantiles(df, ["a"]).first()
    ordered = sorted(values)
    for q, x in zip((0.25, 0.5, 0.75), (got.q0, got.q1, got.q2)):
        at = q * (len(ordered) - 1)
        low = int(at)
        assert x == pytest.approx(ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low))


def test_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 7.0), ("c", 100.0), (None, 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    moments = groups.group_moments(df)
    row = groups.group_tests(moments).first()
    assert row.test == "t-test" and row.n_groups == 2 and row.n == 5  # one row is too few for c
    assert row.stat == pytest.approx((2 - 6) / math.sqrt(1 / 3 + 2 / 2)) and row.highest == "c" and row.lowest == "a"
    means = groups.group_details(groups.group_tests(moments), moments).collect()
    assert {r.level: r.mean for r in means} == {"a": 2.0, "b": 6.0, "c": 100.0}


def test_groups_without_variation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert groups.group_findings(df).first().p_value == 0.0
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert groups.group_findings(same).isEmpty()


def test_two_by_two_is_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 15 + [(None, "x")]
    row = associate.chi_square(spark.createDataFrame(rows, "p string, q string")).first()
    n, expected = 30, [12 * 13 / 30, 12 * 17 / 30, 18 * 13 / 30, 18 * 17 / 30]
    stat = sum((abs(o - e) - 0.5) ** 2 / e for o, e in zip((10, 2, 3, 15), expected))
    assert row.n == n and row.dof == 1 and row.stat == pytest.approx(stat) and row.cramers_v == pytest.approx(math.sqrt(stat / n))


def test_absent_cells_count(spark):
    rows = [("a", "x")] * 5 + [("b", "y")] * 5 + [("c", "x")] * 5
    row = associate.chi_square(spark.createDataFrame(rows, "p string, q string")).first()
    assert row.dof == 2 and row.stat == pytest.approx(15.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, g string, h string")
    assert truth.truth_table(df).isEmpty() and profile.profile_numeric(df).isEmpty() and profile.value_counts(df).isEmpty()
    assert truth.truth_table(spark.createDataFrame([("x",)], "g string")).isEmpty()


def test_same_result_for_any_partitions(people):
    one, many = (sorted(map(str, correlate.spearman(people.repartition(n)).select("var1", "var2", F.round("rho", 9)).collect())) for n in (1, 8))
    assert one == many


def test_plan_reads_the_table_once(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = groups.group_moments(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    plan = correlate.pearson(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "kind" not in plan.split("ReadSchema")[1]


def test_quantiles_of_many_rows_look_at_a_narrow_range(spark, monkeypatch):
    monkeypatch.setattr(profile, "FEW", 50)
    sizes, look = [], profile._looked_up
    monkeypatch.setattr(profile, "_looked_up", lambda df, wanted: (sizes.extend(df.select(profile._inside(of)).distinct().count() for of in wanted), look(df, wanted))[1])
    df = spark.range(60_000).selectExpr("double(pmod(xxhash64(id), 100000)) a", "if(id % 3 = 0, 5.0D, double(id % 7)) b", "if(id % 2 = 0, null, double(id)) c", "if(id % 5 = 0, double('nan'), double(-id)) d")
    rows = df.toPandas()
    found = {r.column: (r.q0, r.q1, r.q2, r.q3) for r in profile.quantiles(df, list("abcd"), (0.0, 0.25, 0.5, 1.0)).collect()}
    for c in "abcd":
        assert found[c] == pytest.approx(tuple(rows[c].dropna().quantile([0.0, 0.25, 0.5, 1.0])))
    near = {r.column: r.q0 for r in profile.approximate_quantiles(df, ["a", "c"], (0.5,)).collect()}
    assert near["a"] == pytest.approx(rows["a"].median(), abs=50) and near["c"] == pytest.approx(rows["c"].dropna().median(), abs=20)
    assert sizes and max(sizes) <= 60
    assert profile.quantiles(df.where("false"), ["a"]).isEmpty() and profile.profile_numeric(df, ["a"], approximate=True).count() == 1


def test_details_of_a_level_for_each_row(spark):
    moments = groups.group_moments(spark.range(20_000).selectExpr("double(id % 17) v", "string(id div 2) many", "string(id % 5) few", "string(id) single"))
    tests = groups.group_tests(moments)
    assert {r.var2: r.n_groups for r in tests.collect()} == {"many": 10_000, "few": 5}  # a level of one row can't be tested
    assert {r.var2: r["count"] for r in groups.group_details(tests, moments).groupBy("var2").count().collect()} == {"many": 10_000, "few": 5}
    assert groups.group_details(tests.where("false"), moments).isEmpty()


def test_quantiles_beside_a_heavy_value(spark, monkeypatch):
    monkeypatch.setattr(profile, "FEW", 20)
    df = spark.range(50_000).selectExpr("if(id % 1000 < 995, 1.0D, id / 7.0D) a", "if(id < 49990, double(id % 3), double('infinity')) b", "case when id % 2 = 0 then -double(id) end c")
    rows, at = df.toPandas(), (0.001, 0.9949, 0.9951, 0.99951, 0.9999, 1.0)
    found = {r.column: r[1:] for r in profile.quantiles(df, list("abc"), at).collect()}
    for c in "ac":
        assert found[c] == pytest.approx(tuple(rows[c].dropna().quantile(at)))
    assert found["b"][:2] == (0.0, 2.0) and found["b"][-1] == math.inf
