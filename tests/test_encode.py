import pytest
from pyspark.sql import functions as F

from claimcheck.operators import encode, model


@pytest.fixture(scope="module")
def rows(spark):
    noise = "(pmod(xxhash64(id, 3), 2001) / 1000.0D - 1)"
    df = spark.range(6_000).selectExpr("id", "concat('row ', id) name", "if(id % 3 = 0, null, concat('g', pmod(xxhash64(id), 40))) group_", f"coalesce(double(pmod(xxhash64(id), 40)) * (id % 3 > 0 and true)::double, 0) / 10 + {noise} y", f"{noise} luck", "if(id % 7 = 0, null, double(id % 11)) x")
    return df.withColumn("kind", F.when(F.col("id") % 50 == 0, None).when(F.col("y") > 2, "high").when(F.col("y") > 0.5, "mid").otherwise("low"))


def scores(rows, target, features):
    fitted = encode.encoded_forest(rows.where("id % 5 > 0"), target, features, "id", trees=10)
    score = model.score_r2 if target != "kind" else lambda a, b: model.score_accuracy(a, b)
    out = []
    for part in ("id % 5 > 0", "id % 5 = 0"):
        found = fitted.transform(rows.where(part).where(F.col(target).isNotNull()))
        actual = F.col("label") if target == "kind" else F.col(target)
        out.append(found.agg(score(actual, F.col("prediction"))).first()[0])
    return out


def test_a_text_of_one_row_each_says_nothing(spark, rows):
    _, held_out = scores(rows, "luck", ["name", "x"])
    assert -0.05 < held_out < 0.05


def test_levels_that_say_something(spark, rows):
    fitted, held_out = scores(rows, "y", ["group_", "name", "x"])
    assert held_out > 0.4 and fitted - held_out < 0.1


def test_classes(spark, rows):
    fitted, held_out = scores(rows, "kind", ["group_", "name"])
    assert held_out > 0.4 and fitted - held_out < 0.1


def test_own_fold_is_left_out(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), ("b", 0, 7.0), (None, 2, 9.0), (None, 3, 1.0), ("c", 4, None)], "g string, f int, y double")
    table, means = encode.encoding(encode.level_sums(df, "g", [F.col("y")], F.col("f")), prior=2.0)
    overall = 26 / 6
    assert means == [pytest.approx(overall)]
    got = [(r.g, r.f, r.m[0]) for r in encode.encoded(df.union(spark.createDataFrame([("new", 0, 0.0)], df.schema)), "g", table, means, F.col("f"), "m").collect()]
    want = {("a", 0): (8 + 2 * overall) / 4, ("a", 1): (1 + 2 * overall) / 3, ("b", 0): overall, (None, 2): (1 + 2 * overall) / 3, (None, 3): (9 + 2 * overall) / 3, ("c", 4): overall, ("new", 0): overall}
    assert len(got) == 8 and all(m == pytest.approx(want[g, f]) for g, f, m in got)


def test_heavy_levels_are_broadcast_and_others_not(spark, rows):
    table, _ = encode.encoding(encode.level_sums(rows, "group_", [F.col("y")], encode.fold_of("id")))
    heavy = {r.level for r in table.where("heavy").collect()}
    assert None in heavy and len(heavy) == 41
    table, _ = encode.encoding(encode.level_sums(rows, "name", [F.col("y")], encode.fold_of("id")))
    assert table.where("heavy").isEmpty() and table.count() == 6_000


def test_empty_table(spark, rows):
    table, means = encode.encoding(encode.level_sums(rows.limit(0), "name", [F.col("y")], encode.fold_of("id")))
    assert table.isEmpty() and means == [0.0] and encode.encoded(rows.limit(2), "name", table, means, F.lit(0), "m").select("m").first().m == [0.0]
