"""What must hold for many rows, levels, files and slices."""


import uuid

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import associate, clean, codes, profile, sketches
from claimcheck.sources import tables


def jobs(spark, work):
    group = f"jobs {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merged_profiles_are_the_whole(spark):
    df = spark.range(30_000).selectExpr("cast(id % 30 as int) day", "if(id % 7 = 0, double('nan'), 1e6 + pmod(xxhash64(id), 100003) / 7.0D) a", "if(id % 5 = 0, null, id) b", "string(pmod(hash(id), 5000)) t", "cast(null as string) none")
    states = sketches.profile_state(df, ["day"])
    weeks = sketches.merge_states(states.withColumn("week", F.expr("day div 7")), ["week"])
    exact = {r.column: r for r in profile.profile_numeric(df.drop("day")).collect()}
    for merged in (sketches.merge_states(states), sketches.merge_states(weeks), sketches.profile_state(df.drop("day"))):
        got = {r.column: r for r in sketches.profile_from_states(merged).collect()}
        assert got.keys() == {"a", "b", "t", "none"}
        for c in "ab":
            want = exact[c]
            assert (got[c].n_rows - got[c].n_missing, got[c]["min"], got[c]["max"]) == (want["count"], want["min"], want["max"])
            assert got[c].mean == pytest.approx(want.mean, rel=1e-12) and got[c].std == pytest.approx(want.std, rel=1e-9)
            for q in (25, 50, 75):
                below = df.where(F.col(c) < got[c][f"p{q}"]).count() / want["count"]
                assert abs(below - q / 100) < 0.03
        assert got["t"].unique == pytest.approx(df.select("t").distinct().count(), rel=0.04) and got["t"].p50 is None
        assert got["none"].n_missing == 30_000 and got["none"].unique == 0
    assert sketches.profile_from_states(sketches.merge_states(sketches.profile_state(df.limit(0)))).where("n_rows > 0").isEmpty()


def test_screened_pairs(spark):
    df = spark.range(3_000).selectExpr("string(id % 3) a", "string(id % 6) b", "string(id) name")
    got = {(r.var1, r.var2): r for r in associate.screened_chi_square(df, max_levels=50).collect()}
    assert got["a", "b"].tested and got["a", "b"].cramers_v == pytest.approx(1.0) and got["a", "b"].levels2 == 6
    assert all(not got[x, "name"].tested and got[x, "name"].stat is None and got[x, "name"].levels2 > 2000 for x in "ab")
    assert associate.screened_chi_square(df.select("a")).isEmpty() and associate.screened_chi_square(df.limit(0)).where("tested AND stat IS NOT NULL").isEmpty()
    plan = associate.screened(df, max_levels=50)
    assert plan.where("tested").count() == 1


def test_contingency_counts_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(str(i % 3) if i % 5 else None, str(i % 2) if i % 7 else None, i % 2 == 0) for i in range(100)] + [(None, None, None)], "a string, b string, c boolean")
        got = {(r.var1, r.var2, r.level1, r.level2): r.n for r in associate.contingency(df).collect()}
        rows, want = df.collect(), {}
        for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
            for r in rows:
                if r[x] is not None and r[y] is not None:
                    key = (x, y, *(str(v).lower() if isinstance(v, bool) else v for v in (r[x], r[y])))
                    want[key] = want.get(key, 0) + 1
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_codes_of_many_levels(spark, batch):
    n = 200_000 if batch == "10000" else 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, n, 1, 6).selectExpr("id", "if(id % 2 = 0, 'same', string(pmod(xxhash64(id), 100000))) many", "if(id % 3 = 0, null, if(id % 3 = 1, 'é', 'z')) few", "'one' one", "id AS _row")
        got = clean.label_encode(df).toPandas().set_index("id").sort_index()
        want = df.toPandas().set_index("id").sort_index()
        assert list(got.columns) == ["many", "few", "one", "_row"] and (got._row == want._row).all()
        for c in ("many", "few", "one"):
            values = want[c].fillna("nan")
            place = {v: i for i, v in enumerate(sorted(set(values)))}
            assert (got[c] == values.map(place)).all()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_values_that_go_on_in_the_next_partition():
    parts = [(0, 0, 3, "a", "c"), (0, 1, 1, "c", "c"), (0, 2, 2, "c", "d"), (0, 5, 1, "e", "e"), (1, 5, 1, "a", "a")]
    assert codes.offsets(parts[::-1]) == [(0, 0, 0), (1, 0, 2), (2, 0, 2), (5, 0, 4), (5, 1, 0)]


def test_cleaning_removes_repeated_rows_once(spark):
    df = spark.range(2_000).selectExpr("double(id % 50) a", "if(id % 50 = 3, null, string(id % 4)) t")
    found = clean.clean_table(df.union(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[a" not in plan and found.count() == df.distinct().count()


def test_many_files_take_few_jobs(spark, tmp_path):
    def fill(folder, n):
        folder.mkdir()
        for i in range(n):
            (folder / f"a{i}.csv").write_text(f"id,name\n{i},x{i}\n" if i % 2 else f'id,name\n{i},"two\nlines"\n')
            (folder / f"b{i}.csv").write_bytes("größe\n1.5\n".encode("latin-1") if i % 2 else "v\n1\n".encode())
            (folder / f"c{i}.json").write_text('{"v": 1}\n{"v": 2}\n' if i % 2 else '[{"v": 1},\n {"w": 2}]')
        (folder / "empty.csv").write_text("")
        (folder / "notes.txt").write_text("no table")
        spark.range(3).write.parquet(str(folder / "p.parquet"))

    fill(tmp_path / "few", 68)
    fill(tmp_path / "many", 100)
    found, few = jobs(spark, lambda: tables.load_folder_by_schema(spark, str(tmp_path / "few"), ".csv"))
    many, most = jobs(spark, lambda: tables.load_folder_by_schema(spark, str(tmp_path / "many"), ".csv"))
    assert most <= few + 2 and sorted(len(f) for f, _ in many) == [50, 50, 50, 50]
    by_file = {f: df for files, df in many for f in files}
    assert len(by_file) == 200 and dict(by_file["a1.csv"].dtypes) == {"id": "int", "name": "string", "_file": "string"}
    assert sorted((r.id, r.name) for r in by_file["a2.csv"].where("_file in ('a2.csv', 'a4.csv')").collect()) == [(2, "two\nlines"), (4, "two\nlines")]
    assert by_file["b1.csv"].columns == ["größe", "_file"] and by_file["b1.csv"].count() == 50
    other = tables.load_folder_by_schema(spark, str(tmp_path / "few"), ".json")
    assert sorted((len(f), df.count()) for f, df in other) == [(34, 68), (34, 68)]


def test_parquet_files_by_schema(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        next((tmp_path / f"t{i}").glob("part*.parquet")).rename(tmp_path / f"x{i}.parquet")
    spark.range(5).selectExpr("string(id) id").coalesce(1).write.parquet(str(tmp_path / "u"))
    next((tmp_path / "u").glob("part*.parquet")).rename(tmp_path / "y.parquet")
    found = tables.load_folder_by_schema(spark, str(tmp_path), ".parquet")
    assert sorted((f, df.count()) for f, df in found) == [(["x0.parquet", "x1.parquet", "x2.parquet"], 6), (["y.parquet"], 5)]
