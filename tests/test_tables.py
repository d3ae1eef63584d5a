import pytest
from pyspark.ml import PipelineModel

from claimcheck.operators import clean, model, profile, prompts
from claimcheck.sources import reports, tables
from claimcheck.streaming.verdicts import stream_verdicts, windowed_metrics


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1.0, "  A\t", 2), (1.0, "  A\t", 2), (None, "b", 4), (float("nan"), None, 6), (4.0, "B", 8)]
    return spark.createDataFrame(rows, "a.b double, `text 1` string, n long".replace("a.b", "`a.b`"))


def test_clean(messy):
    found = clean.clean_table(messy).collect()
    assert len(found) == 4 and all(None not in r for r in found)
    assert sorted(r["text 1"] for r in found) == ["a", "b", "b", "b"] or sorted(r["text 1"] for r in found) == ["a", "a", "b", "b"]
    assert sum(r["n"] for r in found) == pytest.approx(0.0)


def test_imputation(messy):
    got = sorted(r["a.b"] for r in clean.impute_median_mode(messy).collect())
    assert got == [1.0, 1.0, 1.0, 1.0, 4.0]
    assert sorted(r["a.b"] for r in clean.impute_mean(messy, ["a.b"]).collect()) == [1.0, 1.0, 2.0, 2.0, 4.0]


def test_text_column_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "t string, n long")
    assert {r.t for r in clean.impute_median_mode(df).collect()} == {"Unknown"}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, same double")
    assert [round(r.a, 6) for r in clean.scale(df).orderBy("a").collect()] == [-1.224745, 0.0, 1.224745]
    assert {r.same for r in clean.scale(df).collect()} == {0.0} and {r.same for r in clean.scale(df, "minmax").collect()} == {0.0}
    assert [r.a for r in clean.scale(df, "minmax").orderBy("a").collect()] == [0.0, 0.5, 1.0]


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    assert sorted(r.t for r in clean.label_encode(df).collect()) == [0, 1, 1, 2]


def test_profile_of_odd_names(messy):
    missing = {r.column: r.n_missing for r in profile.missing_values(messy).collect()}
    assert missing == {"a.b": 2, "text 1": 1, "n": 0}
    assert {r.column for r in profile.profile_all(messy).collect()} == {"a.b", "text 1", "n"}
    counts = [r.n for r in profile.histogram(messy, "n", 3).orderBy("bin").collect()]
    assert counts == [2, 1, 2] or sum(counts) == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,name\n1,ann\n,bob\n3,\n")
    (tmp_path / "latin.csv").write_bytes("x,name\n1,Ren\xe9\n".encode("latin-1"))
    (tmp_path / "b.JSON").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "c.xyz").write_text("?")
    df = tables.load_table(spark, str(tmp_path / "a.csv"))
    assert df.count() == 3 and df.where("x is null").count() == 1
    assert tables.load_table(spark, str(tmp_path / "latin.csv")).first().name == "René"
    assert tables.load_table(spark, str(tmp_path / "b.JSON")).count() == 2
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "c.xyz"))
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"))
    assert set(tables.load_folder(spark, str(tmp_path))) == {"a.csv", "latin.csv", "b.JSON"}
    assert tables.is_usable(df) and not tables.is_usable(df.where("false"))
    reports.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_files_are_split_unless_a_value_goes_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,name\n1,"two\nlines"\n2,"a ""quoted"" word"\n')
    assert sorted(r.name for r in tables.load_table(spark, str(tmp_path / "a.csv")).collect()) == ['a "quoted" word', "two\nlines"]
    (tmp_path / "b.csv").write_text("x,name\n" + "".join(f"{i},n{i}\n" for i in range(5000)))
    wide = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert tables.load_table(spark, str(tmp_path / "b.csv")).rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
    given = tables.read_csv(spark, str(tmp_path / "b.csv"), encoding="UTF-8", multi_line=False, schema="x string, name string")
    assert given.dtypes == [("x", "string"), ("name", "string")] and given.count() == 5000
    (tmp_path / "lines.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "one.json").write_text('{\n "x": 1\n}\n')
    assert tables.load_table(spark, str(tmp_path / "lines.json")).count() == 3
    assert [r.x for r in tables.load_table(spark, str(tmp_path / "one.json")).collect()] == [1]
    assert tables.read_json(spark, str(tmp_path / "lines.json"), schema="x double").dtypes == [("x", "double")]


def test_white_space_is_unicodes(spark):
    texts = ["\u00a0 A\u2003", "\x85b\x1c", "\u3000c d\u2028\t", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted(r.t for r in clean.normalize_text(df).collect()) == sorted(t.strip().lower() for t in texts)


def test_first_rows(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, "d")], "n long, `a.b` string")
    assert [r.n for r in profile.first_rows(df, ["a.b"], 2).collect()] == [1, 2] and profile.first_rows(df).count() == 3


def test_models(spark, tmp_path):
    rows = [(i, float(i % 10), "ab"[i % 2], float(i % 10) * 2, "hi" if i % 10 > 4 else "lo") for i in range(200)]
    df = model.train_test_split(spark.createDataFrame(rows, "id long, x double, t string, y double, z string"), "id")
    assert model.task_of(df, "y") == "regression" and model.task_of(df, "id") == "regression" and model.task_of(df, "z") == "classification"
    share = df.where("split = 'train'").count() / 200
    assert 0.7 < share < 0.9 and model.train_test_split(df.drop("split").repartition(7), "id").where("split = 'train'").count() == share * 200
    fitted = model.forest(df.where("split = 'train'"), "z", ["x", "t"], trees=5)
    model.save_model(fitted, str(tmp_path / "m"))
    found = PipelineModel.load(str(tmp_path / "m")).transform(df.where("split = 'test'"))
    assert found.agg(model.score_accuracy(found.label, found.prediction)).first()[0] > 0.9
    fitted = model.forest(df, "y", ["x", "t"], trees=5)
    found = fitted.transform(df)
    assert found.agg(model.score_r2(found.y, found.prediction)).first()[0] > 0.9


def test_prompts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    found = {r.slice: r.prompt for r in prompts.prompt_table(df, "g", ["v"]).collect()}
    assert "rows: 2" in found["a"] and "- v: mean 2.00, min 1.00, max 3.00" in found["a"]


def test_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, "1. a is positively tied to b"), (2, "1. a is negatively tied to b\n2. nothing")], "source_id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([("correlation", 1, "a1", "b1", "strong", "positive")], "kind string, priority int, var1 string, var2 string, strength string, direction string")
    truth = truth.union(spark.createDataFrame([("correlation", 1, "a is", "to b", "strong", "positive")], truth.schema))
    profile_ = spark.createDataFrame([("a is", 3, 1.0, 1.0, 1.0, 1.0, 1.0)], "column string, count long, mean double, std double, min double, p50 double, max double")
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    found = stream_verdicts(stream, truth, profile_, ["a is", "to b"], "a is")
    run = found.select("source_id", "ordinal", "status").writeStream.format("memory").queryName("found").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.source_id, r.ordinal, r.status) for r in spark.table("found").collect()) == [(1, 0, "VALID"), (2, 0, "HALLUCINATION_DIRECTION"), (2, 1, "UNVERIFIED")]
    timed = spark.sql("SELECT timestamp '2026-01-01 00:03:00' AS at, 'VALID' AS status UNION ALL SELECT timestamp '2026-01-01 00:14:00', 'UNVERIFIED'")
    assert [r.total_claims for r in windowed_metrics(timed, "at").orderBy("window").collect()] == [1, 1]


def test_windows_of_a_stream_close_at_the_watermark(spark, tmp_path):
    schema = "at timestamp, status string"
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = windowed_metrics(rows, "at").writeStream.format("memory").queryName("windows").outputMode("append").start()
    try:
        for i, lines in enumerate([["00:01", "00:04"], ["02:00"], ["00:02", "02:30"], ["04:00"]]):
            (tmp_path / "in" / f"{i}.json").write_text("".join('{"at": "2026-01-01T%s:00", "status": "VALID"}\n' % x for x in lines))
            run.processAllAvailable()
        closed = {r.window.start.strftime("%H:%M"): r.total_claims for r in spark.table("windows").collect()}
    finally:
        run.stop()
    assert closed["00:00"] == 2  # the late row came after the watermark
