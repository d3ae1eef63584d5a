import datetime

import pytest

from claimcheck.operators import profile, truth
from claimcheck.streaming import running

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(float(k), 2.0 * k + k % 2, float(k * 7 % 10)) for k in range(30)], "age double, income double, random double")


def test_versions_restart_repeats_and_late_rows(spark, tmp_path, table):
    texts, versions, out, rows = (str(tmp_path / x) for x in ("texts", "versions", "out", "rows"))
    schema = "source_id long, text string, time timestamp"

    def arrive(name, *lines):
        spark.createDataFrame([(s, "\n".join(f"{i + 1}. {t}" for i, t in enumerate(claims)), at(m)) for s, m, *claims in lines], schema).coalesce(1).write.parquet(f"{texts}/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(texts)
        running.run_verdicts(stream, versions, table.columns, "age", out, str(tmp_path / "c1"), once=True).awaitTermination()
        kind = "source_id long, time timestamp, ordinal int, original_text string, direction string, strength string, status string, reason string, truth_version string"
        verdicts = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(out)

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

        found = running.running_metrics(verdicts, delay="10 minutes", shards=3)
        found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
        return {r.source_id: tuple(r)[1:] for r in running.total_metrics(spark.read.parquet(rows)).collect()}

    with pytest.raises(FileNotFoundError):
        (tmp_path / "versions").mkdir()
        running.newest_version(spark, versions)
    running.save_version(truth.truth_table(table), profile.profile_numeric(table), versions, "v1")
    same, wrong, unknown = "age is positively correlated with income", "age is negatively correlated with income", "nothing here"
    arrive("a", (1, 0, same, wrong, unknown), (2, 0, same))
    arrive("b", (1, 5, same.upper(), "random goes with age"))
    assert run() == {1: (4, 1, 2, 1, 1), 2: (1, 1, 0, 0, 0)}
    judged = spark.read.parquet(out)
    assert {r.truth_version for r in judged.collect()} == {"v1"}
    # Another truth: nothing is related any more. The old verdicts stay, the state goes on.
    none = spark.createDataFrame([], truth.truth_table(table).schema)
    running.save_version(none, profile.profile_numeric(table), versions, "v2")
    none.write.parquet(f"{versions}/v3/truth")  # not whole yet
    arrive("c", (1, 9, same), (2, 30, same), (None, 31, unknown))
    assert run() == {1: (4, 1, 2, 1, 2), 2: (2, 1, 1, 0, 0), None: (1, 0, 0, 1, 0)}
    # Half an hour on the watermark has passed: what comes from before is late, the claim of then is new again.
    arrive("d", (1, 60, unknown + " new"))
    arrive("e", (1, 10, "far too late"), (1, 61, same))
    assert run() == {1: (6, 1, 3, 2, 2), 2: (2, 1, 1, 0, 0), None: (1, 0, 0, 1, 0)}
    assert {(r.truth_version, r.status) for r in spark.read.parquet(out).where(f"original_text = '{same}'").collect()} == {("v1", "VALID"), ("v2", "HALLUCINATION_RELATIONSHIP")}
    assert run() == {1: (6, 1, 3, 2, 2), 2: (2, 1, 1, 0, 0), None: (1, 0, 0, 1, 0)}
