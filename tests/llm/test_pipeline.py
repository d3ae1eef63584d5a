from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from claimcheck.llm import quality, secrets, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    good = corpus_pipeline.quality_stage(spark, docs, FOLDER)
    ratios = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r.doc_id for r in quality.assess(docs, ratios).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    sets = {k: set(simhash.shingle_hashes(given[k].text, 5).tolist()) for k in sorted(kept)}
    first, waiting = set(), dict(sets)
    while waiting:
        key = next(iter(waiting))
        first.add(key)
        reached = [waiting.pop(key)]
        while reached:
            p = reached.pop()
            near = [k for k, q in waiting.items() if 10 * len(p & q) >= 8 * len(p | q)]
            reached += [waiting.pop(k) for k in near]
    single = corpus_pipeline.near_duplicates_stage(spark, good, FOLDER)
    assert single.columns == docs.columns and Counter(r.doc_id for r in single.collect()) == Counter(first)
    clean = corpus_pipeline.secrets_stage(spark, single, FOLDER)
    assert clean.columns == docs.columns
    for r in clean.collect():
        spans = [s for part in secrets.spans_of(given[r.doc_id].text) for s in part]
        assert ("[SECRET]" in r.text) == bool(spans) and r.n_chars == (len(r.text) if spans else given[r.doc_id].n_chars)
    packed = corpus_pipeline.packing_stage(spark, clean, FOLDER).collect()
    assert {r.doc_id for r in packed} == first and max(sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}) <= 1024


def test_stages_of_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "s", 9), (1, base, "en", "s", 9), (2, base + " more", "en", None, None), (None, base.upper(), None, None, None), (3, None, None, None, None), (4, "", "", "", 0), (5, " ".join(f"other{i}" for i in range(60)) + " password=abcdefghijklmnop", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit(1)).withColumn("base", F.lit(2))
    found = corpus_pipeline.near_duplicates_stage(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 5]
    clean = corpus_pipeline.secrets_stage(spark, docs, FOLDER)
    assert clean.columns == docs.columns and clean.count() == 7 and clean.where("text like '%[SECRET]'").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), FOLDER).isEmpty()
