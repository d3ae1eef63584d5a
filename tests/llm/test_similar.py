import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from claimcheck.llm import simhash


def components(sets, least):
    """Smallest key reachable from each key by pairs of the wanted similarity."""
    label = {}
    for key in sorted(sets):
        waiting = [] if key in label else [key]
        while waiting:
            at = waiting.pop()
            label[at] = key
            for k in sets:
                common, both = len(sets[at] & sets[k]), len(sets[at] | sets[k])
                if k not in label and k not in waiting and (common / both if both else 1.0) >= least:
                    waiting.append(k)
    return label


def test_stage_is_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    found = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(components(sets, 0.8).values()))


def test_no_pair_below_the_threshold_and_nearly_all_at_it(spark):
    """Each family has one text of 90 shingles and one that shares 80 or 79 of 100 shingles of the two."""
    rows, want = [], {}
    for i in range(600):
        words = [f"f{i}w{j}" for j in range(94)]
        keep = 80 if i % 2 else 79
        size = 90 if i % 2 else 89  # of the other text, so that both together have 100
        other = words[: keep + 4] + [f"g{i}w{j}" for j in range(size - keep)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if i % 2 else 2 * i + 1}
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [k for k in want if found[k] != want[k]]
    assert all(found[k] == k for k in missed) and len(missed) <= 0.03 * 300


def test_recall_at_the_threshold_whatever_the_size():
    draw = np.random.default_rng(9)
    count = simhash.tables_wanted(0.8)
    for common, a, b in ((8, 1, 1), (8, 2, 0), (40, 5, 5), (80, 10, 10), (400, 50, 50)):
        hits = 0
        for _ in range(200):
            shared, x, y = np.split(draw.integers(0, 1 << 64, common + a + b, dtype=np.uint64), [common, common + a])
            sets = (np.r_[shared, x], np.r_[shared, y])
            prints = [simhash.fingerprint(s, 2 * count if len(s) <= simhash.SMALL else count) for s in sets]
            keys = [set(simhash.keys(np.array([p], dtype=np.int64), simhash.wide_tables)[1].tolist()) for p in prints]
            hits += bool(keys[0] & keys[1])
        assert hits >= 0.97 * 200


def test_families_of_edited_copies(spark, monkeypatch):
    """Texts that share keys with a first text that many of them don't link to."""
    monkeypatch.setattr(simhash, "FEW", 2)
    draw = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(60):
        words = list(base)
        at = int(draw.integers(0, 240))
        words[at : at + int(draw.integers(1, 60))] = [f"x{i}"]
        rows.append((i, " ".join(words)))
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in rows}
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), least=0.9)
    assert {r.doc_id: r.component_id for r in found.collect()} == components(sets, 0.9)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one"), (8, "ONE"), (None, "one"), (6, "two"), (6, "three four"), (6, "three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1))
    found = sorted((r.doc_id or -1, r.component_id) for r in simhash.similar(docs).collect())
    assert found == [(-1, 7), (3, 3), (5, 3), (6, 6), (6, 6), (6, 6), (7, 7), (8, 7), (9, 3)]
    assert simhash.similar(docs.where("false")).isEmpty()
    nulls = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(100)) + end) for end in ("", " more", " less")], "doc_id long, text string")
    assert simhash.similar(nulls).count() == 3


def test_whole_runs_join_what_batches_cut():
    import pyarrow as pa

    keys = np.array([1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4])
    for sizes in ([1] * 12, [5, 0, 7], [12], [2, 3, 4, 3], [2, 7, 3], [9, 3]):
        for most in (None, 1, 2, 4, 7):
            ends = np.cumsum([0, *sizes])
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.arange(a, b))], names=["k", "v"]) for a, b in zip(ends, ends[1:])]
            found = list(simhash.whole_runs(iter(batches), lambda c: c[0], most))
            assert sorted(x for _, (_, v) in found for x in v.tolist()) == list(range(12))
            large = {k for k, n in ((1, 2), (2, 7), (3, 1), (4, 2)) if most and n > most}
            assert all(set(k.tolist()) <= large for whole, (k, _) in found if not whole)
            runs = [k.tolist() for whole, (k, _) in found if whole]
            assert sorted(k for run in runs for k in set(run)) == sorted({1, 2, 3, 4} - large) and all(run == sorted(run) for run in runs)


def test_many_different_fingerprints_under_one_key(spark, monkeypatch):
    """Fingerprints that differ in the third segment only meet under the same keys; blocks or not, the classes are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    draw = np.random.default_rng(4)
    words = np.unique(draw.integers(0, 1 << 21, 1500)) << 43
    for bit in (50, 60):  # and some that link
        words = np.unique(np.r_[words, words[:300] ^ (1 << bit)])
    prints = spark.createDataFrame([(i, [w]) for i, w in enumerate(words.tolist())], "node long, words array<long>")
    with simhash.Scratch(spark) as scratch:
        edges = {(r.low, r.high) for r in simhash.links(prints, 4, scratch).collect()}
    bits = words.view(np.uint64)
    assert all(int(bits[a] ^ bits[b]).bit_count() <= 4 for a, b in edges)
    assert classes(len(words), edges) == classes(len(words), simhash.forest(bits[:, None], 4))


def classes(count, edges):
    root = list(range(count))
    for a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(count):
        root[i] = root[root[i]]
    return root


def test_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    test_families_of_edited_copies(spark, monkeypatch)


def test_a_pair_is_proposed_under_the_first_key_it_shares():
    draw = np.random.default_rng(12)
    for _ in range(300):
        a = int(draw.integers(0, 1 << 46))
        b = a
        for bit in draw.choice(46, int(draw.integers(0, 9)), replace=False):
            b ^= 1 << int(bit)
        own, other = (set(simhash.keys(np.array([[x]], dtype=np.int64), simhash.wide_tables)[1].tolist()) for x in (a, b))
        shared = np.array(sorted(own & other), dtype=np.int64)
        first = simhash._meet_first(shared, np.full(len(shared), a), np.full(len(shared), b)) if len(shared) else []
        assert list(first) == [i == 0 for i in range(len(shared))]


def test_parities_rule_out_no_similar_set():
    draw = np.random.default_rng(5)
    for common, a, b in ((8, 1, 1), (40, 5, 5), (150, 18, 18), (150, 0, 60), (2000, 200, 300)):
        shared, x, y = np.split(draw.integers(0, 1 << 64, common + a + b, dtype=np.uint64), [common, common + a])
        one, other = (np.array(simhash.parities(np.r_[shared, z])).view(np.uint64) for z in (x, y))
        assert len(one) == simhash.PARITIES and np.bitwise_count(one ^ other).sum() <= a + b


def test_alike_but_not_similar_texts_yield_few_pairs(spark):
    """Texts of one family that are all just too different: their pairs stay where the keys meet."""
    base, draw, rows = [f"w{i}" for i in range(150)], np.random.default_rng(6), []
    for i in range(120):
        words = list(base)
        for n, at in enumerate(draw.choice(150, 4, replace=False)):
            words[at] = f"x{i}y{n}"
        rows.append((i, " ".join(words)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert max(alike) < 0.9 and np.mean(alike) > 0.6
    prints = spark.createDataFrame(rows, "node long, text string").select("node", simhash.sketches(F.col("text"), 5, simhash.tables_wanted(0.9)).alias("s"))
    prints = prints.select("node", "s.words", "s.size", "s.odd", F.col("node").alias("class"))
    with simhash.Scratch(spark) as scratch:
        assert simhash.crossing(prints, 0.9, scratch).count() < len(alike) / 10


def test_codewords_of_the_first_segment_open_to_all_keys(spark):
    words = np.random.default_rng(7).integers(0, 1 << 62, (40, 3))
    prints = spark.createDataFrame([(i, w, 9, [0] * simhash.PARITIES) for i, w in enumerate(words.tolist())], "node long, words array<long>, size int, odd array<long>")
    sent = simhash._keyed(simhash._folded(prints), whole=False).toPandas()
    packed, node, word = (sent[c].to_numpy() for c in ("packed", "node", "word"))
    run, opened, row = simhash._opened(packed >> simhash.CARRIED, packed, word)
    rows, keys = simhash.keys(words, simhash.wide_tables)
    assert 4 * len(sent) < len(keys)
    assert sorted(zip(node[row].tolist(), (opened >> simhash.CARRIED).tolist())) == sorted(zip(rows.tolist(), keys.tolist()))
