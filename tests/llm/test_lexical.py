import math
import re
from collections import Counter

import pytest

from claimcheck.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, top):
    terms = [(i, Counter(terms_of(t))) for i, t in docs]
    total, length = sum(bool(t) for _, t in terms), sum(t.total() for _, t in terms)
    frequency, out = Counter(x for _, t in terms for x in t), []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, own in terms:
            score = 0
            for term in terms_of(text):
                if tf := own[term]:
                    df = frequency[term]
                    m = 75 + 25 * own.total() * total // length
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(map(str, out))


LONG = "x" * 1000
DOCS = [
    (1, "The cat, the CAT; a dog"), (2, "cat"), (3, None), (4, ""), (5, " \n..."), (6, "cat"), (None, "cat"), (7, "été Été ÉTÉ cat9 9"), (8, f"{LONG} {LONG}y cat"), (9, "日本 日本語\x00cat\x85dog"),
    (10, "dog " * 5000), (11, "a b c d e f"), (-3, "cat"), (12, "concat cats"), (2, "cat"),
]
ITEMS = [(1, "cat"), (1, "cat"), (2, "The cat cat"), (3, None), (4, "--"), (5, "été ÉTÉ"), (6, LONG), (7, "nothing here"), (None, "dog"), (1, "9 日本"), (8, "f e d c b a dog")]


@pytest.mark.parametrize("pairs", [lexical.PAIRS, 12])
def test_search_is_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    docs = spark.createDataFrame([(*d, "x", 0) for d in DOCS], "doc_id long, text string, document string, n int").repartition(3)
    items = spark.createDataFrame([(*i, "y") for i in ITEMS], "item_id long, text string, row string")
    found = lexical.search(docs, items, top=4)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(DOCS, ITEMS, 4)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 5)
    wanted = lexical.item_terms(spark.createDataFrame([(i, f"a b word{i}") for i in range(40)], "item_id long, text string"), "item_id", "text")
    blocks = [b.select("row").distinct().count() for b in lexical._dealt(wanted)]
    assert sum(blocks) == 40 and max(blocks) <= 6  # the count is an estimate


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for some, others in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.where("text is null"))):
        assert lexical.search(some, others).collect() == []


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(str(tuple(r)) for r in queries.op11_lexical(spark, folder).collect()) == brute(docs, items[:], 20)
