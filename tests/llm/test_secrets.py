import random

import pytest

import corpus_pipeline
from claimcheck.llm import queries, secrets

FAR = "user=bob " + "words " * 200 + "password=hunter2"


@pytest.mark.parametrize(("text", "want"), [
    ("see postgres://db.example.com/app?password=hunter2 there", ["postgres://db.example.com/app?password=hunter2", "password=hunter2"]),
    ("see https://host/?token=abcd12 there", ["https://host/?token=abcd12", "token=abcd12"]),
    (FAR, ["user=bob", "password=hunter2"]),
    ("user=bob\n \npassword=hunter2", []),
    ("https://host/ and user=bob", []),
    ("password=hunter2 token=abcd12", []),
])
def test_the_scope_alone_decides(text, want):
    assert [text[s:e] for s, _, e in secrets.spans_of(text, None)[1]] == want


def test_overlapping_and_far_parts_in_the_query_and_the_stage(spark):
    rows = [(1, "at https://host/?token=abcd12 now", 9), (2, FAR, 9), (3, "password=hunter2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert {r.doc_id: len(r.linked) for r in secrets.scan(docs).collect()} == {1: 2, 2: 2, 3: 0}
    clean = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, docs, "").collect()}
    assert clean == {1: "at [SECRET] now", 2: "[SECRET] " + "words " * 200 + "[SECRET]", 3: "password=hunter2"}


def gap(a, b):
    return max(0, a[0] - b[2], b[0] - a[2])


def brute(text):
    """Linked spans and their distances, from every pair of parts and every paragraph."""
    base = secrets.base_spans(text)
    weak, cuts = secrets.weak_spans(text, base), [(m.start(), m.end()) for m in secrets.PARAGRAPH.finditer(text)]
    borders = [0, *(x for c in cuts for x in c), len(text)]
    scopes = list(zip(borders[::2], borders[1::2]))
    role = lambda span: secrets.ROLES[secrets.KINDS[span[1]]]
    fits = lambda a, b: (role(a) == "secret") != (role(b) == "secret")
    found = {}
    for w in weak:
        for x in base + weak:
            if fits(w, x) and any(w[0] < e and w[2] > s and x[0] < e and x[2] > s for s, e in scopes):
                found[w] = min(found.get(w, 10**9), gap(w, x))
    return found


PARTS = ["user=bob", "login: alice", "password=hunter2", "pwd = 'abcd'", "token=abcdefghijkl1234", "https://db.example.com/?token=abcd12", "host=10.0.0.1", "AKIA" + "Q" * 16, "deadbeef" * 3, "Ab3dEf6hIj9kLm2nOp5qRs8t"]


def test_planted_links_through_the_query(spark, tmp_path):
    draw, texts = random.Random(8), []
    for _ in range(400):
        words = [draw.choice([*PARTS, "word", "other", "some more words", "\n\n", "\n \n", "\n"]) for _ in range(draw.randint(0, 14))]
        texts.append(" ".join(words))
    texts += [" ".join(PARTS) + " w" * 3000 + " user=zed", "", "\n\n", "user=bob\n\n" * 5 + "pwd=abcde"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in queries.op8_secrets(spark, str(tmp_path)).collect()}
    found = 0
    for i, text in enumerate(texts):
        links = brute(text)
        found += len(links)
        want = sorted([*secrets.base_spans(text), *links])
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want), text
        assert secrets.distances_of(text)[1] == links
    assert found > 500
    far = secrets.scan(spark.createDataFrame([(1, texts[400])], "doc_id long, text string"), distances="far").first()
    assert dict(zip([(x.start, x.kind, x.end) for x in far.linked], far.far)) == brute(texts[400]) and max(far.far) > 5000


def test_a_part_across_two_scopes_is_in_both():
    scopes, parts = [(0, 10), (12, 20), (22, 30)], [(1, 3, 4), (8, 4, 14), (19, 5, 23), (25, 3, 26)]
    assert list(secrets.overlapping(scopes, parts)) == [[parts[0], parts[1]], [parts[1], parts[2]], [parts[2], parts[3]]]
