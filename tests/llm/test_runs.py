import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from claimcheck.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                start = i
                while i + q < n and words[i] == words[i + q]:
                    i += 1
                end = i + q
                smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q) if q % p == 0)
                if end - start >= max(6, 4 * q) and not smaller:
                    found.append((start, end, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def generated(draw):
    out, letters = [], "abcdefgh"[: draw.randint(1, 8)]
    for _ in range(draw.randint(0, 6)):
        if draw.random() < 0.5:
            period = [draw.choice(letters) for _ in range(draw.randint(1, 12))]
            out += (period * draw.randint(1, 9))[: -draw.randint(1, len(period))]
        else:
            out += [draw.choice(letters) for _ in range(draw.randint(0, 30))]
    return out


@pytest.mark.parametrize("part", [runs.PART, 7])
def test_runs_are_brute_force(monkeypatch, part):
    monkeypatch.setattr(runs, "PART", part)
    draw = random.Random(4)
    for _ in range(300):
        docs = [generated(draw) for _ in range(draw.randint(1, 6))]
        docs += [docs[0], docs[-1] + docs[0]] * draw.randint(0, 2)
        got = list(runs.runs_of_texts([" ".join(x).encode() for x in docs]))
        assert [x[:2] for x in got] == [(len(x), brute(x)) for x in docs]
        assert [x[2].decode() for x in got] == [collapsed(x, brute(x)) for x in docs]


def test_the_grammar_derives_the_words_and_is_small_where_text_repeats():
    words = np.array([*range(500), -1, *range(500), -1, *([7, 8, 9] * 400), -1, *([5] * 1000)])
    made = runs.Grammar(words)

    def expanded(symbol):
        at = symbol - made.first
        return [symbol] if at < 0 else [*expanded(int(made.left[at])), *expanded(int(made.right[at]))]

    assert [w for s in made.sequence.tolist() for w in expanded(s)] == words.tolist()
    for i in range(len(made.left)):
        assert expanded(made.first + i) == words[made.place[i] : made.place[i] + made.length[i]].tolist()
    assert len(made.sequence) < 60
    assert made.derived() == [(1002, 2202, 3), (2203, 3203, 1)]


def test_what_lies_in_a_symbol_is_looked_at_once(monkeypatch):
    seen, find = [], runs.stretches
    monkeypatch.setattr(runs, "stretches", lambda words: (seen.append(int((words >= 0).sum())), find(words))[1])
    draw = random.Random(1)
    text = " ".join(draw.choice(["a", "b"]) if i < 60 else f"w{draw.randint(0, 10**6)}" for i in range(200)) + " x y z" * 5
    got = list(runs.runs_of_texts([text.encode()] * 200))
    assert all(x == got[0] for x in got) and got[0][1] == brute(text.split())
    assert sum(seen) < 20 * 215  # of 200 * 215 words


def test_long_texts():
    n = 300_000
    for words in (["a"] * n, ["a", "b", "c"] * (n // 3), [str(i) for i in range(n // 4)] * 4, [str(i % 1000 * (i > 50)) for i in range(n)]):
        ((size, found, text),) = runs.runs_of_texts([" ".join(words).encode()])
        for s, e, q in found:
            assert words[s : e - q] == words[s + q : e] and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == size or words[e] != words[e - q])
        assert found and text.decode() == collapsed(words, found)


def test_documents(spark):
    rows = [(1, "a b " * 5, "x", 1), (2, None, "x", 2), (3, "", None, None), (None, "z\t\n\x0b\x0c\r" * 8, "x", 3), (5, "a b " * 5, "y", 4), (6, "  \x1c \x85 " * 4, "y", 5), (7, "word" * 10000, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string, _found long")
    found = runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "_found", "n_words", "runs", "collapsed"]
    got = {r._found: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    two, four = (10, [(0, 10, 2)], "a b"), (12, [(0, 12, 3)], "  \x1c \x85")
    assert got == {1: two, 2: (0, [], ""), None: (0, [], ""), 3: (8, [(0, 8, 1)], "z"), 4: two, 5: four, 6: (1, [], "word" * 10000)}
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.asDict() for r in queries.op13_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(words)
        s, e, q = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=(None, None, None))
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(found), "start": s, "length": e - s if found else None, "period": q, "exponent_milli": 1000 * (e - s) // q if found else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(words, found).encode()).hexdigest(),
        }
    assert planted > 5
