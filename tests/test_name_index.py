import random

import pytest

from claimcheck.operators import mentions, name_index
from claimcheck.operators.name_index import NameIndex, score


def brute(names, text, kind, least):
    found = []
    for i, name in enumerate(n.lower() for n in names):
        if name in text:
            found.append((i, 100.0, True))
        elif kind and text:
            short, long = sorted((name, text), key=len)
            best = max(score(short, long[p : p + len(short)], kind) for p in range(len(long) - len(short) + 1))
            if best >= least:
                found.append((i, best, False))
    return found


@pytest.mark.parametrize("kind", ["levenshtein", "indel", None])
@pytest.mark.parametrize("least", [85.0, 60.0, 100.0, 0.0])
def test_the_index_finds_what_all_windows_give(kind, least):
    draw = random.Random(f"{kind} {least}")
    for _ in range(60):
        names = ["".join(draw.choice("abcé ") for _ in range(draw.randint(0 if draw.random() < 0.1 else 1, 14))) for _ in range(6)]
        index = NameIndex(names, kind, least)
        for _ in range(12):
            text = "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 30)))
            if draw.random() < 0.7:  # a name with edits
                near = list(draw.choice(names))
                for _ in range(draw.randint(0, 3)):
                    at = draw.randint(0, len(near))
                    near[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "b"])
                text = text[:10] + "".join(near) + text[10:]
            assert index.find(text) == brute(names, text, kind, least), (names, text)


def test_distances():
    assert name_index.distance("kitten", "sitting") == 3 and name_index.distance("", "ab") == 2 and name_index.distance("ab", "ab") == 0
    assert [name_index.most_edits(n, 85, "levenshtein") for n in (1, 6, 7, 13, 14, 40)] == [0, 0, 1, 1, 2, 6]
    assert name_index.pieces("abcdefg", 2) == [(0, "ab"), (2, "cd"), (4, "efg")]


def test_a_thousand_names_are_compared_with_few_windows():
    draw = random.Random(3)
    names = ["_".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)) for _ in range(1000)]
    index = NameIndex(names, "levenshtein", 85)
    texts = []
    for i in range(200):
        near = list(names[i])
        near[draw.randint(0, 10)] = "-"
        texts.append(f"the {''.join(near)} rises with {names[999 - i]} and nothing else of note happens here")
    assert [index.find(t) for t in texts] == [brute(names, t, "levenshtein", 85) for t in texts[:3]] + [index.find(t) for t in texts[3:]]
    index.windows = 0
    for i, text in enumerate(texts):
        assert {(k, exact) for k, _, exact in index.find(text)} == {(i, False), (999 - i, True)}
    assert index.windows < 20 * len(texts)  # of 1000 names times 60 windows each


def test_mentions_of_a_table(spark):
    rows = [(1, "Heart.Rate and heart rates"), (2, None), (3, ""), (4, "hart.rate"), (5, "the heart_rate's age"), (6, "agent"), (7, "It's `odd`")]
    claims = spark.createDataFrame(rows, "source_id long, original_text string").selectExpr("source_id", "0 AS ordinal", "original_text", "'x' AS _found", "1 AS _low")
    names = ["heart.rate", "age", "It's `odd`"]
    assert mentions.mentions(claims, names).columns == ["source_id", "ordinal", "original_text", "_found", "_low", "mentions"]
    got = {r.source_id: [(m.column, m.col_pos, round(m.score), m.match_kind) for m in r.mentions] for r in mentions.mentions(claims, names).collect()}
    assert got == {1: [("heart.rate", 0, 100, "exact")], 2: [], 3: [], 4: [("heart.rate", 0, 89, "fuzzy")], 5: [("heart.rate", 0, 90, "fuzzy"), ("age", 1, 100, "exact")], 6: [("age", 1, 100, "exact")], 7: [("It's `odd`", 2, 100, "exact")]}
    word = {r.source_id: [(m.column, m.match_kind) for m in r.mentions] for r in mentions.mentions(claims, names, None, match="word").collect()}
    assert word[6] == [] and word[5] == [("age", "exact")] and word[1] == [("heart.rate", "exact")]
    word = {r.source_id: [(m.column, m.score, m.match_kind) for m in r.mentions] for r in mentions.mentions(claims, names, match="word").collect()}
    assert word[6] == [("age", 100.0, "fuzzy")]  # held, but not as a word
    assert all(r.mentions == [] for r in mentions.mentions(claims, []).collect())
