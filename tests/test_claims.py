import pytest

from claimcheck.operators import claims, mentions, metrics, name_index, report, verdicts
from claimcheck.plans.verify import verify


def parsed(spark, text):
    return claims.claims_parse(spark.createDataFrame([(1, text)], "source_id long, text string")).collect()


@pytest.mark.parametrize("text, direction, strength, confidence", [
    ("1. A is positively tied to B", "positive", "unknown", 0.5),
    ("2) x increases", "positive", "unknown", 0.5),
    ("3. x increases while y decreases", "negative", "unknown", 0.5),
    ("4. strong negative link", "negative", "strong", 0.8),
    ("5. insignificant", "unknown", "strong", 0.8),
    ("6. weak", "unknown", "weak", 0.4),
    ("7. moderate", "unknown", "moderate", 0.6),
])
def test_words_of_claims(spark, text, direction, strength, confidence):
    row = parsed(spark, text)[0]
    assert (row.direction, row.strength, row.confidence_score) == (direction, strength, confidence)


def test_lines_that_are_claims(spark):
    rows = parsed(spark, "Intro\n\n  1. first \n- bullet\n**2.** bold\n3.5 mg of it\n12)third")
    assert [(r.ordinal, r.original_text) for r in rows] == [(2, "first"), (5, "5 mg of it"), (6, "third")]
    assert parsed(spark, None) == [] and parsed(spark, "") == []


def test_numbers(spark):
    df = spark.createDataFrame([("from -12.5 to -3 and 53,000 or .5",)], "t string")
    assert df.select(claims.claim_numbers(df.t)).first()[0] == [-12.5, 3.0, 53.0, 0.0, 0.5]


def test_fuzzy_scores(spark):
    assert name_index.common_subsequence("abcbdab", "bdcaba") == 4
    index = name_index.NameIndex(["cholesterol", "age"], "indel", 85)
    assert [(i, exact) for i, _, exact in index.find("the cholestrol level")] == [(0, False)] and index.find("") == []
    rows = spark.createDataFrame([("Only inverze moves",), ("prise",), (None,)], "original_text string")
    found = mentions.mentions(rows, ["inverse", "price"]).collect()
    assert [[m.column for m in r.mentions] for r in found] == [["inverse"], [], []]


def test_word_matching(spark):
    rows = spark.createDataFrame([("the average grows",)], "original_text string")
    assert mentions.mentions(rows, ["age"], None).first().mentions
    assert not mentions.mentions(rows, ["age"], None, match="word").first().mentions


@pytest.fixture(scope="module")
def checked(spark):
    table = spark.createDataFrame([(25 + 5 * k, 180 + 10 * k, 50000 + 100 * ((k * 7) % 10), (k * 7) % 10) for k in range(10)], "age long, cholesterol long, income long, random long")
    text = """1. Age is positively correlated with cholesterol
2. Age is negatively correlated with cholesterol
3. Random goes with cholesterol
4. The sample size is 12
5. Here n= a lot
6. The sample size is 100
7. The mean of random is 4.5
8. The minimum age is 25
9. The median age is 47
10. Nothing at all
11. The range of cholesterol goes to 270
12. A weak positive link of age with cholesterol
13. Random may vary by 3.03"""
    texts = spark.createDataFrame([(1, text)], "source_id long, text string")
    return table, texts, {r.ordinal + 1: r for r in verify(table, texts, None).collect()}


@pytest.mark.parametrize("number, status, reason", [
    (1, "VALID", "Relationship confirmed by statistics"),
    (2, "HALLUCINATION_DIRECTION", "Claimed negative, but actually positive"),
    (3, "HALLUCINATION_RELATIONSHIP", "No statistical relationship found between cholesterol and random"),
    (4, "VALID", "Valid sample size (approx 12)"),
    (5, "UNVERIFIED", "Not enough variables found"),
    (6, "UNVERIFIED", "Could not verify sample size against ground truth"),
    (7, "VALID", "Mean/Center of random is approx 4.5"),
    (8, "VALID", "Minimum/Outlier 25.0 for age verified"),
    (9, "VALID", "Median age verified"),
    (10, "UNVERIFIED", "Not enough variables found"),
    (11, "VALID", "Range/Limits for cholesterol verified"),
    (12, "VALID", "Relationship confirmed by statistics"),
    (13, "VALID", "Standard deviation for random verified"),
])
def test_verdicts(checked, number, status, reason):
    row = checked[2][number]
    assert (row.status, row.reason) == (status, reason)


def test_strict_verdicts(checked):
    table, texts, _ = checked
    rows = {r.ordinal + 1: r for r in verify(table, texts, None, check_strength=True).collect()}
    assert rows[12].status == "HALLUCINATION_STRENGTH" and rows[12].ground_truth.strength == "strong"
    rows = {r.ordinal + 1: r for r in verify(table, texts, None, directional_kinds=("group_difference",)).collect()}
    assert rows[2].status == "VALID"


def test_metrics_and_reports(spark, checked):
    table, texts, _ = checked
    found = verify(table, texts, None)
    row = metrics.verdict_metrics(found).first()
    assert (row.total_claims, row.valid_claims, row.hallucinations, row.unverified) == (13, 8, 2, 3)
    assert row.hallucination_rate == round(2 / 13, 4)
    none = metrics.verdict_metrics(found.where("false")).first()
    assert none.total_claims == 0 and none.hallucination_rate == 0.0
    lines = [r.line for r in report.report_markdown(found, metrics.verdict_metrics(found), "d", "m", "t").orderBy("source_id", "ordinal", "line_no").collect()]
    assert lines[0] == "# Hallucination Analysis Report" and "- **Total Claims:** 13" in lines
    assert "**Ground Truth:** age vs cholesterol (strong positive)" in lines and any(x.startswith("### 2. ❌") for x in lines)
    assert verdicts.by_filter(found, []).count() == 13 and verdicts.by_filter(found, ["HALLUCINATION"]).count() == 2


def test_no_text(spark):
    rows = spark.createDataFrame([(1, 0, None, "unknown", "unknown"), (1, 1, "", "unknown", "unknown")], "source_id long, ordinal int, original_text string, direction string, strength string")
    truth = spark.createDataFrame([], "kind string, priority int, var1 string, var2 string, strength string, direction string")
    profile = spark.createDataFrame([("a", 3, 1.0, 1.0, 1.0, 1.0, 1.0)], "column string, count long, mean double, std double, min double, p50 double, max double")
    found = verdicts.verdicts(mentions.subjects(mentions.mentions(rows, ["a"])), truth, profile, "a").collect()
    assert {r.reason for r in found} == {"No text found in claim"}
