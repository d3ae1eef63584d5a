"""One query for each operator over the given tables, and the DuckDB SQL that checks it.

Doubles are rounded on both sides. The tables have no missing values, repeated rows or claims, so that
some inputs are derived from them by expressions that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.functions.columns import quoted
from claimcheck.operators import associate, claims, clean, correlate, encode, groups, mentions, metrics, model, profile, prompts, report, sketches, truth, verdicts
from claimcheck.plans import oracle
from claimcheck.sources.scratch import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(quoted(c), digits).alias(c) if kind == "double" else quoted(c) for c, kind in df.dtypes])


def r6(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- derived inputs: (column, expression) that both engines read --------------------------------------

ORDERS = {
    "o_orderkey": "o_orderkey", "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END", "o_custkey": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END", "priority": "o_orderpriority",
}
LINES = {c: c for c in LINE} | {"net": "l_extendedprice * (1 - l_discount)", "charge": "l_quantity * l_extendedprice"}
GROUPED = {"quantity": "l_quantity + CASE WHEN l_linestatus = 'F' THEN 1.5 ELSE 0 END", "price": "l_extendedprice / 1000", "flag": "l_returnflag", "line": "l_linestatus"}
PARTS = {"size": "p_size", "retail": "p_retailprice", "number": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END"}
FACTS = {
    "price": "o_totalprice", "half": "o_totalprice * 0.5 + o_custkey % 100", "inverse": "1000 - o_totalprice",
    "status": "o_orderstatus", "priority": "o_orderpriority",
    "band": "CASE WHEN o_totalprice < 150000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END", "volume": "CASE WHEN o_totalprice < 150000 THEN 'small' ELSE 'large' END",
}
NUMBERS, CATEGORIES = ["price", "half", "inverse"], ["status", "priority", "band", "volume"]

_A = "CASE conv_id % 5 WHEN 0 THEN 'price' WHEN 1 THEN 'half' WHEN 2 THEN 'inverse' WHEN 3 THEN 'price' ELSE 'status' END"
_B = "CASE conv_id % 5 WHEN 0 THEN 'half' WHEN 1 THEN 'inverse' WHEN 2 THEN 'price' WHEN 3 THEN 'band' ELSE 'priority' END"
_SENTENCE = f"""CASE (conv_id + turn) % 14
 WHEN 0 THEN concat('The ', {_A}, ' is positively correlated with ', {_B}) WHEN 1 THEN concat({_A}, ' is negatively correlated with the ', {_B})
 WHEN 2 THEN concat('A strong link of ', {_A}, ' and ', {_B}, ' exists') WHEN 3 THEN 'Nothing of note stands out'
 WHEN 4 THEN 'The sample size is 15003 rows' WHEN 5 THEN 'With n= few rows' WHEN 6 THEN 'The mean price is about 250000.5'
 WHEN 7 THEN 'The minimum price is 1000 and the maximum 480000.0' WHEN 8 THEN 'Values of price vary by some 144000'
 WHEN 9 THEN 'The median price is 251000' WHEN 10 THEN concat('A weak tie: ', {_A}, ' increases with ', {_B})
 WHEN 11 THEN 'Only inverze and -12.5 or 3 prices matter' WHEN 12 THEN 'The price may range from 990.5 to 12' ELSE concat('A moderate drop: ', {_B}, ' decreases') END"""
TEXTS = {"source_id": "conv_id * 1000 + turn", "role": "role", "text": f"concat(text, chr(10), ' ', CAST(turn + 1 AS STRING), CASE WHEN turn % 2 = 0 THEN '. ' ELSE ') ' END, {_SENTENCE}, chr(10), '- a bullet')"}


def derived(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> DataFrame:
    return read(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def select(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name})"


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "orders", ORDERS)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "orders", FACTS)


ORDERS_SQL, LINES_SQL, GROUPED_SQL, PARTS_SQL, FACTS_SQL, TEXTS_SQL = (select(n, c) for n, c in (("orders", ORDERS), ("lineitem", LINES), ("lineitem", GROUPED), ("part", PARTS), ("orders", FACTS), ("conversations", TEXTS)))
_PROFILE = ["mean", "std", "min", "p25", "p50", "p75", "max"]


# --- profile ------------------------------------------------------------------------------------------


@query("profile_numeric", f'SELECT "column", count, {r6(*_PROFILE)} FROM ({oracle.profile("lineitem", LINE)})')
def _(spark, folder):
    return rounded(profile.profile_numeric(read(spark, folder, "lineitem"), LINE))


_TEXT_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, NULL AS mean, NULL AS std, NULL AS min, NULL AS p25, NULL AS p50, NULL AS p75, NULL AS max, count(*) AS \"unique\", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM customer GROUP BY 1)"
    for c in ("c_name", "c_mktsegment")
)


@query("profile_all", f'SELECT "column", count, {r6(*_PROFILE)}, NULL AS "unique", NULL AS top, NULL AS freq FROM ({oracle.profile("customer", ["c_custkey", "c_nationkey", "c_acctbal"])}) UNION ALL {_TEXT_PROFILE}')
def _(spark, folder):
    return rounded(profile.profile_all(read(spark, folder, "customer")))


@query("profile_merged", " UNION ALL ".join(f"SELECT event_type, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count(v) AS n_missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, true AS near FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN CAST({c} AS DOUBLE) END AS v FROM events) GROUP BY event_type" for c in ("value", "user_id")))
def _(spark, folder):
    """States by kind and part of the events, merged by kind; ``near``: the sketches' median is as near to the exact one's rank as they promise."""
    rows = read(spark, folder, "events").selectExpr("event_type", "event_id % 20 AS part", "CASE WHEN event_id % 9 <> 0 THEN value END AS value", "CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS DOUBLE) END AS user_id")
    found = sketches.profile_from_states(sketches.merge_states(sketches.profile_state(rows, ["event_type", "part"], ["value", "user_id"]), ["event_type"]))
    ranks = rows.join(F.broadcast(found.groupBy("event_type").pivot("column", ["value", "user_id"]).agg(F.first("p50"))).toDF("event_type", "_v", "_u"), "event_type").groupBy("event_type")  # a row a kind
    ranks = ranks.agg(*[F.struct(F.count_if(F.col(c) < F.col(m)).alias("low"), F.count_if(F.col(c) <= F.col(m)).alias("high"), F.count(c).alias("n")).alias(c) for c, m in (("value", "_v"), ("user_id", "_u"))])
    ranks = ranks.select("event_type", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}.{x}").alias(x) for x in ("low", "high", "n")]) for c in ("value", "user_id")])))
    near = (F.col("low") <= 0.53 * F.col("n")) & (F.col("high") >= 0.47 * F.col("n"))
    return rounded(found.join(ranks, ["event_type", "column"]).select("event_type", "column", "n_rows", "n_missing", "mean", "std", "min", "max", near.alias("near")))


@query("value_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")))
def _(spark, folder):
    return profile.value_counts(read(spark, folder, "orders"))


@query("missing_values", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM {ORDERS_SQL}" for c, t in zip(ORDERS, ("bigint", "double", "bigint", "string", "string"))))
def _(spark, folder):
    return profile.missing_values(orders(spark, folder))


@query("first_rows", "SELECT o_orderkey, status, priority FROM " + ORDERS_SQL + " ORDER BY o_orderkey LIMIT 3")
def _(spark, folder):
    return profile.first_rows(orders(spark, folder).select("o_orderkey", "status", "priority"), ["o_orderkey"])


@query("histogram", "SELECT CAST(b AS INTEGER) AS bin, round(lo + w * b, 6) AS low, round(lo + w * (b + 1), 6) AS high, count(*) AS n FROM (SELECT least(floor((p_retailprice - lo) / w), 19) AS b, lo, w FROM part, (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 20 AS w FROM part)) GROUP BY b, lo, w")
def _(spark, folder):
    return rounded(profile.histogram(read(spark, folder, "part"), "p_retailprice"))


@query("box_stats", f'SELECT "column", {r6("min", "p25", "p50", "p75", "max")}, round(p25 - 1.5 * (p75 - p25), 6) AS low_fence, round(p75 + 1.5 * (p75 - p25), 6) AS high_fence FROM ({oracle.profile("lineitem", LINE[:2])})')
def _(spark, folder):
    return rounded(profile.box_stats(read(spark, folder, "lineitem"), LINE[:2]))


@query("outliers_zscore", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS zscore FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) WHERE abs((c_acctbal - m) / s) > 1.5")
def _(spark, folder):
    return rounded(profile.outliers_zscore(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.5).select("c_custkey", "zscore"))


@query("outliers_iqr", "SELECT event_id, round(v, 6) AS v FROM (SELECT event_id, value * value * value / 1000 AS v FROM events), (SELECT quantile_cont(value * value * value / 1000, 0.25) AS a, quantile_cont(value * value * value / 1000, 0.75) AS b FROM events) WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)")
def _(spark, folder):
    return rounded(profile.outliers_iqr(read(spark, folder, "events").selectExpr("event_id", "value * value * value / 1000 AS v"), "v"))


_MODE = "(SELECT arg_min(v, (-n, v)) FROM (SELECT {0} AS v, count(*) AS n FROM {1} WHERE {0} IS NOT NULL GROUP BY 1))"


@query("impute_constants", " UNION ALL ".join([f"SELECT '{c}' AS \"column\", 'median' AS kind, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS number, NULL AS text FROM {ORDERS_SQL}" for c in ("price", "o_custkey")] + [f"SELECT '{c}' AS \"column\", 'mode' AS kind, NULL AS number, {_MODE.format(c, ORDERS_SQL)} AS text" for c in ("status", "priority")]))
def _(spark, folder):
    return rounded(profile.impute_constants(orders(spark, folder), ["price", "o_custkey", "status", "priority"]))


# --- cleaning -----------------------------------------------------------------------------------------

_TWICE = "(SELECT o_orderstatus, o_orderpriority, o_custkey FROM orders UNION ALL SELECT o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 3 = 0)"


@query("dedup_rows", f"SELECT DISTINCT * FROM {_TWICE}")
def _(spark, folder):
    rows = read(spark, folder, "orders")
    kept = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return clean.dedup_rows(rows.select(*kept).union(rows.where("o_orderkey % 3 = 0").select(*kept)))


_MEDIAN = f"(SELECT quantile_cont(CAST({{0}} AS DOUBLE), 0.5) FROM {ORDERS_SQL})"


@query("impute_median_mode", f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, round(coalesce(price, {_MEDIAN.format('price')}), 6) AS price, round(coalesce(o_custkey, {_MEDIAN.format('o_custkey')}), 6) AS o_custkey, coalesce(status, {_MODE.format('status', ORDERS_SQL)}) AS status, priority FROM {ORDERS_SQL}")
def _(spark, folder):
    return rounded(clean.impute_median_mode(orders(spark, folder)))


@query("impute_mean", f"SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM {ORDERS_SQL})), 6) AS price, round(coalesce(o_custkey, (SELECT avg(o_custkey) FROM {ORDERS_SQL})), 6) AS o_custkey FROM {ORDERS_SQL}")
def _(spark, folder):
    return rounded(clean.impute_mean(orders(spark, folder).select("o_orderkey", "price", "o_custkey"), ["price", "o_custkey"]))


@query("normalize_text", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def _(spark, folder):
    rows = read(spark, folder, "customer").selectExpr("c_custkey", "concat('  ', upper(c_mktsegment), chr(9), ' ') AS segment")
    return clean.normalize_text(rows)


@query("scale_standard", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def _(spark, folder):
    return rounded(clean.scale(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), "standard", ["c_acctbal"]))


@query("scale_minmax", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def _(spark, folder):
    return rounded(clean.scale(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), "minmax", ["c_acctbal"]))


_CLEAN = f"(SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, coalesce(price, {_MEDIAN.format('price')}) AS price, coalesce(o_custkey, {_MEDIAN.format('o_custkey')}) AS o_custkey, lower(coalesce(status, {_MODE.format('status', ORDERS_SQL)})) AS status, lower(priority) AS priority FROM {ORDERS_SQL})"


@query("clean_table", "SELECT " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM {_CLEAN})) / (SELECT stddev_pop({c}) FROM {_CLEAN}), 6) AS {c}" for c in ("o_orderkey", "price", "o_custkey")) + f", status, priority FROM {_CLEAN}")
def _(spark, folder):
    rows = orders(spark, folder)
    return rounded(clean.clean_table(rows.union(rows.where("o_orderkey % 5 = 0"))))


@query("label_encode", f"SELECT o_orderkey, (SELECT count(DISTINCT coalesce(b.status, 'nan')) FROM {ORDERS_SQL} b WHERE coalesce(b.status, 'nan') < coalesce(a.status, 'nan')) AS status, CAST(dense_rank() OVER (ORDER BY priority) - 1 AS BIGINT) AS priority FROM {ORDERS_SQL} a")
def _(spark, folder):
    return clean.label_encode(orders(spark, folder).select("o_orderkey", "status", "priority"))


# --- relationships ------------------------------------------------------------------------------------


@query("correlation_pearson", f"SELECT var1, var2, n, {r6('r')} FROM ({oracle.pearson(LINES_SQL, list(LINES))})")
def _(spark, folder):
    return rounded(correlate.pearson(derived(spark, folder, "lineitem", LINES)))


@query("correlation_constant_guard", f"SELECT var1, var2, n, {r6('r')} FROM ({oracle.pearson('(SELECT l_quantity, 1.0 AS one, l_tax FROM lineitem)', ['l_quantity', 'one', 'l_tax'])})")
def _(spark, folder):
    return rounded(correlate.pearson(read(spark, folder, "lineitem").selectExpr("l_quantity", "1.0D AS one", "l_tax")))


@query("correlation_spearman", f"SELECT var1, var2, n, {r6('rho')} FROM ({oracle.spearman(PARTS_SQL, list(PARTS))})")
def _(spark, folder):
    return rounded(correlate.spearman(derived(spark, folder, "part", PARTS)))


def flat(tests: DataFrame) -> DataFrame:
    return rounded(tests.select("var1", "var2", "n", F.col("pearson.r").alias("r"), F.col("spearman.r").alias("rho"), F.col("pearson.p").alias("pearson_p"), F.col("spearman.p").alias("spearman_p"), "effect", "strength", "direction"))


_FLAT = f"SELECT var1, var2, n, {r6('r', 'rho', 'pearson_p', 'spearman_p', 'effect')}, strength, direction"


@query("correlation_tests", f"{_FLAT} FROM ({oracle.correlation_tests(PARTS_SQL, list(PARTS))})")
def _(spark, folder):
    return flat(correlate.correlation_tests(derived(spark, folder, "part", PARTS)))


@query("correlation_findings", f"{_FLAT} FROM ({oracle.correlation_tests(LINES_SQL, list(LINES))}) WHERE (pearson_p < 0.05 OR spearman_p < 0.05) AND strength <> 'negligible'")
def _(spark, folder):
    return flat(correlate.correlation_findings(derived(spark, folder, "lineitem", LINES)))


_HALF = oracle.pearson("lineitem", LINE)


@query("correlation_matrix", f"SELECT var1, var2, round(r, 6) AS r FROM (SELECT var1, var2, r FROM ({_HALF}) UNION ALL SELECT var2, var1, r FROM ({_HALF}) UNION ALL SELECT unnest({LINE}), unnest({LINE}), 1.0)")
def _(spark, folder):
    return rounded(correlate.correlation_matrix(read(spark, folder, "lineitem"), LINE))


@query("group_moments", f"SELECT var1, var2, level, n, round(mean, 4) AS mean, round(variance / 1000000, 4) AS variance FROM ({oracle.moments(ORDERS_SQL, ['price', 'o_custkey'], ['status', 'priority'])})")
def _(spark, folder):
    return rounded(groups.group_moments(orders(spark, folder), ["price", "o_custkey"], ["status", "priority"]).withColumn("variance", F.col("variance") / 1000000), 4)


_TESTS = "var1, var2, test, n_groups, n, " + r6("stat", "dof1", "dof2", "p_value", digits=5) + ", highest, lowest"


@query("group_ttest", f"SELECT {_TESTS} FROM ({oracle.group_tests(GROUPED_SQL, ['quantity', 'price'], ['line'])})")
def _(spark, folder):
    return rounded(groups.group_tests(groups.group_moments(derived(spark, folder, "lineitem", GROUPED), ["quantity", "price"], ["line"])), 5)


@query("group_anova", f"SELECT {_TESTS} FROM ({oracle.group_tests('(SELECT value, event_type FROM events)', ['value'], ['event_type'])}) UNION ALL SELECT {_TESTS} FROM ({oracle.group_tests(GROUPED_SQL, ['quantity', 'price'], ['flag'])})")
def _(spark, folder):
    tests = groups.group_tests(groups.group_moments(read(spark, folder, "events").select("value", "event_type")))
    return rounded(tests.union(groups.group_tests(groups.group_moments(derived(spark, folder, "lineitem", GROUPED), ["quantity", "price"], ["flag"]))), 5)


@query("group_findings", f"SELECT {_TESTS}, CASE WHEN p_value < 0.01 THEN 'significant' ELSE 'moderate' END AS strength, concat(highest, ' > ', lowest) AS direction FROM ({oracle.group_tests(FACTS_SQL, NUMBERS, CATEGORIES)}) WHERE p_value < 0.05")
def _(spark, folder):
    return rounded(groups.group_findings(facts(spark, folder), NUMBERS, CATEGORIES), 5)


@query("group_details", f"SELECT m.var1, m.var2, m.level, round(m.mean, 4) AS mean FROM ({oracle.moments(FACTS_SQL, NUMBERS, CATEGORIES)}) m JOIN ({oracle.group_tests(FACTS_SQL, NUMBERS, CATEGORIES)}) t ON m.var1 = t.var1 AND m.var2 = t.var2 WHERE t.p_value < 0.05")
def _(spark, folder):
    table = facts(spark, folder)
    means = groups.group_details(groups.group_findings(table, NUMBERS, CATEGORIES), groups.group_moments(table, NUMBERS, CATEGORIES))
    return rounded(means.drop("n"), 4)


@query("contingency", oracle.contingency(ORDERS_SQL, ["status", "priority"]))
def _(spark, folder):
    return associate.contingency(orders(spark, folder), ["status", "priority"])


_CHI = "var1, var2, n, n_rows, n_columns, " + r6("stat") + ", dof, " + r6("p_value", "cramers_v")


@query("chi_square", f"SELECT {_CHI} FROM ({oracle.chi_square(FACTS_SQL, CATEGORIES)}) UNION ALL SELECT {_CHI} FROM ({oracle.chi_square('part', ['p_brand', 'p_type'])})")
def _(spark, folder):
    return rounded(associate.chi_square(facts(spark, folder), CATEGORIES).union(associate.chi_square(read(spark, folder, "part"), ["p_brand", "p_type"])))


@query("chi_square_screened", f"SELECT {_CHI}, true AS tested FROM ({oracle.chi_square('orders', ['o_orderstatus', 'o_orderpriority'])}) UNION ALL SELECT a, 'o_clerkkey', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS a)")
def _(spark, folder):
    rows = read(spark, folder, "orders").selectExpr("o_orderstatus", "o_orderpriority", "concat('Clerk', o_orderkey) AS o_clerkkey")
    return rounded(associate.screened_chi_square(rows, max_levels=100).drop("levels1", "levels2"))


@query("association_findings", f"SELECT {_CHI}, {oracle.STRENGTH.format('cramers_v')} AS strength, 'associated' AS direction FROM ({oracle.chi_square(FACTS_SQL, CATEGORIES)}) WHERE p_value < 0.05 AND cramers_v >= 0.2")
def _(spark, folder):
    return rounded(associate.association_findings(facts(spark, folder), CATEGORIES))


TRUTH = oracle.truth(FACTS_SQL, NUMBERS, CATEGORIES)
_FINDING = f"kind, priority, var1, var2, test, {r6('stat', digits=4)}, n, {r6('p_value', 'effect')}, strength, direction"


def _findings(found: DataFrame) -> DataFrame:
    return rounded(found.select("kind", "priority", "var1", "var2", "test", F.round("stat", 4).alias("stat"), "n", "p_value", "effect", "strength", "direction"))


@query("truth_table", f"SELECT {_FINDING} FROM ({TRUTH})")
def _(spark, folder):
    return _findings(truth.truth_table(facts(spark, folder), NUMBERS, CATEGORIES))


@query("top_findings", f"SELECT {_FINDING} FROM ({TRUTH}) ORDER BY round(effect, 6) DESC NULLS LAST, priority, var1, var2 LIMIT 5")
def _(spark, folder):
    return truth.top_findings(_findings(truth.truth_table(facts(spark, folder), NUMBERS, CATEGORIES)), 5)


# --- claims -------------------------------------------------------------------------------------------


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "conversations", TEXTS)


_LINES = f"(SELECT source_id, i - 1 AS ordinal, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT source_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {TEXTS_SQL}))"
_LINES = f"(SELECT source_id, CAST(ordinal AS INTEGER) AS ordinal, line FROM {_LINES} WHERE line <> '')"


@query("text_lines", f"SELECT * FROM {_LINES}")
def _(spark, folder):
    return claims.text_lines(texts(spark, folder))


_CLAIM = f"(SELECT source_id, ordinal, regexp_replace(line, '^\\d+[.)]\\s*', '') AS original_text FROM {_LINES} WHERE regexp_matches(line, '^\\d+[.)]'))"
_WORDS = "lower(original_text) LIKE '%{}%'"
_DIRECTION = f"CASE WHEN {_WORDS.format('positive')} OR ({_WORDS.format('increases')} AND NOT {_WORDS.format('decreases')}) THEN 'positive' WHEN {_WORDS.format('negative')} OR {_WORDS.format('decreases')} THEN 'negative' ELSE 'unknown' END"
_STRENGTH = f"CASE WHEN {_WORDS.format('strong')} OR {_WORDS.format('significant')} THEN 'strong' WHEN {_WORDS.format('weak')} THEN 'weak' WHEN {_WORDS.format('moderate')} THEN 'moderate' ELSE 'unknown' END"
CLAIMS_SQL = f"(SELECT source_id, ordinal, original_text, 'correlation' AS relationship, direction, strength, CAST(CASE strength WHEN 'strong' THEN 0.8 WHEN 'weak' THEN 0.4 WHEN 'moderate' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence_score, 'correlation' AS type FROM (SELECT *, {_DIRECTION} AS direction, {_STRENGTH} AS strength FROM {_CLAIM}))"


@query("claims_parse", f"SELECT * FROM {CLAIMS_SQL}")
def _(spark, folder):
    return claims.claims_parse(texts(spark, folder))


_NUMBERS = "list_transform(regexp_extract_all(original_text, '[-+]?\\d*\\.\\d+|\\d+'), lambda x: CAST(x AS DOUBLE))"


@query("claim_numbers", f"SELECT source_id, ordinal, CAST(i - 1 AS INTEGER) AS pos, number FROM (SELECT source_id, ordinal, unnest({_NUMBERS}) AS number, generate_subscripts({_NUMBERS}, 1) AS i FROM {CLAIMS_SQL})")
def _(spark, folder):
    return claims.claims_parse(texts(spark, folder)).select("source_id", "ordinal", F.posexplode(claims.claim_numbers(F.col("original_text"))).alias("pos", "number"))


COLUMNS = NUMBERS + CATEGORIES


def mentioned(spark: SparkSession, folder: str, fuzzy: str | None = "levenshtein") -> DataFrame:
    return mentions.mentions(claims.claims_parse(texts(spark, folder)), COLUMNS, fuzzy)


_NAMES = "(SELECT unnest({0}) AS \"column\", CAST(unnest({1}) AS INTEGER) AS col_pos)".format(COLUMNS, list(range(len(COLUMNS))))
_SCORE = "list_max(list_transform(generate_series(1, greatest(1, length(original_text) - length(\"column\") + 1)), lambda i: 100.0 * (length(\"column\") - levenshtein(substring(lower(original_text), i, length(\"column\")), \"column\")) / length(\"column\")))"
_EXACT = "contains(lower(original_text), \"column\")"
MENTIONS_SQL = f"(SELECT source_id, ordinal, \"column\", col_pos, CAST(score AS DOUBLE) AS score, match_kind FROM (SELECT *, CASE WHEN {_EXACT} THEN 100.0 ELSE {_SCORE} END AS score, CASE WHEN {_EXACT} THEN 'exact' ELSE 'fuzzy' END AS match_kind FROM {CLAIMS_SQL}, {_NAMES}) WHERE score >= 85)"


@query("mentions_exact", f"SELECT * FROM {MENTIONS_SQL} WHERE match_kind = 'exact'")
def _(spark, folder):
    return mentions.mention_rows(mentioned(spark, folder, None))


@query("mentions_fuzzy", f"SELECT source_id, ordinal, \"column\", col_pos, round(score, 6) AS score, match_kind FROM {MENTIONS_SQL}")
def _(spark, folder):
    return rounded(mentions.mention_rows(mentioned(spark, folder)))


@query("mentions_fuzzy_indel")
def _(spark, folder):
    return mentions.mention_rows(mentioned(spark, folder, "indel"))


_VARS = f"(SELECT source_id, ordinal, list(\"column\" ORDER BY col_pos) AS vars FROM {MENTIONS_SQL} GROUP BY ALL)"
SUBJECTS_SQL = f"(SELECT c.*, coalesce(len(vars), 0) AS n_vars, vars[1] AS v1, vars[2] AS v2 FROM {CLAIMS_SQL} c LEFT JOIN {_VARS} v ON c.source_id = v.source_id AND c.ordinal = v.ordinal)"


def subject_rows(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.subjects(mentioned(spark, folder))


@query("claim_subjects", f"SELECT source_id, ordinal, CAST(n_vars AS INTEGER) AS n_vars, v1 AS var1, v2 AS var2 FROM {SUBJECTS_SQL}")
def _(spark, folder):
    return subject_rows(spark, folder).select("source_id", "ordinal", F.size("extracted_vars").alias("n_vars"), "var1", "var2")


_BEST = f"(SELECT least(var1, var2) AS a, greatest(var1, var2) AS b, arg_min(kind, priority) AS kind, arg_min(var1, priority) AS t1, arg_min(var2, priority) AS t2, arg_min(strength, priority) AS t_strength, arg_min(direction, priority) AS t_direction FROM ({TRUTH}) GROUP BY 1, 2)"
LOOKED_SQL = f"(SELECT s.*, kind, t1, t2, t_strength, t_direction FROM {SUBJECTS_SQL} s LEFT JOIN {_BEST} t ON n_vars >= 2 AND a = least(v1, v2) AND b = greatest(v1, v2))"


@query("truth_lookup", f"SELECT source_id, ordinal, v1 AS var1, v2 AS var2, kind, t_direction AS truth_direction FROM {LOOKED_SQL}")
def _(spark, folder):
    found = verdicts.truth_lookup(subject_rows(spark, folder), truth.truth_table(facts(spark, folder), NUMBERS, CATEGORIES))
    return found.select("source_id", "ordinal", "var1", "var2", F.col("truth.kind").alias("kind"), F.col("truth.direction").alias("truth_direction"))


_STATS = f"(SELECT * FROM ({oracle.profile(FACTS_SQL, NUMBERS)}))"
_LOW = "lower(original_text)"


def _near(stat: str) -> str:
    return f"CASE WHEN {stat} <> 0 THEN list_filter(numbers, lambda x: abs(x - {stat}) / (abs({stat}) + 0.001) < 0.1) ELSE [] END"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{w}')" for w in words) + ")"


_PRINTED = "CASE WHEN {0} = floor({0}) THEN concat(CAST(CAST({0} AS BIGINT) AS VARCHAR), '.0') ELSE CAST({0} AS VARCHAR) END"
_AT_MIN, _AT_MAX = _has("outlier", "minimum"), _has("outlier", "maximum")
_CLOSE = lambda stat: f"({stat} <> 0 AND abs(x - {stat}) / (abs({stat}) + 0.001) < 0.1)"
_PREPARED = f"""(SELECT *, list_filter(numbers, lambda x: abs(x - row_count) < 5) AS sized, {_near('mean')} AS near_mean, {_near('std')} AS near_std, {_near('min')} AS near_min, {_near('max')} AS near_max, {_near('p50')} AS near_p50,
 list_filter(numbers, lambda x: ({_AT_MIN} AND {_CLOSE('min')}) OR ({_AT_MAX} AND {_CLOSE('max')})) AS marked
 FROM (SELECT l.*, {_NUMBERS} AS numbers, p.mean, p.std, p.min, p.max, p.p50, (SELECT count(*) FROM orders) AS row_count FROM {LOOKED_SQL} l LEFT JOIN {_STATS} p ON l.n_vars = 1 AND l.v1 = p."column"))"""
_RANGED = _has("range", "vary", "variability", "outlier", "minimum", "maximum")
_FIRST_AT_MIN = f"({_AT_MIN} AND min <> 0 AND abs(marked[1] - min) / (abs(min) + 0.001) < 0.1)"
_SIZED = "CASE WHEN len(sized) > 0 THEN concat('Valid sample size (approx ', CAST(CAST(floor(sized[1]) AS BIGINT) AS VARCHAR), ')') END"
_DESCRIBED = f"""CASE WHEN {_has('mean', 'average', 'centered around', 'typical')} AND len(near_mean) > 0 THEN concat('Mean/Center of ', v1, ' is approx ', {_PRINTED.format('near_mean[1]')})
 WHEN {_RANGED} AND len(marked) > 0 THEN concat(CASE WHEN {_FIRST_AT_MIN} THEN 'Minimum' ELSE 'Maximum' END, '/Outlier ', {_PRINTED.format('marked[1]')}, ' for ', v1, ' verified')
 WHEN {_RANGED} AND (len(near_min) > 0 OR len(near_max) > 0) THEN concat('Range/Limits for ', v1, ' verified')
 WHEN {_RANGED} AND len(near_std) > 0 THEN concat('Standard deviation for ', v1, ' verified')
 WHEN {_has('median', '50%', 'middle')} AND len(near_p50) > 0 THEN concat('Median ', v1, ' verified') END"""
_IS_SIZED = _has("sample size", "n=")


def verdict_sql(strict: bool = False) -> str:
    step = f"SELECT *, {_SIZED} AS sized_reason, {_DESCRIBED} AS described FROM {_PREPARED}"
    wrong = "t_direction IS NOT NULL AND direction <> 'unknown' AND direction <> t_direction"
    weak = "strength <> 'unknown' AND strength <> t_strength" if strict else "FALSE"
    case = lambda *out: (
        f"CASE WHEN original_text = '' THEN {out[0]} WHEN {_IS_SIZED} AND len(numbers) = 0 THEN {out[1]} WHEN {_IS_SIZED} AND sized_reason IS NOT NULL THEN {out[2]} WHEN {_IS_SIZED} THEN {out[3]} "
        f"WHEN n_vars = 1 AND described IS NOT NULL THEN {out[4]} WHEN n_vars < 2 THEN {out[1]} WHEN kind IS NULL THEN {out[5]} WHEN {wrong} THEN {out[6]} WHEN {weak} THEN {out[7]} ELSE {out[8]} END"
    )
    status = case("'UNVERIFIED'", "'UNVERIFIED'", "'VALID'", "'UNVERIFIED'", "'VALID'", "'HALLUCINATION_RELATIONSHIP'", "'HALLUCINATION_DIRECTION'", "'HALLUCINATION_STRENGTH'", "'VALID'")
    reason = case(
        "'No text found in claim'", "'Not enough variables found'", "sized_reason", "'Could not verify sample size against ground truth'", "described", "concat('No statistical relationship found between ', v1, ' and ', v2)",
        "concat('Claimed ', direction, ', but actually ', t_direction)", "concat('Claimed ', strength, ', but actually ', t_strength)", "'Relationship confirmed by statistics'",
    )
    return f"(SELECT *, {status} AS status, {reason} AS reason FROM ({step}))"


def verdict_rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    table = facts(spark, folder)
    return verdicts.verdicts(subject_rows(spark, folder), truth.truth_table(table, NUMBERS, CATEGORIES), profile.profile_numeric(table, NUMBERS), "price", **options)


_OUT = ("source_id", "ordinal", "original_text", "direction", "status", "reason")
VERDICTS_SQL = verdict_sql()


@query("claims_metadata", f"SELECT source_id, ordinal, status, reason FROM {VERDICTS_SQL} WHERE {_IS_SIZED}")
def _(spark, folder):
    low = F.lower("original_text")
    return verdict_rows(spark, folder).where(low.contains("sample size") | low.contains("n=")).select("source_id", "ordinal", "status", "reason")


@query("claims_descriptive", f"SELECT source_id, ordinal, v1 AS var1, status, reason FROM {VERDICTS_SQL} WHERE n_vars = 1 AND NOT {_IS_SIZED}")
def _(spark, folder):
    low = F.lower("original_text")
    rows = verdict_rows(spark, folder).where((F.size("extracted_vars") == 1) & ~(low.contains("sample size") | low.contains("n=")))
    return rows.select("source_id", "ordinal", "var1", "status", "reason")


@query("verdicts", f"SELECT {', '.join(_OUT)} FROM {VERDICTS_SQL}")
def _(spark, folder):
    return verdict_rows(spark, folder).select(*_OUT)


@query("verdicts_strict", f"SELECT {', '.join(_OUT)} FROM {verdict_sql(True)}")
def _(spark, folder):
    return verdict_rows(spark, folder, check_strength=True).select(*_OUT)


@query("verdicts_by_filter", f"SELECT {', '.join(_OUT)} FROM {VERDICTS_SQL} WHERE status LIKE '%HALLUCINATION%' OR status LIKE '%UNVERIFIED%'")
def _(spark, folder):
    return verdicts.by_filter(verdict_rows(spark, folder), ["HALLUCINATION", "UNVERIFIED"]).select(*_OUT)


@query("status_distribution", f"SELECT status, count(*) AS n FROM {VERDICTS_SQL} GROUP BY status")
def _(spark, folder):
    return metrics.status_distribution(verdict_rows(spark, folder))


@query("confidence_by_status", f"SELECT status, min(confidence_score) AS min, round(quantile_cont(confidence_score, 0.25), 6) AS p25, round(quantile_cont(confidence_score, 0.5), 6) AS p50, round(quantile_cont(confidence_score, 0.75), 6) AS p75, max(confidence_score) AS max FROM {VERDICTS_SQL} GROUP BY status")
def _(spark, folder):
    return rounded(metrics.confidence_by_status(verdict_rows(spark, folder)))


def metrics_sql(*keys: str) -> str:
    by = ", ".join(keys)
    sums = f"SELECT {by + ', ' if keys else ''}count(*) AS total_claims, count(*) FILTER (status = 'VALID') AS valid_claims, count(*) FILTER (status LIKE '%HALLUCINATION%') AS hallucinations, count(*) FILTER (status = 'UNVERIFIED') AS unverified FROM {VERDICTS_SQL}{' GROUP BY ' + by if keys else ''}"
    return f"SELECT *, round(hallucinations / CAST(total_claims AS DOUBLE), 4) AS hallucination_rate, round(valid_claims / CAST(total_claims AS DOUBLE), 4) AS insight_validity_score FROM ({sums})"


@query("verdict_metrics", metrics_sql())
def _(spark, folder):
    return metrics.verdict_metrics(verdict_rows(spark, folder))


@query("verdict_metrics_by_source", metrics_sql("source_id"))
def _(spark, folder):
    return metrics.verdict_metrics(verdict_rows(spark, folder), "source_id")


RUN = ("orders", "given", "2026-01-01 00:00:00")


_SHOWN = "status = 'HALLUCINATION_DIRECTION' OR reason = 'Relationship confirmed by statistics'"
_DETAIL = f"'detail' AS section, source_id, ordinal, original_text, direction, strength, status, reason, CASE WHEN {_SHOWN} THEN t1 END AS truth_var1, CASE WHEN {_SHOWN} THEN t2 END AS truth_var2, CASE WHEN {_SHOWN} THEN t_direction END AS truth_direction, NULL AS dataset, NULL AS total, NULL AS valid, NULL AS rate, NULL AS score"


@query("report_json", f"SELECT {_DETAIL} FROM {VERDICTS_SQL} UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{RUN[0]}', total_claims, valid_claims, hallucination_rate, insight_validity_score FROM ({metrics_sql()})")
def _(spark, folder):
    found = saved(verdict_rows(spark, folder), "verdicts")  # read twice: the rows and their metrics
    rows = report.report_json(found, metrics.verdict_metrics(found), *RUN)
    paths = {"original_text": "claim.original_text", "direction": "claim.direction", "strength": "claim.strength", "status": "status", "reason": "reason", "truth_var1": "ground_truth.var1", "truth_var2": "ground_truth.var2", "truth_direction": "ground_truth.direction", "dataset": "metadata.dataset"}
    numbers = {"total": ("metrics.total_claims", "long"), "valid": ("metrics.valid_claims", "long"), "rate": ("metrics.hallucination_rate", "double"), "score": ("metrics.insight_validity_score", "double")}
    texts_of_body = [F.get_json_object("body", f"$.{path}").alias(name) for name, path in paths.items()]
    return rows.select("section", "source_id", "ordinal", *texts_of_body, *[F.get_json_object("body", f"$.{path}").cast(kind).alias(name) for name, (path, kind) in numbers.items()])


_ICON = "CASE WHEN status = 'VALID' THEN '✅' WHEN status LIKE '%HALLUCINATION%' THEN '❌' ELSE '⚠️' END"
_BLOCK = f"list_filter(['', concat('### ', CAST(row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS VARCHAR), '. ', {_ICON}, ' ', status), concat('**Claim:** \"', original_text, '\"'), concat('**Reason:** ', reason), CASE WHEN {_SHOWN} THEN concat('**Ground Truth:** ', t1, ' vs ', t2, ' (', t_strength, ' ', t_direction, ')') END], lambda x: x IS NOT NULL)"
_TOP = f"['# Hallucination Analysis Report', '**Dataset:** {RUN[0]}', '**Model:** {RUN[1]}', '**Date:** {RUN[2]}', '', '## Executive Summary', concat('- **Total Claims:** ', total_claims), concat('- **Valid Claims:** ', valid_claims), concat('- **Hallucinations:** ', hallucinations), concat('- **Hallucination Rate:** ', printf('%.2f', hallucination_rate * 100), '%'), concat('- **Insight Validity Score:** ', printf('%.2f', insight_validity_score * 100), '%'), '', '## Detailed Validation']"


@query("report_markdown", f"SELECT source_id, ordinal, CAST(generate_subscripts(block, 1) - 1 AS INTEGER) AS line_no, unnest(block) AS line FROM (SELECT source_id, ordinal, {_BLOCK} AS block FROM {VERDICTS_SQL} UNION ALL SELECT -1, -1, {_TOP} FROM ({metrics_sql()}))")
def _(spark, folder):
    found = saved(verdict_rows(spark, folder), "verdicts")  # read twice: the rows and their metrics
    return report.report_markdown(found, metrics.verdict_metrics(found), *RUN)


@query("prompt_table", "SELECT o_orderstatus AS slice, count(*) AS n_rows, concat('You are a data analyst. State numbered insights that the statistics below support.', chr(10), 'Slice: o_orderstatus = ', o_orderstatus, ', rows: ', count(*), chr(10), printf('- o_totalprice: mean %.2f, min %.2f, max %.2f', avg(o_totalprice), min(o_totalprice), max(o_totalprice)), chr(10), printf('- o_custkey: mean %.2f, min %.2f, max %.2f', avg(o_custkey), CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE))) AS prompt FROM orders GROUP BY o_orderstatus")
def _(spark, folder):
    return prompts.prompt_table(read(spark, folder, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey"])


# --- models -------------------------------------------------------------------------------------------


@query("train_test_split", "SELECT o_orderkey, CASE WHEN CAST(concat('0x', substring(md5(concat('42:', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) % 1000 < 800 THEN 'train' ELSE 'test' END AS split FROM orders")
def _(spark, folder):
    return model.train_test_split(read(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


def _scored(rows: DataFrame, target: str, features: list[str], score: Callable[[Column, Column], Column], trees: int) -> DataFrame:
    rows = model.train_test_split(rows, "o_orderkey")
    fitted = model.forest(rows.where("split = 'train'"), target, features, trees=trees)
    found = fitted.transform(rows.where("split = 'test'"))
    actual = F.col(target) if model.task_of(rows, target) == "regression" else F.col("label")
    return found.agg(F.count("*").alias("n"), score(actual.cast("double"), F.col("prediction")).alias("score"))


@query("forest_regression")
def _(spark, folder):
    rows = derived(spark, folder, "orders", {"o_orderkey": "o_orderkey", **FACTS})
    return _scored(rows, "half", ["price", "status", "priority"], model.score_r2, 100)


@query("forest_classification")
def _(spark, folder):
    rows = derived(spark, folder, "orders", {"o_orderkey": "o_orderkey", **FACTS})
    return _scored(rows, "band", ["half", "status", "priority"], model.score_accuracy, 100)


_SUMS = "(SELECT o_orderkey % 5 AS fold, CAST(o_custkey % 400 AS VARCHAR) AS level, o_totalprice AS y FROM orders)"


@query("target_encoding", f"SELECT o_orderkey, round(((SELECT coalesce(sum(y), 0) FROM {_SUMS} s WHERE s.level = CAST(o_custkey % 400 AS VARCHAR) AND s.fold <> o_orderkey % 5) + 20 * (SELECT avg(o_totalprice) FROM orders)) / (20 + (SELECT count(*) FROM {_SUMS} s WHERE s.level = CAST(o_custkey % 400 AS VARCHAR) AND s.fold <> o_orderkey % 5)), 4) AS mean FROM orders")
def _(spark, folder):
    rows = read(spark, folder, "orders").selectExpr("o_orderkey", "o_totalprice", "cast(o_custkey % 400 as string) AS customer")
    fold = (F.col("o_orderkey") % 5).cast("int")
    table, means = encode.encoding(encode.level_sums(rows, "customer", [F.col("o_totalprice")], fold))
    return encode.encoded(rows, "customer", table, means, fold, "means").select("o_orderkey", F.round(F.col("means")[0], 4).alias("mean"))


@query("forest_many_levels")
def _(spark, folder):
    rows = model.train_test_split(derived(spark, folder, "orders", {"o_orderkey": "o_orderkey", **FACTS, "name": "concat('order ', o_orderkey)", "customer": "concat('customer ', o_custkey)"}), "o_orderkey")
    fitted = encode.encoded_forest(rows.where("split = 'train'"), "half", ["price", "status", "name", "customer"], "o_orderkey", trees=20)
    found = fitted.transform(rows.where("split = 'test'"))
    return found.agg(F.count("*").alias("n"), model.score_r2(F.col("half"), F.col("prediction")).alias("score"))


@query("score_r2", "SELECT round(1 - sum((o_totalprice - p) * (o_totalprice - p)) / (var_pop(o_totalprice) * count(*)), 6) AS r2 FROM (SELECT o_totalprice, avg(o_totalprice) OVER (PARTITION BY floor(o_totalprice / 100000)) AS p FROM orders)")
def _(spark, folder):
    rows = read(spark, folder, "orders").select("o_totalprice", F.floor(F.col("o_totalprice") / 100000).alias("bin"))
    means = rows.groupBy("bin").agg(F.avg("o_totalprice").alias("p"))
    return rounded(rows.join(means, "bin").agg(model.score_r2(F.col("o_totalprice"), F.col("p")).alias("r2")))


@query("score_accuracy", "SELECT round(avg(CASE WHEN o_orderpriority = (SELECT min(o_orderpriority) FROM orders) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders")
def _(spark, folder):
    rows = read(spark, folder, "orders").select("o_orderpriority")
    first = rows.agg(F.min("o_orderpriority").alias("p"))
    return rounded(rows.crossJoin(F.broadcast(first)).agg(model.score_accuracy(F.col("o_orderpriority"), F.col("p")).alias("accuracy")))  # one row
