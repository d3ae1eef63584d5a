"""DuckDB SQL of the statistical operators, by which their results are checked."""

from __future__ import annotations

from itertools import combinations


def t_p(t: str, v: str) -> str:
    """Two-sided p-value of a t statistic: one less Simpson's rule over its density, up to 40."""
    x = f"(least(abs({t}), 40.0) * k / 4000.0)"
    weight = "CASE WHEN k = 0 OR k = 4000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"
    area = f"(SELECT sum({weight} * pow(1 + {x} * {x} / {v}, -({v} + 1) / 2.0)) * least(abs({t}), 40.0) / 12000.0 FROM generate_series(0, 4000) g(k))"
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi() * {v}) * {area})"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of an F statistic whose first degrees of freedom are even: a finite sum."""
    x, a = f"({d2} / ({d2} + {d1} * {f}))", f"({d2} / 2.0)"
    term = f"CASE WHEN i = 0 THEN exp({a} * ln({x})) ELSE exp({a} * ln({x}) + lgamma({a} + i) - lgamma({a}) - lgamma(i + 1.0) + i * ln(greatest(1 - {x}, 1e-300))) END"
    return f"(SELECT sum({term}) FROM generate_series(0, CAST({d1} / 2 AS BIGINT) - 1) g(i))"


def chi2_p(x: str, dof: str) -> str:
    """Upper tail of a chi-square statistic whose degrees of freedom are even: a finite sum."""
    return f"(SELECT sum(CASE WHEN i = 0 THEN exp(-({x}) / 2) ELSE exp(-({x}) / 2 + i * ln(greatest({x}, 1e-300) / 2) - lgamma(i + 1.0)) END) FROM generate_series(0, CAST({dof} / 2 AS BIGINT) - 1) g(i))"


def profile(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {source}"
        for c in columns
    )


def pearson(source: str, columns: list[str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, CASE WHEN var_samp({a}) > 0 AND var_samp({b}) > 0 THEN least(1.0, greatest(-1.0, covar_samp({a}, {b}) / sqrt(var_samp({a})) / sqrt(var_samp({b})))) END AS r "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in combinations(columns, 2)
    ) + ") WHERE r IS NOT NULL AND n >= 2"


def spearman(source: str, columns: list[str]) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, corr(ra, rb) AS rho FROM (SELECT CAST({rank(a)} AS DOUBLE) AS ra, CAST({rank(b)} AS DOUBLE) AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in combinations(columns, 2)
    )


STRENGTH = "CASE WHEN {0} >= 0.8 THEN 'strong' WHEN {0} >= 0.5 THEN 'moderate' WHEN {0} >= 0.2 THEN 'weak' ELSE 'negligible' END"


def correlation_tests(source: str, columns: list[str]) -> str:
    p = lambda r: f"CASE WHEN abs({r}) >= 1 THEN 0.0 ELSE {t_p(f'({r} * sqrt((n - 2) / (1 - {r} * {r})))', '(n - 2.0)')} END"
    both = f"SELECT p.var1, p.var2, p.n, p.r, s.rho FROM ({pearson(source, columns)}) p JOIN ({spearman(source, columns)}) s ON p.var1 = s.var1 AND p.var2 = s.var2"
    tested = f"SELECT *, {p('r')} AS pearson_p, {p('rho')} AS spearman_p, greatest(abs(r), abs(rho)) AS effect FROM ({both})"
    return f"SELECT *, {STRENGTH.format('effect')} AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({tested})"


def moments(source: str, numbers: list[str], categories: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS var1, '{c}' AS var2, CAST({c} AS VARCHAR) AS level, count({x}) AS n, avg({x}) AS mean, CASE WHEN count({x}) > 1 THEN var_samp({x}) END AS variance FROM {source} WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY {c}"
        for x in numbers for c in categories
    )


def group_tests(source: str, numbers: list[str], categories: list[str]) -> str:
    """Pairs of two levels, or of an odd number of levels, with variation within the groups."""
    m = f"SELECT * FROM ({moments(source, numbers, categories)})"
    ends = f"SELECT var1, var2, arg_min(level, (-mean, level)) AS highest, arg_min(level, (mean, level)) AS lowest FROM ({m}) GROUP BY ALL"
    usable = f"SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS grand FROM ({m}) WHERE n >= 2 WINDOW w AS (PARTITION BY var1, var2)"
    sums = (
        "SELECT var1, var2, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n, sum(n * (mean - grand) * (mean - grand)) AS between_, sum((n - 1) * variance) AS within_, "
        "arg_min(mean, level) AS ma, arg_max(mean, level) AS mb, arg_min(variance / n, level) AS va, arg_max(variance / n, level) AS vb, arg_min(n, level) AS na, arg_max(n, level) AS nb "
        f"FROM ({usable}) GROUP BY ALL HAVING count(*) >= 2"
    )
    stats = (
        f"SELECT *, CASE WHEN n_groups = 2 THEN (ma - mb) / sqrt(va + vb) ELSE (between_ / (n_groups - 1)) / (within_ / (n - n_groups)) END AS stat, "
        f"CASE WHEN n_groups = 2 THEN (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) ELSE CAST(n_groups - 1 AS DOUBLE) END AS dof1, CASE WHEN n_groups > 2 THEN CAST(n - n_groups AS DOUBLE) END AS dof2 FROM ({sums})"
    )
    p = f"CASE WHEN n_groups = 2 THEN {t_p('stat', 'dof1')} ELSE {f_p('stat', 'dof1', 'dof2')} END"
    return f"SELECT s.var1, s.var2, CASE WHEN n_groups = 2 THEN 't-test' ELSE 'ANOVA' END AS test, n_groups, n, stat, dof1, dof2, {p} AS p_value, highest, lowest FROM ({stats}) s JOIN ({ends}) e ON s.var1 = e.var1 AND s.var2 = e.var2"


def contingency(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({a} AS VARCHAR) AS level1, CAST({b} AS VARCHAR) AS level2, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in combinations(columns, 2))


def chi_square(source: str, columns: list[str]) -> str:
    """Pairs with an even number of degrees of freedom, absent cells counted as such."""
    cells = f"SELECT *, sum(n) OVER (PARTITION BY var1, var2, level1) AS r, sum(n) OVER (PARTITION BY var1, var2, level2) AS c, sum(n) OVER (PARTITION BY var1, var2) AS t FROM ({contingency(source, columns)})"
    sums = (
        f"SELECT var1, var2, CAST(max(t) AS BIGINT) AS n, count(DISTINCT level1) AS n_rows, count(DISTINCT level2) AS n_columns, sum((n - r * c / CAST(t AS DOUBLE)) * (n - r * c / CAST(t AS DOUBLE)) / (r * c / CAST(t AS DOUBLE))) + max(t) - sum(r * c / CAST(t AS DOUBLE)) AS stat FROM ({cells}) GROUP BY ALL"
    )
    stats = f"SELECT *, (n_rows - 1) * (n_columns - 1) AS dof FROM ({sums}) WHERE n_rows >= 2 AND n_columns >= 2"
    return f"SELECT var1, var2, n, n_rows, n_columns, stat, dof, {chi2_p('stat', 'dof')} AS p_value, sqrt(stat / (n * (least(n_rows, n_columns) - 1))) AS cramers_v FROM ({stats})"


def truth(source: str, numbers: list[str], categories: list[str]) -> str:
    same = f"SELECT 'correlation' AS kind, 1 AS priority, var1, var2, 'pearson' AS test, r AS stat, n, pearson_p AS p_value, effect, strength, direction FROM ({correlation_tests(source, numbers)}) WHERE (pearson_p < 0.05 OR spearman_p < 0.05) AND strength <> 'negligible'"
    groups = f"SELECT 'group_difference' AS kind, 2 AS priority, var1, var2, test, stat, n, p_value, CAST(NULL AS DOUBLE) AS effect, CASE WHEN p_value < 0.01 THEN 'significant' ELSE 'moderate' END AS strength, concat(highest, ' > ', lowest) AS direction FROM ({group_tests(source, numbers, categories)}) WHERE p_value < 0.05"
    linked = f"SELECT 'categorical_association' AS kind, 3 AS priority, var1, var2, 'chi-square' AS test, stat, n, p_value, cramers_v AS effect, {STRENGTH.format('cramers_v')} AS strength, 'associated' AS direction FROM ({chi_square(source, categories)}) WHERE p_value < 0.05 AND cramers_v >= 0.2"
    return f"{same} UNION ALL {groups} UNION ALL {linked}"
