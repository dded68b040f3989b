"""Profiling and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policies
from ..operators import fairness, profile
from . import views as V
from .registry import query

COLS = V.NUMERIC


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("prof_imbalance", f"""WITH {V.ITEMS}, c AS (SELECT y, count(*) n FROM items GROUP BY y)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, arg_min(y, (n, y)) AS minority_class, -arg_max(-y, (n, -y)) AS majority_class,
  min(n) AS n_minority, max(n) AS n_majority, round(max(n) / min(n), 6) AS imbalance_ratio, CAST(greatest(0, max(n) - min(n)) AS BIGINT) AS gap,
  CASE WHEN sum(n) < 500 THEN 'very_small' WHEN sum(n) < 5000 THEN 'small' WHEN sum(n) < 50000 THEN 'medium' ELSE 'large' END AS size_category,
  CASE WHEN max(n) / min(n) < 3 THEN 'mild' WHEN max(n) / min(n) < 7 THEN 'moderate' ELSE 'severe' END AS imbalance_category, 'low' AS complexity_category FROM c""")
def prof_imbalance(spark, sf):
    return profile.balance(V.items(spark, sf), features=len(COLS))


_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, min({c}) AS min, max({c}) AS max, round(avg({c}), 8) AS mean,
  round(stddev_samp({c}), 8) AS sd, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, round(skewness({c}), 4) AS skewness,
  bool_and({c} = floor({c})) AS integral FROM items""" for c in COLS)  # fmt: skip


@query("prof_columns", f"""WITH {V.ITEMS}, s AS ({_STATS})
SELECT "column", n_null, n_unique, min, max, mean, sd, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, skewness,
  round(q1 - 3 * (q3 - q1), 6) AS fence_low, round(q3 + 3 * (q3 - q1), 6) AS fence_high,
  CASE WHEN n_unique = 2 THEN 'binary' WHEN n_unique <= 20 THEN 'ordinal' WHEN integral THEN 'discrete' ELSE 'continuous' END AS kind FROM s""")
def prof_columns(spark, sf):
    out = profile.numeric_columns(V.items(spark, sf), COLS)
    return rounded(rounded(rounded(out, "mean", "sd", digits=8), "q1", "median", "q3", "fence_low", "fence_high"), "skewness", digits=4)


@query("prof_text_columns", """WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL)
SELECT "column", CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS n_null, count(value) AS n_unique, max(n) AS mode_count, arg_min(value, (-n, value)) AS mode,
  string_agg(value, ',' ORDER BY value) AS categories, count(value) > 2 AND bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS is_ordinal FROM c GROUP BY "column" """)
def prof_text_columns(spark, sf):
    return profile.text_columns(V.table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


_CORR = " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, round(corr({a}, {b}), 6) AS r FROM items" for i, a in enumerate(COLS) for b in COLS[i + 1 :])


@query("prof_corr", f"WITH {V.ITEMS}, c AS ({_CORR}) SELECT *, abs(r) >= 0.01 AS is_strong FROM c")
def prof_corr(spark, sf):
    return rounded(profile.correlations(V.items(spark, sf), COLS, strong=0.01), "r")


@query("prof_corr_partners", f"""WITH {V.ITEMS}, c AS ({_CORR}), b AS (SELECT c1 AS "column", c2 AS p FROM c WHERE abs(r) >= 0.01 UNION ALL SELECT c2, c1 FROM c WHERE abs(r) >= 0.01)
SELECT "column", string_agg(p, ',' ORDER BY p) AS partners FROM b GROUP BY 1""")
def prof_corr_partners(spark, sf):
    return profile.correlated_with(profile.correlations(V.items(spark, sf), COLS, strong=0.01))


_SPARSE = "sparse AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS b, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS c FROM orders)"


def _sparse(spark, sf):
    k = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(F.when(k % 2 == 0, F.col("o_totalprice")).alias("a"), F.when(k % 2 == 1, F.col("o_custkey")).alias("b"), F.when(k % 3 == 0, 1).alias("c"))


@query("prof_mutex", f"""WITH {_SPARSE}, n AS (SELECT count(*) - count(a) AS a, count(*) - count(b) AS b, count(*) - count(c) AS c FROM sparse),
p AS (SELECT 'a' AS c1, 'b' AS c2, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s FROM sparse UNION ALL
  SELECT 'a', 'c', avg(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM sparse UNION ALL SELECT 'b', 'c', avg(CASE WHEN b IS NOT NULL AND c IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM sparse)
SELECT c1, c2, round(s, 6) AS both_share, s < 0.05 AND n.a > 0 AND n.b > 0 AND n.c > 0 AS exclusive FROM p, n""")
def prof_mutex(spark, sf):
    return rounded(profile.exclusive_pairs(_sparse(spark, sf), ["a", "b", "c"]), "both_share")


@query("prof_implication", """SELECT count(*) FILTER (o_totalprice > 200000) AS n_condition, count(*) FILTER (o_totalprice > 200000 AND NOT o_orderstatus <> 'F') AS n_violations,
  count(*) FILTER (o_totalprice > 200000 AND NOT o_orderstatus <> 'F') = 0 AS holds FROM orders""")
def prof_implication(spark, sf):
    return profile.implication_violations(V.table(spark, sf, "orders"), "o_totalprice > 200000", "o_orderstatus <> 'F'")


_OVER = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) FILTER (y = 1) AS a_low, max({c}) FILTER (y = 1) AS a_high, min({c}) FILTER (y = 0) AS b_low, max({c}) FILTER (y = 0) AS b_high FROM items" for c in COLS)


@query("prof_overlap", f"""WITH {V.ITEMS}, o AS ({_OVER})
SELECT *, round(coalesce(greatest(0, least(a_high, b_high) - greatest(a_low, b_low)) / nullif(greatest(a_high, b_high) - least(a_low, b_low), 0) * 100, 0), 6) AS overlap_percent FROM o""")
def prof_overlap(spark, sf):
    return rounded(profile.class_overlap(V.items(spark, sf), COLS), "overlap_percent")


@query("prof_crosstab", f"""WITH {V.LABELLED} SELECT lang AS "group", count(*) AS n, round(avg(CAST(y = 0 AS DOUBLE)), 6) AS share_0, round(avg(CAST(y = 1 AS DOUBLE)), 6) AS share_1 FROM labelled GROUP BY lang""")
def prof_crosstab(spark, sf):
    return rounded(profile.crosstab(V.labelled(spark, sf), "lang"), "share_0", "share_1")


@query("prof_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM customer" for c in ["c_acctbal", "CAST(c_nationkey AS DOUBLE)"]).replace("'CAST(c_nationkey AS DOUBLE)'", "'c_nationkey'"))
def prof_describe(spark, sf):
    return rounded(profile.describe(V.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]), "mean", "sd", "q1", "median", "q3")


@query("prof_feature_kinds", """SELECT 2 + CAST(count(DISTINCT l_quantity) < 10 AS BIGINT) + CAST(count(DISTINCT l_extendedprice) < 10 AS BIGINT) + CAST(count(DISTINCT l_discount) < 10 AS BIGINT) + CAST(count(DISTINCT l_tax) < 10 AS BIGINT) + CAST(count(DISTINCT l_linenumber) < 10 AS BIGINT) AS n_categorical,
  CAST(count(DISTINCT l_quantity) >= 10 AS BIGINT) + CAST(count(DISTINCT l_extendedprice) >= 10 AS BIGINT) + CAST(count(DISTINCT l_discount) >= 10 AS BIGINT) + CAST(count(DISTINCT l_tax) >= 10 AS BIGINT) + CAST(count(DISTINCT l_linenumber) >= 10 AS BIGINT) AS n_numeric FROM lineitem""")
def prof_feature_kinds(spark, sf):
    return profile.feature_kinds(V.items(spark, sf), [*COLS, "returnflag", "linestatus"])


@query("prof_top_categories", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def prof_top_categories(spark, sf):
    return profile.top_categories(V.table(spark, sf, "part"), "p_brand", 8)


@query("prof_histogram", """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 10) r(i)),
c AS (SELECT CAST(least(9, floor((o_totalprice - lo) / (hi - lo) * 10)) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 10), 4) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 10), 4) AS high, coalesce(n, 0) AS n FROM g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def prof_histogram(spark, sf):
    return rounded(profile.histogram(V.table(spark, sf, "orders"), "o_totalprice", 10), "low", "high", digits=4)


@query("prof_complexity", f"""WITH {V.ITEMS}, c AS ({_CORR.replace('round(corr', '(corr').replace(', 6) AS r', ') AS r')}), r AS (SELECT sum(abs(r)) * 2 / 25 AS m FROM c),
b AS (SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS n_minority, count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS ratio, (count(DISTINCT returnflag) + count(DISTINCT linestatus)) / 2 AS card FROM items)
SELECT n_rows, n_minority, round(ratio, 6) AS ratio, round(card, 6) AS avg_cardinality, round(m, 6) AS mean_abs_r, 7 AS n_features,
  round(0.15 * least(1.0, 7 / 50) + 0.2 * least(1.0, ratio / 20) + 0.25 * least(1.0, 1000.0::DOUBLE / greatest(n_minority, 1) / 10) + 0.15 * least(1.0, card / 20) + 0.1 * m + 0.15 * 2 / 7, 6) AS score FROM b, r""")
def prof_complexity(spark, sf):
    out = profile.complexity(V.items(spark, sf), COLS, ["returnflag", "linestatus"])
    return rounded(out, "ratio", "avg_cardinality", "mean_abs_r", "score")


@query("prof_budget", None)
def prof_budget(spark, sf):
    """The iteration budget and recommended settings of the profile; policies run on the driver over one row."""
    row = profile.complexity(V.items(spark, sf), COLS, ["returnflag", "linestatus"]).first()
    gap = max(0, row.n_rows - 2 * row.n_minority)
    rate = policies.validation_rate(row.n_minority, row.ratio, row.n_features, complexity=row.score)
    batch = policies.batch_size(row.n_features, gap)
    b = policies.iteration_budget(gap, rate, batch, row.score)
    plan = policies.strategy("large", "moderate", "low", False)
    data = [(gap, round(rate, 6), batch, b.iterations, b.minutes, b.expected_rows, b.capped, policies.hosted_budget(gap, batch), str(sorted(plan.items())), "; ".join(policies.warnings(row.n_rows, row.n_minority, row.ratio, row.n_features)))]
    return spark.createDataFrame(data, "gap long, rate double, batch int, iterations int, minutes double, expected_rows long, capped boolean, hosted_iterations int, strategy string, warnings string")


_DIST = f"""{V.LABELLED}, g AS (SELECT 'lang' AS attribute, lang AS "group", y FROM labelled UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), y FROM labelled),
n AS (SELECT attribute, "group", count(*) FILTER (y = 1) AS n_minority, count(*) FILTER (y = 0) AS n_majority FROM g WHERE "group" IS NOT NULL GROUP BY ALL),
dist AS (SELECT *, coalesce(n_minority / nullif(sum(n_minority) OVER (PARTITION BY attribute), 0), 0) AS p_minority, coalesce(n_majority / nullif(sum(n_majority) OVER (PARTITION BY attribute), 0), 0) AS p_majority,
  sum(n_minority) OVER (PARTITION BY attribute) AS n_all FROM n)"""
_SEV = "CASE WHEN {0} < 0.05 THEN 'none' WHEN {0} < 0.2 THEN 'low' WHEN {0} < 0.5 THEN 'medium' ELSE 'high' END"
SENSITIVE = ["lang", "quality"]


@query("fair_groupdist", f'WITH {_DIST} SELECT attribute, "group", n_minority, n_majority, round(p_minority, 6) AS p_minority, round(p_majority, 6) AS p_majority FROM dist')
def fair_groupdist(spark, sf):
    return rounded(fairness.group_distributions(V.labelled(spark, sf), SENSITIVE), "p_minority", "p_majority")


@query("fair_underrep", f'WITH {_DIST} SELECT attribute, "group", n_minority, n_majority, round(p_minority, 6) AS p_minority, round(p_majority, 6) AS p_majority, round(p_majority - p_minority, 6) AS shortfall FROM dist WHERE p_minority < 0.99 * p_majority')
def fair_underrep(spark, sf):
    return rounded(fairness.underrepresented(fairness.group_distributions(V.labelled(spark, sf), SENSITIVE), 0.99), "p_minority", "p_majority", "shortfall")


_PARITY = f"""{V.LABELLED}, g AS (SELECT 'lang' AS attribute, lang AS "group", y FROM labelled UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), y FROM labelled),
r AS (SELECT attribute, "group", avg(CAST(y AS DOUBLE)) AS rate FROM g GROUP BY ALL),
parity AS (SELECT attribute, max(rate) - min(rate) AS dpd, arg_max("group", (rate, "group")) AS privileged, arg_min("group", (rate, "group")) AS unprivileged FROM r GROUP BY attribute HAVING count(*) = 2)"""


@query("fair_dpd", f"WITH {_PARITY} SELECT attribute, round(dpd, 6) AS dpd, privileged, unprivileged, {_SEV.format('dpd')} AS severity, dpd > 0.05 AS violation FROM parity")
def fair_dpd(spark, sf):
    return rounded(fairness.label_parity(V.labelled(spark, sf), SENSITIVE), "dpd")


@query("fair_targets", f"""WITH {_DIST}, t AS (SELECT *, p_majority - p_minority AS gap FROM dist WHERE p_minority < 0.99 * p_majority)
SELECT attribute, "group", round(gap, 6) AS gap, CAST(greatest(0, floor(gap * n_all * 2)) AS BIGINT) AS n_target, {_SEV.format('gap')} AS severity, CASE {_SEV.format('gap')} WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM t""")
def fair_targets(spark, sf):
    return rounded(fairness.targets(fairness.group_distributions(V.labelled(spark, sf), SENSITIVE), 0.99), "gap")


@query("fair_constraints", f"""WITH {_DIST}, t AS (SELECT attribute, "group", CASE {_SEV.format('(p_majority - p_minority)')} WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM dist WHERE p_minority < 0.99 * p_majority AND attribute = 'lang')
SELECT dist.attribute, dist."group", round(CASE WHEN t.priority IS NOT NULL THEN p_majority ELSE p_minority END, 6) AS proportion, t.priority IS NOT NULL AS from_target, coalesce(t.priority, 2) AS priority
FROM dist LEFT JOIN t ON t.attribute = dist.attribute AND t."group" = dist."group" WHERE (dist.attribute NOT IN (SELECT attribute FROM t) AND p_minority > 0) OR t.priority IS NOT NULL""")
def fair_constraints(spark, sf):
    """Targets for languages, the minority's own distribution for quality."""
    d = fairness.group_distributions(V.labelled(spark, sf), SENSITIVE)
    return rounded(fairness.balance_constraints(d, fairness.targets(d, 0.99).where("attribute = 'lang'")), "proportion")


@query("fair_pairs", "SELECT 'quality' AS attribute, min(CAST(quality AS VARCHAR)) AS a, max(CAST(quality AS VARCHAR)) AS b FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def fair_pairs(spark, sf):
    return fairness.counterfactual_pairs(V.labelled(spark, sf), SENSITIVE)


@query("fair_reaudit", f"""WITH {V.LABELLED}, u AS (SELECT quality, y FROM labelled UNION ALL SELECT quality, y FROM labelled WHERE y = 1 AND quality = 0),
a AS (SELECT quality, avg(CAST(y AS DOUBLE)) AS r FROM labelled GROUP BY 1), b AS (SELECT quality, avg(CAST(y AS DOUBLE)) AS r FROM u GROUP BY 1),
x AS (SELECT (SELECT max(r) - min(r) FROM a) AS p, (SELECT max(r) - min(r) FROM b) AS q)
SELECT 'quality' AS attribute, round(p, 6) AS dpd_before, round(q, 6) AS dpd_after, round(p - q, 6) AS improvement, q <= 0.05 AS met FROM x""")
def fair_reaudit(spark, sf):
    t = V.labelled(spark, sf)
    return rounded(fairness.reaudit(t, t.unionByName(t.where("y = 1 AND quality = 0")), ["quality"]), "dpd_before", "dpd_after", "improvement")


def _class_stats(c, k):
    q = lambda p: f"round(quantile_cont({c}, {p}) FILTER (y = {k}), 6)"
    return f"""SELECT '{c}' AS "column", {k} AS y, min({c}) FILTER (y = {k}) AS min, max({c}) FILTER (y = {k}) AS max, round(avg({c}) FILTER (y = {k}), 6) AS mean, {q(0.5)} AS median,
  round(stddev_samp({c}) FILTER (y = {k}), 6) AS sd, {q(0.1)} AS p10, {q(0.25)} AS p25, {q(0.75)} AS p75, {q(0.9)} AS p90 FROM items"""


@query("prof_class_statistics", f"WITH {V.ITEMS} " + " UNION ALL ".join(_class_stats(c, k) for c in ("quantity", "extendedprice") for k in (0, 1)))
def prof_class_statistics(spark, sf):
    return rounded(profile.class_statistics(V.items(spark, sf), ["quantity", "extendedprice"]), "mean", "median", "sd", "p10", "p25", "p75", "p90")


@query("prof_class_frequencies", f"""WITH {V.LABELLED}, c AS (SELECT y, source AS value, count(*) AS n FROM labelled WHERE source IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY y) AS t, row_number() OVER (PARTITION BY y ORDER BY n DESC, value) AS p FROM c) SELECT y, value, round(n / t, 6) AS share FROM r WHERE p <= 4""")
def prof_class_frequencies(spark, sf):
    return rounded(profile.class_frequencies(V.labelled(spark, sf), "source"), "share")


@query("fair_diversity_plan", f"""WITH {V.LABELLED}, p AS (SELECT lang AS "group", (count(*) FILTER (y = 1)) AS a, (count(*) FILTER (y = 0)) AS b FROM labelled WHERE lang IS NOT NULL GROUP BY 1),
s AS (SELECT *, a / sum(a) OVER () AS pa, b / sum(b) OVER () AS pb, sum(a) OVER () AS na FROM p), t AS (SELECT "group", pb - pa AS gap, CAST(greatest(0, floor((pb - pa) * na * 2)) AS BIGINT) AS n_target FROM s WHERE pa < 1.0 * pb),
g AS (SELECT lang AS "group", source, count(*) / 100.0 AS density FROM labelled WHERE lang IS NOT NULL GROUP BY ALL), n AS (SELECT "group", count(*) AS n_regions FROM g WHERE density < 0.5 GROUP BY 1)
SELECT 'lang' AS attribute, "group", n_regions, n_target, CASE WHEN gap < 0.2 THEN 3 WHEN gap < 0.5 THEN 2 ELSE 1 END AS priority FROM t JOIN n USING ("group")""")
def fair_diversity_plan(spark, sf):
    """Languages short of toxic documents, and how many of their sources hold under fifty documents."""
    t = V.labelled(spark, sf).where("lang IS NOT NULL")
    wanted = fairness.targets(fairness.group_distributions(t, ["lang"]), factor=1.0)
    regions = t.groupBy(F.lit("lang").alias("attribute"), F.col("lang").alias("group"), "source").agg((F.count("*") / 100).alias("density"))
    return fairness.diversity_plan(wanted, regions)
