"""Evaluation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dedup, evaluate, experiments, stats
from . import views as V
from .profiling import rounded
from .registry import query

P = f"{V.LABELLED}, {V.PREDICTIONS}"
_CELLS = "count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 1 AND pred = 0) AS fn"
_METRICS = """m AS (SELECT *, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c)"""
_MCOLS = ["accuracy", "precision", "recall", "f1", "specificity", "mcc", "balanced_accuracy", "g_mean"]


@query("ev_confusion", f"""WITH {P}, c AS (SELECT {_CELLS} FROM predictions), {_METRICS}
SELECT tp, fp, tn, fn, {', '.join(f'round({x}, 6) AS {x}' for x in _MCOLS[:6])}, round((recall + specificity) / 2, 6) AS balanced_accuracy, round(sqrt(recall * specificity), 6) AS g_mean FROM m""")
def ev_confusion(spark, sf):
    return rounded(evaluate.classification(V.predictions(spark, sf)), *_MCOLS)


@query("ev_confusion_by", f"""WITH {P}, c AS (SELECT lang, {_CELLS} FROM predictions GROUP BY lang), {_METRICS}
SELECT lang, tp, fp, tn, fn, {', '.join(f'round({x}, 6) AS {x}' for x in _MCOLS[:6])}, round((recall + specificity) / 2, 6) AS balanced_accuracy, round(sqrt(recall * specificity), 6) AS g_mean FROM m""")
def ev_confusion_by(spark, sf):
    return rounded(evaluate.classification(V.predictions(spark, sf), by=["lang"]), *_MCOLS)


@query("ev_auc", f"""WITH {P}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM predictions), n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM predictions),
t AS (SELECT score, sum(count(*) FILTER (y = 1)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k, count(*) FILTER (y = 1) AS pos FROM predictions GROUP BY score)
SELECT round((SELECT (sum(r) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) FROM r, n), 6) AS roc_auc, round((SELECT sum(pos * (tp / k)) / any_value(p) FROM t, n), 6) AS pr_auc""")
def ev_auc(spark, sf):
    return rounded(evaluate.roc_auc(V.predictions(spark, sf)), "roc_auc", "pr_auc")


@query("ev_curves", f"""WITH {P}, n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM predictions),
t AS (SELECT score, sum(count(*) FILTER (y = 1)) OVER (ORDER BY score DESC) AS tp, sum(count(*) FILTER (y = 0)) OVER (ORDER BY score DESC) AS fp FROM predictions GROUP BY score)
SELECT score, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM t, n""")
def ev_curves(spark, sf):
    return rounded(evaluate.curves(V.predictions(spark, sf)), "fpr", "tpr", "precision")


@query("ev_threshold", f"""WITH {P}, g AS (SELECT i, 0.1::DOUBLE + 0.8::DOUBLE * i / 99 AS threshold FROM range(0, 100) r(i)),
c AS (SELECT i, threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 0 AND score < threshold) AS tn, count(*) FILTER (y = 1 AND score < threshold) AS fn FROM predictions, g GROUP BY ALL), {_METRICS}
SELECT 'f1' AS metric, round(arg_min(threshold, (-round(f1, 9), i)), 6) AS threshold, round(arg_min(f1, (-round(f1, 9), i)), 6) AS value FROM m""")
def ev_threshold(spark, sf):
    return rounded(evaluate.best_threshold(V.predictions(spark, sf)), "threshold", "value")


@query("ev_perclass", f"""WITH {P}, k AS (SELECT * FROM (VALUES (0), (1)) t(c)), s AS (SELECT c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (y = c AND pred = c) AS hits FROM predictions, k GROUP BY c),
x AS (SELECT class, support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM s)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM x""")
def ev_perclass(spark, sf):
    return rounded(evaluate.per_class(V.predictions(spark, sf)), "precision", "recall", "f1")


_RATES = f"""{P}, g AS (SELECT 'lang' AS attribute, lang AS "group", y, pred FROM predictions UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), y, pred FROM predictions),
r AS (SELECT attribute, "group", avg(CAST(pred AS DOUBLE)) AS sr, coalesce(count(*) FILTER (y = 1 AND pred = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS tpr, coalesce(count(*) FILTER (y = 0 AND pred = 1) / nullif(count(*) FILTER (y = 0), 0), 0) AS fpr FROM g GROUP BY ALL),
f AS (SELECT attribute, max(sr) - min(sr) AS dpd, coalesce(min(sr) / nullif(max(sr), 0), 0) AS dpr, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eod,
  least(coalesce(min(tpr) / nullif(max(tpr), 0), 0), coalesce(min(fpr) / nullif(max(fpr), 0), 0)) AS eor FROM r GROUP BY attribute)"""


@query("ev_fairness", f"WITH {_RATES} SELECT attribute, round(dpd, 6) AS dpd, round(dpr, 6) AS dpr, round(eod, 6) AS eod, round(eor, 6) AS eor FROM f")
def ev_fairness(spark, sf):
    return rounded(evaluate.fairness(V.predictions(spark, sf), ["lang", "quality"]), "dpd", "dpr", "eod", "eor")


@query("ev_fairness_summary", f"""WITH {_RATES} SELECT round(avg(dpd), 6) AS avg_dpd, round(avg(dpr), 6) AS avg_dpr, round(avg(eod), 6) AS avg_eod, round(avg(eor), 6) AS avg_eor, round(max(greatest(dpd, eod)), 6) AS max_violation,
  bool_and(dpd <= 0.1) AS pass_dpd, bool_and(eod <= 0.1) AS pass_eod, bool_and(dpr >= 0.8) AS pass_dpr, bool_and(eor >= 0.8) AS pass_eor FROM f""")
def ev_fairness_summary(spark, sf):
    out = evaluate.fairness_summary(evaluate.fairness(V.predictions(spark, sf), ["lang", "quality"]))
    return rounded(out, "avg_dpd", "avg_dpr", "avg_eod", "avg_eor", "max_violation")


@query("ev_fairness_both", f"""WITH {_RATES}, b AS (SELECT *, quality = 1 AS g, CAST(pred - y + 1 AS DOUBLE) AS b FROM predictions), mu AS (SELECT avg(b) AS mu FROM b),
s AS (SELECT avg(pred) FILTER (NOT g) su, avg(pred) FILTER (g) sp, avg(pred) FILTER (NOT g AND y = 1) tu, avg(pred) FILTER (g AND y = 1) tp, avg(pred) FILTER (NOT g AND y = 0) fu, avg(pred) FILTER (g AND y = 0) fp, avg(CASE WHEN b > 0 THEN b / mu * ln(b / mu) ELSE 0 END) AS theil FROM b, mu)
SELECT attribute, round(dpd, 6) AS dpd, round(dpr, 6) AS dpr, round(eod, 6) AS eod, round(eor, 6) AS eor, round(su - sp, 6) AS spd, round(su / sp, 6) AS disparate_impact, round(tu - tp, 6) AS equal_opportunity, round((tu - tp + fu - fp) / 2, 6) AS average_odds, round(theil, 6) AS theil FROM f, s WHERE attribute = 'quality'""")
def ev_fairness_both(spark, sf):
    both = evaluate.all_fairness(V.predictions(spark, sf), "quality", "1")
    return rounded(both, "dpd", "dpr", "eod", "eor", "spd", "disparate_impact", "equal_opportunity", "average_odds", "theil")


@query("ev_theil", f"""WITH {P}, b AS (SELECT *, quality = 1 AS g, CAST(pred - y + 1 AS DOUBLE) AS b FROM predictions), mu AS (SELECT avg(b) AS mu FROM b),
s AS (SELECT avg(pred) FILTER (NOT g) su, avg(pred) FILTER (g) sp, avg(pred) FILTER (NOT g AND y = 1) tu, avg(pred) FILTER (g AND y = 1) tp, avg(pred) FILTER (NOT g AND y = 0) fu, avg(pred) FILTER (g AND y = 0) fp, avg(CASE WHEN b > 0 THEN b / mu * ln(b / mu) ELSE 0 END) AS theil FROM b, mu)
SELECT 'quality' AS attribute, round(su - sp, 6) AS spd, round(su / sp, 6) AS disparate_impact, round(tu - tp, 6) AS equal_opportunity, round((tu - tp + fu - fp) / 2, 6) AS average_odds, round(theil, 6) AS theil FROM s""")
def ev_theil(spark, sf):
    return rounded(evaluate.binary_fairness(V.predictions(spark, sf), "quality", "1"), "spd", "disparate_impact", "equal_opportunity", "average_odds", "theil")


_CELL = f"{V.RESULTS}, cell AS (SELECT dataset, method, round(avg(metric), 4) AS metric FROM results GROUP BY ALL)"
_RANKED = "rank() OVER (PARTITION BY {0} ORDER BY metric DESC) + (count(*) OVER (PARTITION BY {0}, metric) - 1) / 2"


def _cells(spark, sf):
    return V.results(spark, sf).groupBy("dataset", "method").agg(F.round(F.avg("metric"), 4).alias("metric"))


@query("st_ranks", f"WITH {_CELL}, r AS (SELECT *, {_RANKED.format('dataset')} AS r FROM cell) SELECT method, round(avg(r), 6) AS mean_rank, count(*) AS n_blocks FROM r GROUP BY method")
def st_ranks(spark, sf):
    return rounded(stats.mean_ranks(_cells(spark, sf), ["dataset"], "method", "metric"), "mean_rank")


@query("st_blockranks", f"WITH {V.RESULTS}, b AS (SELECT dataset, classifier, method, round(avg(metric), 4) AS metric FROM results GROUP BY ALL), r AS (SELECT *, {_RANKED.format('dataset, classifier')} AS r FROM b) SELECT method, round(avg(r), 6) AS mean_rank, count(*) AS n_blocks FROM r GROUP BY method")
def st_blockranks(spark, sf):
    t = V.results(spark, sf).groupBy("dataset", "classifier", "method").agg(F.round(F.avg("metric"), 4).alias("metric"))
    return rounded(stats.mean_ranks(t, ["dataset", "classifier"], "method", "metric"), "mean_rank")


@query("st_run_ranks", f"WITH {V.RESULTS} SELECT dataset, seed, classifier, method, {_RANKED.format('dataset, seed, classifier')} AS rank FROM results")
def st_run_ranks(spark, sf):
    return stats.average_ranks(V.results(spark, sf), ["dataset", "seed", "classifier"], "metric").select("dataset", "seed", "classifier", "method", "rank")


_FRIED = f"""{_CELL}, r AS (SELECT *, {_RANKED.format('dataset')} AS r FROM cell), s AS (SELECT method, sum(r) AS s FROM r GROUP BY 1), z AS (SELECT count(DISTINCT dataset) AS n, count(DISTINCT method) AS k FROM r),
f AS (SELECT 12 / (n * k * (k + 1)) * (SELECT sum(s * s) FROM s) - 3 * n * (k + 1) AS x, n, k FROM z)"""


@query("st_friedman", f"WITH {_FRIED} SELECT round(x, 6) AS statistic, k - 1 AS dof, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value, n AS n_blocks, k AS n_methods FROM f")
def st_friedman(spark, sf):
    return rounded(stats.friedman(_cells(spark, sf), ["dataset"], "method", "metric"), "statistic", "p_value")


_DIFF = f"""{_CELL}, d AS (SELECT c.method, c.dataset, b.metric - c.metric AS diff FROM cell c JOIN cell b ON b.dataset = c.dataset AND b.method = 'BUILDING' WHERE c.method <> 'BUILDING'),
sr AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY method, abs(diff)) - 1) / 2 AS r FROM d WHERE diff <> 0),
w AS (SELECT method, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS wm, list(r) AS ranks FROM sr GROUP BY 1)"""


@query("st_signed_ranks", f"WITH {_DIFF} SELECT method, n, wp AS w_plus, wm AS w_minus, round((wp - wm) / (n * (n + 1) / 2), 6) AS rank_biserial FROM w")
def st_signed_ranks(spark, sf):
    return rounded(stats.signed_ranks(stats.paired(_cells(spark, sf), ["dataset"], "method", "metric", "BUILDING"), "method"), "rank_biserial")


_WILC = f"""{_DIFF}, pat AS (SELECT method, n, wp, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (p >> (i - 1)) & 1 = 1 THEN ranks[i] ELSE 0 END)) AS t FROM w, range(0, 1048576) q(p) WHERE p < 2 ** n),
wx AS (SELECT method, n, any_value(wp) AS statistic, least(1.0, 2 * least(avg(CAST(t <= wp + 1e-9 AS DOUBLE)), avg(CAST(t >= wp - 1e-9 AS DOUBLE)))) AS p_value FROM pat GROUP BY method, n)"""


@query("st_wilcoxon", f"WITH {_WILC} SELECT method, n, statistic, round(p_value, 6) AS p_value FROM wx")
def st_wilcoxon(spark, sf):
    return rounded(stats.wilcoxon(stats.paired(_cells(spark, sf), ["dataset"], "method", "metric", "BUILDING"), "method"), "p_value")


@query("st_holm", f"""WITH {_WILC}, o AS (SELECT method, p_value, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, method) + 1) * p_value) AS raw, p_value AS pv FROM wx)
SELECT method, round(p_value, 6) AS p_value, round(max(raw) OVER (ORDER BY p_value, method ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM o""".replace("max(raw) OVER (ORDER BY p_value, method ROWS UNBOUNDED PRECEDING)", "max(raw) OVER (ORDER BY p_value, method ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def st_holm(spark, sf):
    w = stats.wilcoxon(stats.paired(_cells(spark, sf), ["dataset"], "method", "metric", "BUILDING"), "method")
    return rounded(stats.holm(w.select("method", "p_value")), "p_value", "p_holm")


_BLOCKS = f"{V.RESULTS}, cell AS (SELECT dataset, classifier, method, round(avg(metric), 9) AS metric FROM results GROUP BY ALL)"
_BUNDLE = f"""{_BLOCKS}, r AS (SELECT *, {_RANKED.format('dataset, classifier')} AS r FROM cell), s AS (SELECT method, sum(r) AS s, avg(r) AS mean_rank, count(*) AS n_blocks FROM r GROUP BY 1),
z AS (SELECT count(DISTINCT (dataset, classifier)) AS n, count(DISTINCT method) AS k FROM r), q AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY dataset, classifier, metric)),
f AS (SELECT (12 / (n * k * (k + 1)) * (SELECT sum(s * s) FROM s) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))) AS x, n, k FROM z, q),
d AS (SELECT o.method, o.dataset, o.classifier, b.metric - o.metric AS diff FROM cell o JOIN cell b ON o.dataset = b.dataset AND o.classifier = b.classifier WHERE b.method = 'BUILDING' AND o.method <> 'BUILDING'),
sr AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY method, abs(diff)) - 1) / 2 AS r FROM d WHERE diff <> 0),
w AS (SELECT method, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS wm, list(r) AS ranks FROM sr GROUP BY 1),
pat AS (SELECT method, n, wp, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (p >> (i - 1)) & 1 = 1 THEN ranks[i] ELSE 0 END)) AS t FROM w, range(0, 32768) q(p) WHERE p < 2 ** n),
wx AS (SELECT method, least(1.0, 2 * least(avg(CAST(t <= wp + 1e-9 AS DOUBLE)), avg(CAST(t >= wp - 1e-9 AS DOUBLE)))) AS p_value FROM pat GROUP BY method),
h AS (SELECT *, max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p_value, method) AS i, count(*) OVER () AS m FROM wx)),
u AS (SELECT 'ranks' AS report, method AS name, 'mean_rank' AS measure, mean_rank AS value FROM s UNION ALL SELECT 'ranks', method, 'n_blocks', n_blocks FROM s
UNION ALL SELECT 'friedman', 'all', unnest(['statistic', 'dof', 'p_value', 'n_blocks', 'n_methods']), unnest([x, k - 1, exp(-x / 2) * (1 + x / 2), n, k]) FROM f
UNION ALL SELECT 'critical_difference', 'all', 'cd', 2.728::DOUBLE * sqrt(k * (k + 1) / (6.0::DOUBLE * n)) FROM f
UNION ALL SELECT 'means', method, 'mean', avg(metric) FROM cell GROUP BY method
UNION ALL SELECT 'pairwise', w.method, unnest(['n', 'statistic', 'p_value', 'p_holm', 'rank_biserial']), unnest([n, wp, h.p_value, h.p_holm, (wp - wm) / (n * (n + 1) / 2)]) FROM w JOIN h USING (method))"""


@query("st_bundle", f"WITH {_BUNDLE} SELECT report, name, measure, round(value, 4) AS value FROM u")
def st_bundle(spark, sf):
    """Every statistic of the results, blocks of dataset and classifier."""
    return rounded(stats.bundle(V.results(spark, sf), ["dataset", "classifier"], "method", "metric", "BUILDING"), "value", digits=4)


@query("st_cd", f"WITH {_FRIED} SELECT CAST(k AS INTEGER) AS n_methods, n AS n_blocks, round(2.728::DOUBLE * sqrt(k * (k + 1) / (6.0::DOUBLE * n)), 6) AS cd FROM f")
def st_cd(spark, sf):
    return rounded(stats.critical_difference(stats.mean_ranks(_cells(spark, sf), ["dataset"], "method", "metric")), "cd")


@query("st_summary", f"WITH {V.RESULTS} SELECT dataset, method, count(*) AS n_runs, count(DISTINCT seed) AS n_seed, count(DISTINCT classifier) AS n_classifier, round(avg(metric), 4) AS mean, round(coalesce(stddev_samp(metric), 0), 3) AS sd FROM results GROUP BY ALL")
def st_summary(spark, sf):
    return rounded(rounded(stats.summary(V.results(spark, sf), ["dataset", "method"], "metric", ["seed", "classifier"]), "mean", digits=4), "sd", digits=3)


@query("st_numbered", f"""WITH {V.RESULTS}, s AS (SELECT method, round(avg(metric), 4) AS mean, count(*) AS n_runs FROM results GROUP BY 1) SELECT *, row_number() OVER (ORDER BY mean DESC, n_runs DESC, method) AS place FROM s""")
def st_numbered(spark, sf):
    t = V.results(spark, sf).groupBy("method").agg(F.round(F.avg("metric"), 4).alias("mean"), F.count("*").alias("n_runs"))
    return stats.numbered(t, F.desc_nulls_last("mean"), F.desc_nulls_last("n_runs"), F.asc("method"))


@query("st_wide", f"""WITH {V.RESULTS} SELECT dataset, round(avg(metric) FILTER (method = 'BUILDING'), 4) AS "BUILDING", round(avg(metric) FILTER (method = 'MACHINERY'), 4) AS "MACHINERY" FROM results GROUP BY 1""")
def st_wide(spark, sf):
    return rounded(stats.wide_means(V.results(spark, sf), "dataset", "method", ["BUILDING", "MACHINERY"], "metric"), "BUILDING", "MACHINERY", digits=4)


@query("st_completeness", f"""WITH {V.RESULTS}, g AS (SELECT d.dataset, m.method, s.seed FROM (SELECT DISTINCT dataset FROM results) d, (SELECT DISTINCT method FROM results) m, (SELECT DISTINCT seed FROM results) s),
r AS (SELECT DISTINCT dataset, method, seed FROM results) SELECT g.dataset, g.method, g.seed, r.seed IS NOT NULL AS exists FROM g LEFT JOIN r ON g.dataset = r.dataset AND g.method = r.method AND g.seed = r.seed""")
def st_completeness(spark, sf):
    return stats.completeness(V.results(spark, sf), ["dataset", "method", "seed"])


@query("st_dupratio", "SELECT lang, count(*) AS n, round(1 - count(DISTINCT md5(text)) / count(*), 6) AS duplicate_ratio FROM documents GROUP BY lang")
def st_dupratio(spark, sf):
    return rounded(stats.duplicate_ratio(V.table(spark, sf, "documents"), F.md5("text"), ["lang"]), "duplicate_ratio")


_NUM = ["quantity", "extendedprice", "discount"]
_CD = " UNION ALL ".join(f"SELECT abs((SELECT corr({a}, {b}) FROM items) - (SELECT corr({a}, {b}) FROM candidates)) AS d" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])


@query("st_corrdist", f"WITH {V.ITEMS}, {V.CANDIDATES}, d AS ({_CD}) SELECT round(avg(d), 6) AS correlation_distance FROM d")
def st_corrdist(spark, sf):
    return rounded(stats.correlation_distance(V.items(spark, sf), V.candidates(spark, sf), _NUM), "correlation_distance")


@query("st_quality", f"""WITH {V.ITEMS}, {V.CANDIDATES}, m AS (SELECT min(extendedprice) lo, max(extendedprice) hi FROM items)
SELECT kind, count(*) AS n, round(avg(CAST(extendedprice BETWEEN lo AND hi AS DOUBLE)), 6) AS acceptance, round(1 - count(DISTINCT concat_ws('|', printf('%.6f', quantity), printf('%.6f', extendedprice), printf('%.6f', discount))) / count(*), 6) AS duplicate_ratio FROM candidates, m GROUP BY kind""")
def st_quality(spark, sf):
    """Acceptance and exact repeats of the proposals, by how they were made."""
    from ..operators import transform

    c = transform.with_moments(V.candidates(spark, sf), transform.moments(V.items(spark, sf), ["extendedprice"]))
    ok = F.col("extendedprice").between(F.col("extendedprice__min"), F.col("extendedprice__max"))
    fp = C.fingerprint([("quantity", "double"), ("extendedprice", "double"), ("discount", "double")])
    out = c.groupBy("kind").agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("acceptance"), (1 - F.count_distinct(fp) / F.count("*")).alias("duplicate_ratio"))
    return rounded(out, "acceptance", "duplicate_ratio")


@query("st_fairness", f"""WITH {V.LABELLED}, g AS (SELECT source, quality, avg(CAST(y AS DOUBLE)) AS r FROM labelled GROUP BY ALL), d AS (SELECT source, max(r) - min(r) AS dpd FROM g GROUP BY 1)
SELECT count(*) AS n, round(avg(dpd), 6) AS mean, round(quantile_cont(dpd, 0.5), 6) AS median, round(max(dpd), 6) AS max FROM d""")
def st_fairness(spark, sf):
    d = V.labelled(spark, sf).groupBy("source", "quality").agg(F.avg(F.col("y").cast("double")).alias("r")).groupBy("source").agg((F.max("r") - F.min("r")).alias("dpd"))
    return rounded(d.agg(F.count("*").alias("n"), F.avg("dpd").alias("mean"), F.percentile("dpd", F.lit(0.5)).alias("median"), F.max("dpd").alias("max")), "mean", "median", "max")


@query("st_pending", f"""WITH {V.RESULTS}, g AS (SELECT dataset, method, seed FROM (SELECT DISTINCT dataset FROM results), (SELECT DISTINCT method FROM results), (SELECT DISTINCT seed FROM results))
SELECT dataset, method, seed FROM g WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.dataset = g.dataset AND r.method = g.method AND r.seed = g.seed AND r.metric >= (SELECT avg(metric) FROM results))""")
def st_pending(spark, sf):
    """What a batch has yet to run, where only a metric of the mean or more counts as a success."""
    r = V.results(spark, sf)
    mean = r.agg(F.avg("metric").alias("mean"))
    names = [[x[0] for x in r.select(c).distinct().orderBy(c).collect()] for c in ("dataset", "method", "seed")]  # the names of a grid
    wanted = spark.createDataFrame(experiments.grid(*names), "dataset string, method string, seed int")
    return experiments.pending(wanted, r.crossJoin(F.broadcast(mean)).withColumn("success", F.col("metric") >= F.col("mean")))  # one row


@query("st_shared_seeds", f"WITH {V.RESULTS} SELECT seed FROM results WHERE classifier = 'P' GROUP BY seed HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM results WHERE classifier = 'P')")
def st_shared_seeds(spark, sf):
    return dedup.shared_values(V.results(spark, sf).where("classifier = 'P'"), "method", "seed")
