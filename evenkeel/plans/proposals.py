"""Validation, dedup, selection, anchor and proposer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, models, pairwise, propose, select, transform, validate
from . import views as V
from .profiling import rounded
from .registry import query

N = ["quantity", "extendedprice", "discount"]
IC = f"{V.ITEMS}, {V.CANDIDATES}"
_M = "m AS (SELECT " + ", ".join(f"min({c}) AS {c}_l, max({c}) AS {c}_h, avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in N) + " FROM items)"
_IN = lambda room: " AND ".join(f"{c} BETWEEN {c}_l - {room.format(c)} AND {c}_h + {room.format(c)}" for c in N)
_WIDE = "greatest(({0}_h - {0}_l) * 0.2, 0.5)"
_Z = " AND ".join(f"abs({c} - {c}_m) < 4.5 * {c}_s" for c in N)
_FID = " + ".join(f"1 / (1 + abs(({c} - {c}_m) / {c}_s))" for c in N)


def _ic(spark, sf):
    return V.candidates(spark, sf), V.items(spark, sf)


@query("val_schema", f"""WITH {IC}, {_M} SELECT row_id, concat_ws(', ', CASE WHEN quantity NOT BETWEEN quantity_l AND quantity_h THEN 'quantity: out of range' END, CASE WHEN quantity <> floor(quantity) THEN 'quantity: not integral' END,
  CASE WHEN extendedprice NOT BETWEEN extendedprice_l AND extendedprice_h THEN 'extendedprice: out of range' END, CASE WHEN returnflag NOT IN ('R') THEN 'returnflag: unknown category' END) AS errors FROM candidates, m""")
def val_schema(spark, sf):
    c, t = _ic(spark, sf)
    out = validate.schema_errors(c, t, ["quantity", "extendedprice"], {"returnflag": ["R"]}, integral=["quantity"])
    return out.select("row_id", F.array_join("errors", ", ").alias("errors"))


@query("val_schema_lenient", f"""WITH {IC}, {_M} SELECT kind, count(*) AS n, count(*) FILTER (extendedprice < extendedprice_l - 0.2 * (extendedprice_h - extendedprice_l) OR extendedprice > extendedprice_h + 0.2 * (extendedprice_h - extendedprice_l)) AS bad FROM candidates, m GROUP BY kind""")
def val_schema_lenient(spark, sf):
    c, t = _ic(spark, sf)
    out = validate.schema_errors(c, t, ["extendedprice"], margin=0.2, allow_null=True)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.size("errors") > 0, 1)).alias("bad"))


@query("val_range", f"WITH {IC}, {_M} SELECT row_id, {_IN(_WIDE)} AS in_range FROM candidates, m")
def val_range(spark, sf):
    c, t = _ic(spark, sf)
    return validate.range_gate(c, t, N).select("row_id", "in_range")


@query("val_z", f"WITH {IC}, {_M} SELECT row_id, {_Z} AS z_ok FROM candidates, m")
def val_z(spark, sf):
    c, t = _ic(spark, sf)
    return validate.z_gate(c, t, N).select("row_id", "z_ok")


@query("val_adaptive", f"WITH {IC}, {_M} SELECT row_id, {_IN('0')} AS inside, round(({_FID}) / 3, 6) AS fidelity FROM candidates, m")
def val_adaptive(spark, sf):
    c, t = _ic(spark, sf)
    return rounded(validate.adaptive_gate(c, t, N), "fidelity").select("row_id", "inside", "fidelity")


@query("val_fairness", f"WITH {V.LABELLED} SELECT doc_id, lang IN ('fr', 'de') AND CAST(quality AS VARCHAR) = '0' AS fair FROM labelled")
def val_fairness(spark, sf):
    return validate.fairness_gate(V.labelled(spark, sf), {"lang": ["fr", "de"], "quality": ["0"], "source": []}).select("doc_id", "fair")


@query("val_verdicts", f"""WITH {IC}, {_M} SELECT row_id, {_IN(_WIDE)} AND {_Z} AS valid FROM candidates, m""")
def val_verdicts(spark, sf):
    c, t = _ic(spark, sf)
    return validate.verdicts(validate.z_gate(validate.range_gate(c, t, N), t, N), ["in_range", "z_ok"]).select("row_id", "valid")


@query("val_audited", f"""WITH {IC}, {_M} SELECT row_id, kind, ({_IN('0')}) AND kind IN (0, 1, 2) AS valid, kind IN (0, 1, 2) AS valid_group_only FROM candidates, m""")
def val_audited(spark, sf):
    """Range and group together, and the group alone where the statistical check is switched off."""
    c, t = _ic(spark, sf)
    both = validate.audited(c, t, N, {"kind": ["0", "1", "2"]})
    alone = validate.audited(both.drop("fair", "inside", "fidelity").withColumnRenamed("valid", "both"), t, N, {"kind": ["0", "1", "2"]}, statistical=False)
    return alone.select("row_id", "kind", F.col("both").alias("valid"), F.col("valid").alias("valid_group_only"))


@query("val_counters", f"""WITH {IC}, {_M}, g AS (SELECT {_IN(_WIDE)} AS in_range, {_Z} AS z_ok FROM candidates, m)
SELECT count(*) AS n, count(*) FILTER (NOT in_range) AS fail_in_range, count(*) FILTER (NOT z_ok) AS fail_z_ok, count(*) FILTER (in_range AND z_ok) AS n_valid, round(count(*) FILTER (in_range AND z_ok) / count(*), 6) AS valid_rate FROM g""")
def val_counters(spark, sf):
    c, t = _ic(spark, sf)
    return rounded(validate.counters(validate.z_gate(validate.range_gate(c, t, N), t, N), ["in_range", "z_ok"]), "valid_rate")


def _text(t=""):
    return "concat_ws('|', " + ", ".join(f"printf('%.6f', {t}{c} + 0.0)" for c in N) + ")"


_SEEN = f"""known AS (SELECT DISTINCT {_text()} AS fp FROM items WHERE y = 0), own AS (SELECT row_id, kind, {', '.join(N)}, {_text()} AS fp FROM candidates), first AS (SELECT fp, min(row_id) AS f FROM own GROUP BY fp),
seen AS (SELECT own.*, CASE WHEN k.fp IS NOT NULL THEN 'known' WHEN row_id <> f THEN 'batch' ELSE 'new' END AS seen FROM own JOIN first USING (fp) LEFT JOIN known k ON k.fp = own.fp)"""


@query("dd_exact", f"WITH {IC}, {_SEEN} SELECT row_id, kind, seen FROM seen")
def dd_exact(spark, sf):
    c, t = _ic(spark, sf)
    return dedup.exact(c, t.where("y = 0"), N, "row_id").select("row_id", "kind", "seen")


@query("val_funnel", f"""WITH {IC}, {_SEEN}, {_M}, a AS (SELECT * FROM seen WHERE seen = 'new'), b AS (SELECT a.* FROM a, m WHERE {_IN(_WIDE)}), c AS (SELECT b.* FROM b, m WHERE {_Z}),
x AS (SELECT 0 AS p, 'proposed' AS stage, count(*) AS n FROM candidates UNION ALL SELECT 1, 'new', count(*) FROM a UNION ALL SELECT 2, 'in_range', count(*) FROM b UNION ALL SELECT 3, 'z_ok', count(*) FROM c)
SELECT stage, n, coalesce(lag(n) OVER (ORDER BY p) - n, 0) AS dropped FROM x""")
def val_funnel(spark, sf):
    c, t = _ic(spark, sf)
    own = validate.z_gate(validate.range_gate(dedup.exact(c, t.where("y = 0"), N, "row_id"), t, N), t, N)
    return dedup.funnel_of(own, "proposed", [("new", F.col("seen") == "new"), ("in_range", F.col("in_range")), ("z_ok", F.col("z_ok"))])


def flagship(spark, sf):
    """Proposals that are new, in range and typical, best fidelity first."""
    c, t = _ic(spark, sf)
    new = dedup.keep_new(c, t.where("y = 0"), N, "row_id")
    ok = validate.adaptive_gate(validate.z_gate(validate.range_gate(new, t, N), t, N), t, N).where("in_range AND z_ok AND inside")
    return rounded(ok, "fidelity").orderBy(F.desc("fidelity"), "row_id").limit(100).select("row_id", "kind", "fidelity")


query("flagship", f"""WITH {IC}, {_SEEN}, {_M} SELECT row_id, kind, round(({_FID}) / 3, 6) AS fidelity FROM seen, m WHERE seen = 'new' AND {_IN(_WIDE)} AND {_Z} AND {_IN('0')} ORDER BY fidelity DESC, row_id LIMIT 100""")(flagship)

_SCALE = f"""{IC}, s AS (SELECT avg(quantity) qm, stddev_pop(quantity) qs, avg(extendedprice) em, stddev_pop(extendedprice) es FROM candidates WHERE kind < 4),
cs AS (SELECT row_id AS id, (quantity - qm) / qs AS q, (extendedprice - em) / es AS e FROM candidates, s WHERE kind < 4), ts AS (SELECT row_id AS id, (quantity - qm) / qs AS q, (extendedprice - em) / es AS e FROM items, s WHERE y = 0)"""


def _scaled(spark, sf):
    c, t = _ic(spark, sf)
    c = c.where("kind < 4").select(F.col("row_id").alias("id"), "quantity", "extendedprice")
    t = t.where("y = 0").select(F.col("row_id").alias("id"), "quantity", "extendedprice")
    m = transform.moments(c, ["quantity", "extendedprice"])
    return (transform.zscore(x, ["quantity", "extendedprice"], m) for x in (c, t))


@query("dd_euclid", f"""WITH {_SCALE}, g AS (SELECT *, CAST(floor(q / 0.01) AS BIGINT) AS k FROM ts), h AS (SELECT *, CAST(floor(q / 0.01) AS BIGINT) + d AS k FROM cs, (VALUES (-1), (0), (1)) v(d))
SELECT id FROM cs WHERE id NOT IN (SELECT h.id FROM h JOIN g USING (k) WHERE (h.q - g.q) * (h.q - g.q) + (h.e - g.e) * (h.e - g.e) < 0.0001)""")
def dd_euclid(spark, sf):
    c, t = _scaled(spark, sf)
    return dedup.far_from(c, t, ["quantity", "extendedprice"], 0.01).select("id")


@query("dd_greedy")
def dd_greedy(spark, sf):
    """Keep-first inside the batch; sequential, held against brute force in the tests."""
    c, _ = _scaled(spark, sf)
    return dedup.spread_out(c, ["quantity", "extendedprice"], 0.01).select("id")


@query("dd_antisimilar")
def dd_antisimilar(spark, sf):
    c, t = _scaled(spark, sf)
    return dedup.anti_similar(c, t, ["quantity", "extendedprice"], 0.01).select("id")


def _customers(spark, sf):
    c = V.table(spark, sf, "customer")
    c = transform.with_moments(c, transform.moments(c, ["c_acctbal"]))
    scaled = (F.col("c_acctbal") - F.col("c_acctbal__min")) / (F.col("c_acctbal__max") - F.col("c_acctbal__min"))
    return c.select(F.col("c_custkey").alias("id"), F.array(scaled, F.col("c_nationkey").cast("double")).alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("own"))


@query("dd_gower", """WITH r AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer), a AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'),
d AS (SELECT a.c_custkey AS id, min((abs(a.c_acctbal - b.c_acctbal) / r + CAST(a.c_nationkey <> b.c_nationkey AS INTEGER)) / 2) AS d FROM a, b, r GROUP BY 1)
SELECT id, round(d, 6) AS distance, d < 0.005 AS is_duplicate FROM d""")
def dd_gower(spark, sf):
    c = _customers(spark, sf)
    return rounded(dedup.gower(c.where("own").select("id", "v"), c.where("NOT own").select("id", "v"), 0.005, categories=1), "distance")


@query("dd_gower_raw", """WITH b AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_custkey DESC LIMIT 100), a AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'),
d AS (SELECT a.c_custkey AS id, min((abs(a.c_acctbal - b.c_acctbal) / greatest(abs(a.c_acctbal), abs(b.c_acctbal), 1.0) + CAST(a.c_nationkey <> b.c_nationkey AS INTEGER)) / 2) AS d FROM a, b GROUP BY 1)
SELECT id, round(d, 6) AS distance, d < 0.05 AS is_duplicate FROM d""")
def dd_gower_raw(spark, sf):
    """Gower without known ranges, against the last 100 rows remembered."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("own"))
    last = c.where("NOT own").orderBy(F.desc("id")).limit(100).select("id", "v")
    d = pairwise.nearest(c.where("own").select("id", "v"), last, "gower-raw", categories=1)
    return rounded(d.select("id", "distance", (F.col("distance") < 0.05).alias("is_duplicate")), "distance")


@query("dd_cosine", f"""WITH {V.VECTORS}, d AS (SELECT a.id, max(list_cosine_similarity(a.v, b.v)) AS s FROM vectors a, vectors b WHERE a.y = 1 AND b.y = 0 GROUP BY 1) SELECT id, round(s, 6) AS similarity, s >= 0.3 AS is_duplicate FROM d""")
def dd_cosine(spark, sf):
    t = V.vectors(spark, sf)
    return rounded(dedup.cosine(t.where("y = 1"), t.where("y = 0"), 0.3), "similarity")


def _sides(spark, sf):
    t = V.vectors(spark, sf)
    return t.where("y = 1").select("id", "v"), t.where("y = 0").select("id", "v")


_NEAR = f"""{V.VECTORS}, mn AS (SELECT * FROM vectors WHERE y = 1), mj AS (SELECT * FROM vectors WHERE y = 0), o AS (SELECT a.id, min(list_distance(a.v, b.v)) AS d FROM mn a, mj b GROUP BY 1)"""


@query("sel_weighted", f"""WITH {_NEAR}, s AS (SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0.1 END AS f, CASE WHEN 5 * d > 3 THEN least(1.0, least(1.0, 5 * d / 5) + least(0.2, (5 * d - 3) / 10)) ELSE least(1.0, 5 * d / 5) END AS v FROM o)
SELECT id, round(f * 0.2 + v * 0.4 + 0.4, 6) AS score FROM s ORDER BY round(f * 0.2 + v * 0.4 + 0.4, 9) DESC, id LIMIT 20""")
def sel_weighted(spark, sf):
    a, b = _sides(spark, sf)
    s = pairwise.nearest(a, b).select("id", select.fairness_score([(F.col("id") % 3 == 0, 1)]).alias("fairness"), select.distance_score(5 * F.col("distance")).alias("diversity"), F.lit(1.0).alias("quality"))
    return rounded(select.weighted_top(s, 20, 0.2, 0.4, 0.4), "score").select("id", "score")


@query("sel_pareto", """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part), d AS (SELECT DISTINCT a, b, c FROM p),
f AS (SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))) SELECT p_partkey FROM p JOIN f USING (a, b, c)""")
def sel_pareto(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_name").cast("double").alias("c"))
    return select.pareto(p, ["a", "b", "c"]).select("p_partkey")


@query("sel_universal", f"""WITH {_NEAR}, i AS (SELECT a.id, sum(list_distance(a.v, b.v)) / count(*) AS m FROM mn a, mn b GROUP BY 1), s AS (SELECT i.id, m / max(m) OVER () AS v, d / max(d) OVER () AS w FROM i JOIN o USING (id))
SELECT id, round(v, 6) AS diversity, round(w, 6) AS novelty, round(0.5 * v + 0.5 * w, 6) AS score FROM s ORDER BY round(0.5 * v + 0.5 * w, 9) DESC, id LIMIT 20""")
def sel_universal(spark, sf):
    a, b = _sides(spark, sf)
    return rounded(select.universal_select(a, b, 20), "diversity", "novelty", "score")


@query("sel_divfirst", f"""WITH {_NEAR}, f AS (SELECT mn.id, v, 1 / (1 + abs(v[1])) AS fid, row_number() OVER (ORDER BY round(d, 9) DESC, mn.id) AS r FROM mn JOIN o USING (id)), a AS (SELECT * FROM f WHERE r <= 10), b AS (SELECT * FROM f WHERE r > 10),
s AS (SELECT b.id, any_value(b.fid) AS fid, min(list_distance(a.v, b.v)) AS m FROM a, b GROUP BY 1), t AS (SELECT id, row_number() OVER (ORDER BY round(0.6 * fid + 0.3 * m / mx + 0.1, 9) DESC, id) AS r FROM s, (SELECT max(m) AS mx FROM s))
SELECT id, 1 AS stage FROM a UNION ALL SELECT id, 2 FROM t WHERE r <= 10""")
def sel_divfirst(spark, sf):
    a, b = _sides(spark, sf)
    return select.diversity_first(a.withColumn("fidelity", 1 / (1 + F.abs(F.col("v")[0]))), b, 20)


@query("sel_dpp")
def sel_dpp(spark, sf):
    return select.dpp(_sides(spark, sf)[0], 10)


@query("div_ratios", f"""WITH {V.VECTORS}, t AS (SELECT id, y, v[1] AS a, v[2] AS b, v[3] AS c FROM vectors), s AS (SELECT * FROM t WHERE y = 1),
p AS (SELECT avg(sqrt((x.a - z.a) ** 2 + (x.b - z.b) ** 2 + (x.c - z.c) ** 2)) AS d FROM s x, s z WHERE x.id <> z.id), q AS (SELECT avg(sqrt((x.a - z.a) ** 2 + (x.b - z.b) ** 2 + (x.c - z.c) ** 2)) AS d FROM t x, t z WHERE x.id <> z.id),
g AS (SELECT var_samp(a) va, var_samp(b) vb, var_samp(c) vc, max(a) - min(a) ra, max(b) - min(b) rb, max(c) - min(c) rc FROM s), h AS (SELECT var_samp(a) va, var_samp(b) vb, var_samp(c) vc, max(a) - min(a) ra, max(b) - min(b) rb, max(c) - min(c) rc FROM t)
SELECT round((g.va / h.va + g.vb / h.vb + g.vc / h.vc) / 3, 6) AS variance_ratio, round((g.ra / h.ra + g.rb / h.rb + g.rc / h.rc) / 3, 6) AS coverage_ratio, round(p.d / q.d, 6) AS distance_ratio FROM g, h, p, q""")
def div_ratios(spark, sf):
    t = V.vectors(spark, sf).select("id", "y", *[F.col("v")[i].alias(c) for i, c in enumerate("abc")])
    return rounded(select.diversity_ratios(t.where("y = 1"), t, ["a", "b", "c"]), "variance_ratio", "coverage_ratio", "distance_ratio")


@query("div_summary", """WITH v AS (SELECT (stddev_samp(p_retailprice) / abs(avg(p_retailprice)) + stddev_samp(p_size) / abs(avg(p_size))) / 2 * 100 AS cv FROM part), c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c),
e AS (SELECT -sum(p * ln(p + 1e-10)) / ln(count(*)) * 100 AS e FROM p) SELECT round(cv, 6) AS cv, round(e, 6) AS entropy, round(0.6 * cv + 0.4 * e, 6) AS overall FROM v, e""")
def div_summary(spark, sf):
    return rounded(select.diversity_summary(V.table(spark, sf, "part"), ["p_retailprice", "p_size"], ["p_brand"]), "cv", "entropy", "overall")


@query("div_mean_gower", """WITH r AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer) SELECT round(avg((abs(a.c_acctbal - b.c_acctbal) / r + CAST(a.c_nationkey <> b.c_nationkey AS INTEGER)) / 2), 6) AS mean_distance FROM customer a, customer b, r WHERE a.c_custkey <> b.c_custkey""")
def div_mean_gower(spark, sf):
    return rounded(pairwise.mean_pairwise(_customers(spark, sf).select("id", "v"), "gower", categories=1), "mean_distance")


@query("prof_density", f"""WITH {V.VECTORS}, d AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS r FROM vectors a, vectors b WHERE a.y = 1 AND b.y = 1 AND a.id <> b.id),
k AS (SELECT id, avg(d) AS m, max(d) AS kth FROM d WHERE r <= 10 GROUP BY id), p AS (SELECT quantile_cont(m, 0.8) AS p80 FROM k)
SELECT round(1 / (1 + avg(kth)), 6) AS density, round(avg(CAST(m > p80 AS DOUBLE)), 6) AS sparse_share FROM k, p""")
def prof_density(spark, sf):
    """Density of the minority by its tenth neighbours, and the share of rows in its sparse fifth."""
    a, _ = _sides(spark, sf)
    k = pairwise.neighbours(a, a, 10, exclude_self=True).groupBy("id").agg(F.avg("distance").alias("m"), F.max("distance").alias("kth"))
    p = k.agg(F.percentile("m", F.lit(0.8)).alias("p80"))
    out = k.crossJoin(F.broadcast(p)).agg((1 / (1 + F.avg("kth"))).alias("density"), F.avg((F.col("m") > F.col("p80")).cast("double")).alias("sparse_share"))  # one row
    return rounded(out, "density", "sparse_share")


_ZT = " + ".join(f"abs(({c} - {c}_m) / {c}_s)" for c in N)
_MIN = f"{V.ITEMS}, mi AS (SELECT * FROM items WHERE y = 1), m AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in N) + " FROM mi)"
_UU = "(('0x' || substr(md5({0} || '|{1}'), 1, 8))::BIGINT / 4294967296.0)"


@query("anc_typical", f"""WITH {_MIN}, t AS (SELECT row_id, round(1 / (1 + ({_ZT}) / 3), 9) AS typicality FROM mi, m ORDER BY typicality DESC, row_id LIMIT 24) SELECT row_id, round(typicality, 6) AS typicality FROM t ORDER BY {_UU.format('row_id', 'typical')}, row_id LIMIT 12""")
def anc_typical(spark, sf):
    return rounded(propose.typical(V.items(spark, sf).where("y = 1"), N, 12, "row_id"), "typicality").select("row_id", "typicality")


@query("anc_stratified", f"""WITH {V.ITEMS}, mi AS (SELECT * FROM items WHERE y = 1), e AS (SELECT quantile_cont(extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM mi),
s AS (SELECT row_id, CAST(list_sum(list_transform(e, lambda x: CAST(extendedprice > x AS INTEGER))) AS INTEGER) AS stratum FROM mi, e), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_UU.format('row_id', 'strata')}, row_id) AS r FROM s)
SELECT row_id, stratum FROM r WHERE r <= [1, 1, 6, 1, 1][stratum + 1]""")
def anc_stratified(spark, sf):
    return propose.stratified(V.items(spark, sf).where("y = 1"), "extendedprice", 12, "row_id").select("row_id", "stratum")


@query("anc_terciles", f"""WITH {V.ITEMS}, e AS (SELECT quantile_cont(extendedprice, [0.33, 0.67]) AS e FROM items WHERE y = 1) SELECT CASE WHEN extendedprice <= e[1] THEN 'low' WHEN extendedprice > e[2] THEN 'high' ELSE 'middle' END AS band, count(*) AS n FROM items, e WHERE y = 1 GROUP BY 1""")
def anc_terciles(spark, sf):
    return propose.terciles(V.items(spark, sf).where("y = 1"), "extendedprice").groupBy("band").agg(F.count("*").alias("n"))


_ZD = " + ".join(f"(({c} - {c}_m) / {c}_s) ** 2" for c in N)


@query("anc_bands", f"""WITH {_MIN}, d AS (SELECT row_id, round(sqrt({_ZD}), 9) AS d FROM mi, m), r AS (SELECT *, row_number() OVER (ORDER BY d DESC, row_id) AS r, count(*) OVER () AS n FROM d)
SELECT row_id, round(d, 6) AS distance FROM r WHERE r > floor(0.2 * n) AND r <= floor(0.2 * n) + greatest(24, floor(0.3 * n))""")
def anc_bands(spark, sf):
    return rounded(propose.distance_band(V.items(spark, sf).where("y = 1"), N, 12, "row_id", odd=True), "distance").select("row_id", "distance")


@query("anc_boundary", f"""WITH {V.VECTORS}, d AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS r FROM vectors a, vectors b WHERE a.y = 1 AND b.y = 0),
k AS (SELECT id, round(avg(round(d, 9)), 9) AS distance FROM d WHERE r <= 5 GROUP BY id), t AS (SELECT * FROM k ORDER BY distance, id LIMIT 20) SELECT id, round(distance, 6) AS distance FROM t ORDER BY {_UU.format('id', 'boundary')}, id LIMIT 10""")
def anc_boundary(spark, sf):
    return rounded(propose.boundary(*_sides(spark, sf), 10), "distance")


@query("gen_smote", f"""WITH {V.VECTORS}, mn AS (SELECT * FROM vectors WHERE y = 1), nb AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS place FROM mn a, mn b WHERE a.id <> b.id),
s AS (SELECT id, CAST(i AS INTEGER) AS sample, v, id || '#' || i AS k FROM mn, range(1, 4) r(i)), p AS (SELECT *, CAST(floor({_UU.format('k', 'smote neighbour')} * 5) + 1 AS INTEGER) AS place, {_UU.format('k', 'smote step')} AS u FROM s)
SELECT p.id, sample, neighbour, round(p.v[1] + u * (w.v[1] - p.v[1]), 6) AS v0, round(p.v[64] + u * (w.v[64] - p.v[64]), 6) AS v63 FROM p JOIN nb ON nb.id = p.id AND nb.place = p.place JOIN mn w ON w.id = neighbour""")
def gen_smote(spark, sf):
    a, _ = _sides(spark, sf)
    return propose.smote(a, 3 * a.count()).select("id", "sample", "neighbour", F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[63], 6).alias("v63"))


@query("gen_copula")
def gen_copula(spark, sf):
    return propose.copula(V.items(spark, sf).where("y = 1"), N, 1000)


@query("gen_leaf_resample")
def gen_leaf_resample(spark, sf):
    """Leaves given as bands of quantity."""
    t = V.items(spark, sf).where("y = 1").withColumn("leaf", F.floor(F.col("quantity") / 10).cast("int")).withColumn("g", (F.col("tax") > 0.04).cast("int"))
    return propose.leaf_resample(t.select("leaf", "g", *N), "leaf", N, 500, group="g")


@query("mem_prune")
def mem_prune(spark, sf):
    return propose.prune_redundant(_sides(spark, sf)[0], 20)


def _matched() -> str:
    """Column by column, the rows that are left, as SQL."""
    out, last = [], "SELECT row_id AS id, quantity, extendedprice, discount FROM candidates"
    for i, c in enumerate(N):
        out.append(f"""p{i} AS ({last}), o{i} AS (SELECT p{i}.*, row_number() OVER (ORDER BY abs({c} - {c}_m) / {c}_s DESC, id) AS k, sum({c}) OVER (ORDER BY abs({c} - {c}_m) / {c}_s DESC, id ROWS UNBOUNDED PRECEDING) AS gone,
  sum({c}) OVER () AS total, count(*) OVER () AS n, {c}_m AS mu, {c}_s AS sd FROM p{i}, m),
k{i} AS (SELECT CASE WHEN any_value(abs(total / n - mu) / sd) <= 1 OR any_value(n) <= (SELECT greatest(10, count(*) // 2) FROM candidates) THEN 0
  ELSE min(k) FILTER (abs((total - gone) / nullif(n - k, 0) - mu) / sd <= 1 OR n - k <= (SELECT greatest(10, count(*) // 2) FROM candidates)) END AS last FROM o{i})""")
        last = f"SELECT id, quantity, extendedprice, discount FROM o{i}, k{i} WHERE k > last"
    return f"WITH {IC}, {_M}, " + ", ".join(out) + f" SELECT id FROM ({last})"


@query("mem_match_distribution", _matched())
def mem_match_distribution(spark, sf):
    c, t = _ic(spark, sf)
    return propose.match_distribution(c.select(F.col("row_id").alias("id"), *N), t, N)


@query("mem_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def mem_tail(spark, sf):
    from ..operators import memory

    return memory.tail(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


_LAYERS = f"""{V.VECTORS}, q AS (SELECT id, v FROM vectors WHERE y = 1 UNION ALL SELECT id + 1000000, v FROM vectors WHERE y = 0), mm AS (SELECT id, v FROM vectors WHERE y = 0),
r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY i), b AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM r),
f AS (SELECT DISTINCT list_transform(v, lambda x: printf('%.6f', x)) AS fp FROM mm), h AS (SELECT q.*, f.fp IS NOT NULL AS hit FROM q LEFT JOIN f ON f.fp = list_transform(q.v, lambda x: printf('%.6f', x))),
s AS (SELECT id, hit, list_transform(range(1, len(v) + 1), lambda i: (v[i] - lo[i]) / (hi[i] - lo[i])) AS u FROM h, b), n AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: (v[i] - lo[i]) / (hi[i] - lo[i])) AS u, row_number() OVER (ORDER BY id DESC) AS p FROM mm, b),
d AS (SELECT s.id, any_value(hit) AS hit, max(list_cosine_similarity(s.u, n.u)) AS c, min(CASE WHEN p <= 100 THEN list_avg(list_transform(range(1, 65), lambda i: abs(s.u[i] - n.u[i]))) END) AS g FROM s, n GROUP BY s.id)"""


@query("mem_layers", f"WITH {_LAYERS} SELECT id, CASE WHEN hit THEN 'hash' WHEN c >= 0.95 THEN 'cosine' WHEN g < 0.1 THEN 'gower' ELSE 'new' END AS verdict FROM d")
def mem_layers(spark, sf):
    """All vectors, in all their dimensions, against the remembered majority; the majority's own ones are remembered exactly."""
    from ..operators import memory

    t = V.vectors(spark, sf)
    dims = len(t.select("v").first().v)
    flat = t.select("id", "y", *[F.col("v")[i].alias(f"x{i}") for i in range(dims)])
    known = flat.where("y = 0").drop("y")
    own = flat.where("y = 1").drop("y").unionByName(known.withColumn("id", F.col("id") + 1000000))
    return memory.layers(own, known, [f"x{i}" for i in range(dims)], cosine=0.95, gower=0.1, window=100)


_FEW = """mi AS (SELECT * FROM items WHERE y = 1), n AS (SELECT count(*) AS n FROM mi), c AS (SELECT avg(quantity) AS a, avg(extendedprice) AS b, avg(discount) AS d FROM mi),
g AS (SELECT row_id, row_number() OVER (ORDER BY round(sqrt((quantity - a) ** 2 + (extendedprice - b) ** 2 + (discount - d) ** 2), 9) DESC, row_id) AS p FROM mi, c),
e AS (SELECT row_id FROM g, n WHERE p > floor(0.2 * n) AND p <= floor(0.2 * n) + greatest(floor(0.5 * n) - floor(0.2 * n), 20) ORDER BY {0}, row_id LIMIT 10),
q AS (SELECT quantile_cont(discount, [0.33, 0.67]) AS q FROM mi), t AS (SELECT row_id, CASE WHEN discount <= q[1] THEN 0 WHEN discount > q[2] THEN 2 ELSE 1 END AS band, {1} AS u FROM mi, q),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY u, row_id) AS p FROM t), s AS (SELECT row_id FROM r ORDER BY p > CASE WHEN band = 0 THEN 4 ELSE 3 END, u, row_id LIMIT 10)"""


@query("anc_few_shot", f"WITH {V.ITEMS}, " + _FEW.format(_UU.format("row_id", "edges 1"), _UU.format("row_id", "spread 2")) + " SELECT 1 AS iteration, row_id FROM e UNION ALL SELECT 2, row_id FROM s")
def anc_few_shot(spark, sf):
    """The examples of the mixed strategy's second and third round; the first round's are k-means centres, see ``anc_central``."""
    mi = V.items(spark, sf).where("y = 1")
    rounds = [propose.few_shot(mi, N, 10, "row_id", i).select(F.lit(i).alias("iteration"), "row_id") for i in (1, 2)]
    return rounds[0].unionByName(rounds[1])


@query("div_score", """WITH t AS (SELECT c_custkey AS id, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b, c_mktsegment AS s FROM customer), m AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(b) AS bm, stddev_pop(b) AS bsd FROM t),
z AS (SELECT id, (a - am) / (asd + 1e-8) AS a, (b - bm) / (bsd + 1e-8) AS b FROM t, m), p AS (SELECT avg(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS mean, min(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS least FROM z x, z y WHERE x.id < y.id),
v AS (SELECT (stddev_samp(a) / abs(avg(a)) + stddev_samp(b) / abs(avg(b))) / 2 * 100 AS cv FROM t), f AS (SELECT count(*) / sum(count(*)) OVER () AS f FROM t GROUP BY s), e AS (SELECT -sum(f * ln(f + 1e-10)) / ln(count(*)) * 100 AS e FROM f),
d AS (SELECT (1 - count(*) / sum(n)) * 100 AS d FROM (SELECT count(*) AS n FROM t GROUP BY a, b, s))
SELECT round(cv, 6) AS cv, round(e, 6) AS entropy, round(0.6 * cv + 0.4 * e, 6) AS overall, round(mean, 6) AS mean_distance, round(least, 6) AS min_distance, round(d, 6) AS duplicate_percent FROM v, e, p, d""")
def div_score(spark, sf):
    c = V.table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return rounded(select.diversity_score(c, "c_custkey", ["c_acctbal", "nation"], ["c_mktsegment"]), "cv", "entropy", "overall", "mean_distance", "min_distance", "duplicate_percent")


@query("dd_except", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def dd_except(spark, sf):
    """Customers without a pending order."""
    c, o = V.table(spark, sf, "customer"), V.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return dedup.without(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("mem_report", """SELECT count(*) AS n_rows, count(DISTINCT (o_custkey, o_orderstatus)) AS n_hashes, 100000 AS most, 2 AS n_pruned, round(count(*) / 100000.0, 6) AS utilisation FROM orders""")
def mem_report(spark, sf):
    from ..operators import memory

    return rounded(memory.report(V.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], 100000, 2), "utilisation")


@query("mem_representatives")
def mem_representatives(spark, sf):
    return models.representatives(_sides(spark, sf)[0], 20)


@query("anc_diverse")
def anc_diverse(spark, sf):
    """Anchors of the second round, away from those of the first."""
    a, _ = _sides(spark, sf)
    first = models.diverse(a, 8, 0)
    return models.diverse(a, 8, 1, a.join(first, "id", "left_semi"))
