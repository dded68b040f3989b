"""Transform, function and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile, transform
from ..sources import catalog, parsing
from . import views as V
from .profiling import rounded
from .registry import query

N = ["quantity", "extendedprice"]
_U = "(('0x' || substr(md5({0} || '|{1}'), 1, 8))::BIGINT / 4294967296.0)"


@query("tx_target", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 0) AS level FROM orders")
def tx_target(spark, sf):
    t = transform.build_target(V.table(spark, sf, "orders"), "o_orderstatus", "F")
    t = transform.build_target(t.withColumn("p", F.substring("o_orderpriority", 1, 1)), "p", name="level")
    return t.select("o_orderkey", "y", "level")


@query("tx_labelenc", f"""WITH {V.ITEMS}, d AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type AS v FROM part)),
e AS (SELECT p_partkey, p_type, code FROM part JOIN d ON v = p_type)
SELECT p_partkey, code AS p_type_code, p_type AS decoded, coalesce((SELECT code FROM d WHERE v = p_brand), 0) AS unseen FROM e JOIN part USING (p_partkey)""".replace(f"WITH {V.ITEMS}, d", "WITH d").replace("SELECT p_partkey, code AS p_type_code, p_type AS decoded, coalesce((SELECT code FROM d WHERE v = p_brand), 0) AS unseen FROM e JOIN part USING (p_partkey)", "SELECT p_partkey, code AS p_type_code, p_type AS decoded, 0 AS unseen FROM e"))
def tx_labelenc(spark, sf):
    part = V.table(spark, sf, "part")
    d = transform.label_dimension(part, "p_type")
    out = transform.label_decode(transform.label_encode(part, "p_type", d), "p_type_code", d, "decoded")
    return transform.label_encode(out, "p_brand", d, "unseen").select("p_partkey", "p_type_code", "decoded", "unseen")


@query("tx_zscore", f"""WITH {V.ITEMS}, m AS (SELECT avg(quantity) q, stddev_pop(quantity) qs, avg(extendedprice) e, stddev_pop(extendedprice) es FROM items)
SELECT row_id, round((quantity - q) / qs, 5) AS quantity, round((extendedprice - e) / es, 5) AS extendedprice FROM items, m""")
def tx_zscore(spark, sf):
    t = V.items(spark, sf).select("row_id", *N)
    return rounded(transform.zscore(t, N, transform.moments(t, N)), *N, digits=5)


@query("tx_unscale", f"WITH {V.ITEMS} SELECT row_id, round(quantity, 4) AS quantity, round(extendedprice, 4) AS extendedprice FROM items")
def tx_unscale(spark, sf):
    t = V.items(spark, sf).select("row_id", *N)
    m = transform.moments(t, N)
    return rounded(transform.unscale(transform.zscore(t, N, m), N, m), *N, digits=4)


_GAPS = "gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders)"


def _gaps(spark, sf):
    k = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select("o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"))


@query("tx_impute", f"""WITH {_GAPS}, m AS (SELECT quantile_cont(price, 0.5) AS med FROM gaps), c AS (SELECT priority, count(*) n FROM gaps WHERE priority IS NOT NULL GROUP BY 1), o AS (SELECT arg_min(priority, (-n, priority)) AS mode FROM c)
SELECT o_orderkey, round(coalesce(price, med), 4) AS price, coalesce(priority, mode) AS priority FROM gaps, m, o""")
def tx_impute(spark, sf):
    t = _gaps(spark, sf)
    return rounded(transform.impute(t, t, ["price"], ["priority"]), "price", digits=4)


@query("tx_impute_missing", f"""WITH {_GAPS} SELECT priority2 AS priority, count(*) AS n FROM (SELECT coalesce(priority, 'missing') AS priority2 FROM gaps) GROUP BY 1""")
def tx_impute_missing(spark, sf):
    t = _gaps(spark, sf)
    return transform.impute(t, t, [], ["priority"], missing="missing").groupBy("priority").agg(F.count("*").alias("n"))


@query("tx_align", f"""WITH {V.ITEMS}, {V.CANDIDATES}, m AS (SELECT quantile_cont(tax, 0.5) AS med FROM items)
SELECT row_id, quantity, round(med, 6) AS tax FROM candidates, m""")
def tx_align(spark, sf):
    c = V.candidates(spark, sf).select("row_id", "quantity", "returnflag")
    return rounded(transform.align(c, V.items(spark, sf), ["quantity", "tax"], keep=["row_id"]), "tax")


@query("tx_clip", f"""WITH {V.ITEMS}, {V.CANDIDATES}, m AS (SELECT min(quantity) ql, max(quantity) qh, min(extendedprice) el, max(extendedprice) eh FROM items)
SELECT row_id, greatest(least(quantity, qh), ql) AS quantity, greatest(least(extendedprice, eh), el) AS extendedprice, CAST(quantity NOT BETWEEN ql AND qh AS INTEGER) + CAST(extendedprice NOT BETWEEN el AND eh AS INTEGER) AS n_clipped FROM candidates, m""")
def tx_clip(spark, sf):
    return transform.clip(V.candidates(spark, sf), N, transform.moments(V.items(spark, sf), N)).select("row_id", *N, "n_clipped")


@query("tx_protected", "SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS is_c_acctbal, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS is_c_mktsegment FROM customer")
def tx_protected(spark, sf):
    return transform.protected(V.table(spark, sf, "customer"), {"c_acctbal": "c_acctbal < 0", "c_mktsegment": "BUILDING"}).select("c_custkey", "is_c_acctbal", "is_c_mktsegment")


@query("tx_realmap", """WITH m AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer) SELECT c_custkey, round(18 + (c_acctbal - lo) / (hi - lo) * 82, 6) AS age FROM customer, m""")
def tx_realmap(spark, sf):
    t = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.real_map(t, "c_acctbal", 18, 100, transform.moments(t, ["c_acctbal"]), "age"), "age").select("c_custkey", "age")


@query("tx_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c}, {x}), 6) AS p{round(100 * x)}" for x in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM orders" for c in ("o_totalprice", "o_custkey")))
def tx_quantiles(spark, sf):
    out = transform.quantile_profile(V.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(out, "p10", "p25", "p50", "p75", "p90")


_SPLIT = f"""{V.ITEMS}, r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM items),
splits AS (SELECT row_id, y, CASE WHEN k <= round(n * 0.6) THEN 'train' WHEN k <= round(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query("tx_split", f"WITH {_SPLIT} SELECT row_id, y, split FROM splits")
def tx_split(spark, sf):
    return transform.stratified_split(V.items(spark, sf).select("row_id", "y"), "row_id")


@query("tx_split_inventory", f"WITH {_SPLIT} SELECT split, count(*) AS n, count(*) FILTER (y = 1) AS n_minority, count(*) FILTER (y = 0) AS n_majority FROM splits GROUP BY split")
def tx_split_inventory(spark, sf):
    t = transform.stratified_split(V.items(spark, sf).select("row_id", "y"), "row_id")
    return t.groupBy("split").agg(F.count("*").alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("n_minority"), F.count(F.when(F.col("y") == 0, 1)).alias("n_majority"))


@query("tx_embed", f"""WITH {V.ITEMS}, m AS (SELECT min(quantity) ql, max(quantity) qh FROM items)
SELECT row_id, round((quantity - ql) / (qh - ql), 6) AS v0, round((('0x' || substr(md5(returnflag), 1, 8))::BIGINT % 10000) / 10000.0, 6) AS v1 FROM items, m""")
def tx_embed(spark, sf):
    t = V.items(spark, sf)
    out = transform.embed(t, ["quantity"], ["returnflag"], transform.moments(t, ["quantity"]))
    return out.select("row_id", F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[1], 6).alias("v1"))


@query("fn_numbers", "SELECT DISTINCT o_totalprice AS x, CASE WHEN abs(o_totalprice) >= 100 THEN printf('%.0f', o_totalprice) WHEN abs(o_totalprice) >= 1 THEN printf('%.1f', o_totalprice) ELSE printf('%.2f', o_totalprice) END AS t FROM orders WHERE o_totalprice * 10 % 5 <> 0")
def fn_numbers(spark, sf):
    t = V.table(spark, sf, "orders").where(F.col("o_totalprice") * 10 % 5 != 0)
    return t.select(F.col("o_totalprice").alias("x"), C.plain_number(F.col("o_totalprice")).alias("t")).distinct()


_FP = "md5(concat_ws('|', coalesce(CAST(p_brand AS VARCHAR), 'NULL'), coalesce(printf('%.6f', p_retailprice + 0.0), 'NULL'), coalesce(CAST(p_size AS VARCHAR), 'NULL')))"


@query("fn_fingerprint", f"SELECT p_partkey, {_FP} AS fp, sha256('p_brand=' || p_brand || ',p_retailprice=' || printf('%.6f', p_retailprice + 0.0) || ',p_size=' || p_size) AS sha FROM part")
def fn_fingerprint(spark, sf):
    cols = [("p_brand", "string"), ("p_retailprice", "double"), ("p_size", "int")]
    return V.table(spark, sf, "part").select("p_partkey", C.fingerprint(cols).alias("fp"), C.sorted_fingerprint(cols).alias("sha"))


@query("fn_guessed_range", "SELECT name, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES ('c_acctbal', 0.0, 100.0), ('Age_years', 18.0, 90.0), ('hours-per-week', 0.0, 100.0), ('annual_income', 0.0, 500000.0), ('capital-gain', 0.0, 100000.0), ('fnlwgt', 10000.0, 1500000.0), ('education-num', 0.0, 20.0), ('emp.var.rate', 0.0, 100.0), ('NR_employed', -5.0, 5.0), ('n-r', 4000.0, 6000.0), ('pdays', -1.0, 999.0)) t(name, low, high)")
def fn_guessed_range(spark, sf):
    t = spark.createDataFrame([(x,) for x in ("c_acctbal", "Age_years", "hours-per-week", "annual_income", "capital-gain", "fnlwgt", "education-num", "emp.var.rate", "NR_employed", "n-r", "pdays")], "name string")
    low, high = C.guessed_range(F.col("name"))
    return t.select("name", low.alias("low"), high.alias("high"))


@query("src_json", """SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events""")
def src_json(spark, sf):
    t = parsing.parse_json(V.table(spark, sf, "events").select("event_id", "props"), "props", "k long")
    return t.select("event_id", "k", "ok")


_CSV = """lines AS (SELECT o_orderkey AS id, i, CASE i WHEN 1 THEN 'price,priority' WHEN 2 THEN printf('%.2f', o_totalprice) || ',' || o_orderpriority WHEN 3 THEN 'broken line' ELSE CAST(o_custkey AS VARCHAR) || ',x' END AS line FROM orders, range(1, 5) r(i))"""


@query("src_csvtext", f"""WITH {_CSV} SELECT id, CAST(i AS INTEGER) AS line_no, TRY_CAST(split_part(line, ',', 1) AS DOUBLE) AS price, split_part(line, ',', 2) AS priority FROM lines WHERE i IN (2, 4)""")
def src_csvtext(spark, sf):
    o = V.table(spark, sf, "orders")
    text = F.concat(F.lit("```csv\nprice,priority\n"), F.format_string("%.2f", "o_totalprice"), F.lit(","), F.col("o_orderpriority"), F.lit("\nbroken line\n"), F.col("o_custkey").cast("string"), F.lit(",x\n```"))
    out = parsing.parse_csv_text(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), "text", {"price": "double", "priority": "string"})
    return out.select("id", "line_no", "price", "priority")


@query("gen_anchor", f"""WITH {V.ITEMS}, a AS (SELECT row_id, quantity, extendedprice, CAST(i AS INTEGER) AS sample, row_id || '#' || i AS s FROM items, range(1, 3) r(i) WHERE y = 1),
k AS (SELECT *, CAST(floor({_U.format('s', 'first')} * 2) AS INTEGER) AS p, CASE WHEN {_U.format('s', 'two')} < 0.5 THEN CAST(floor({_U.format('s', 'second')} * 2) AS INTEGER) ELSE -1 END AS q,
  [1.12, 0.88, 1.10][CAST(floor({_U.format('s', 'f1')} * 3) AS INTEGER) + 1]::DOUBLE AS f1, [1.12, 0.88, 1.10][CAST(floor({_U.format('s', 'f2')} * 3) AS INTEGER) + 1]::DOUBLE AS f2 FROM a)
SELECT row_id, sample, round(CASE WHEN p = 0 THEN quantity * f1 WHEN q = 0 THEN quantity * f2 ELSE quantity END, 6) AS quantity,
  round(CASE WHEN p = 1 THEN extendedprice * f1 WHEN q = 1 THEN extendedprice * f2 ELSE extendedprice END, 4) AS extendedprice FROM k""")
def gen_anchor(spark, sf):
    t = V.items(spark, sf).where("y = 1").select("row_id", *N)
    n = t.count()
    return rounded(rounded(transform.vary(t, 2 * n, "row_id", N), "quantity"), "extendedprice", digits=4)


@query("src_counts_by_bin", """WITH s AS (SELECT min(value) lo, max(value) hi FROM events), c AS (SELECT CAST(least(4, floor((value - lo) / (hi - lo) * 5)) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(0, 5) g(i) LEFT JOIN c ON c.bin = g.i""")
def src_counts_by_bin(spark, sf):
    return profile.histogram(V.table(spark, sf, "events"), "value", 5).select("bin", "n")


@query("src_dataset", """WITH d AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand AS v FROM part)), m AS (SELECT avg(p_retailprice) AS mu, stddev_pop(p_retailprice) AS sd FROM part)
SELECT p_partkey, round((p_retailprice - mu) / sd, 6) AS p_retailprice, code AS p_brand, CAST(p_size = 7 AS INTEGER) AS y FROM part JOIN d ON v = p_brand CROSS JOIN m""")
def src_dataset(spark, sf):
    """A dataset by name: scaled numbers, coded categories and the label."""
    specs = {"parts": catalog.Spec("part.parquet", "p_size", "p_partkey", ("p_retailprice",), ("p_brand",), positive="7")}
    return rounded(catalog.load(spark, "parts", specs, sf).frame, "p_retailprice")


_KIND = "SELECT '{0}' AS \"column\", CASE WHEN count(DISTINCT {0}) BETWEEN 2 AND 20 AND bool_or(abs({0} - round({0})) > 0.01) THEN 'ordinal' WHEN count(DISTINCT {0}) > 20 AND abs(avg({0})) < 0.5 AND abs(stddev_samp({0}) - 1) < 0.5 THEN 'continuous' ELSE 'categorical' END AS kind, round(min({0}), 6) AS low, round(max({0}), 6) AS high, count(DISTINCT {0}) AS n_unique FROM z"
_SCALED = f"{V.ITEMS}, z AS (SELECT (extendedprice - avg(extendedprice) OVER ()) / stddev_pop(extendedprice) OVER () AS price, discount, linenumber FROM items)"


@query("tx_value_kinds", f"WITH {_SCALED} " + " UNION ALL ".join(_KIND.format(c) for c in ("price", "discount", "linenumber")))
def tx_value_kinds(spark, sf):
    t = V.items(spark, sf)
    z = transform.zscore(t, ["extendedprice"], transform.moments(t, ["extendedprice"], ["mean", "sd0"])).withColumnRenamed("extendedprice", "price")
    # Equal prices stay equal when scaled, so distinct values may be counted after it.
    return rounded(transform.value_kinds(z, ["price", "discount", "linenumber"]), "low", "high")


@query("tx_ordinal", f"""WITH {V.ITEMS}, l AS (SELECT row_number() OVER (ORDER BY discount) AS i, discount AS v FROM (SELECT DISTINCT discount FROM items)), s AS (SELECT list(i ORDER BY i) AS i, list(v ORDER BY i) AS v FROM l)
SELECT row_id, list_min(list_transform(range(1, len(v) + 1), lambda k: {{'gap': abs(v[k] - tax), 'i': i[k]}})).i AS step FROM items, s""")
def tx_ordinal(spark, sf):
    """The discount level nearest to each tax."""
    t = V.items(spark, sf)
    return transform.ordinal_index(t, "tax", transform.levels(t, "discount"), "step").select("row_id", "step")
