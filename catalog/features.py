"""Feature, scaling and result-cell queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from catalog.sql import using
from tidemark.functions import scalar as sc
from tidemark.operators import features as fe, order_stats as os_

HITS = [f"hits_{c}" for c in fe.CONSTRUCTS]


@query("log_hits_x7", using("analysis", body="SELECT review_id, " + ", ".join(
    f"round(ln(1 + greatest({h}, 0)), 6) AS {h}" for h in HITS)
    + ", round(ln(1 + greatest(listing_age_days - 200, 0)), 6) AS age FROM analysis"))
def log_hits(spark, sf):
    return I.analysis(spark, sf).select("review_id", *[sc.log1p_floor(F.col(h)).alias(h) for h in HITS],
                                        sc.log1p_floor(F.col("listing_age_days") - 200).alias("age"))


@query("month_cycle_x8", using("focal", body="""
    SELECT review_id, round(sin(2 * pi() * month / 12), 6) + 0.0 AS month_sin,
           round(cos(2 * pi() * month / 12), 6) + 0.0 AS month_cos FROM focal"""))
def month_cycle(spark, sf):
    # Adding zero turns a rounded -0.0 into 0.0 on both sides.
    return I.focal(spark, sf).select(
        "review_id", (F.round(sc.month_sin(F.col("month")), 6) + F.lit(0.0)).alias("month_sin"),
        (F.round(sc.month_cos(F.col("month")), 6) + F.lit(0.0)).alias("month_cos"))


@query("z_scores_x9", using("analysis", body="""
    SELECT a.review_id, round((ln(1 + n_tokens) - s.m) / s.d, 6) AS len_z, round((hits_BI - s.mb) / s.db, 6) AS bi_z
    FROM analysis a CROSS JOIN s""", extra={"s": """
    SELECT avg(ln(1 + n_tokens)) AS m, stddev_pop(ln(1 + n_tokens)) AS d, avg(hits_BI) AS mb,
           stddev_pop(hits_BI) AS db FROM analysis"""}))
def z_scores(spark, sf):
    rows = I.analysis(spark, sf).select("review_id", F.log1p("n_tokens").alias("len"), F.col("hits_BI").alias("bi"))
    return fe.zscore(rows, ["len", "bi"]).select("review_id", "len_z", "bi_z")


@query("train_scaling_x10", using("analysis", body="""
    SELECT a.review_id, round((n_tokens - s.m) / s.d, 6) AS n_tokens, round((hits_ATT - s.ma) / s.da, 6) AS hits_ATT
    FROM analysis a CROSS JOIN s""", extra={"s": """
    SELECT avg(n_tokens) AS m, stddev_pop(n_tokens) AS d, avg(hits_ATT) AS ma, stddev_pop(hits_ATT) AS da
    FROM analysis WHERE year <= 1995"""}))
def train_scaling(spark, sf):
    return fe.standardise(I.analysis(spark, sf).select("review_id", "year", "n_tokens", "hits_ATT"),
                          ["n_tokens", "hits_ATT"], F.col("year") <= 1995).drop("year")


@query("year_dummies_x11", using("focal", body="""
    SELECT review_id, (year = 1996)::INT::DOUBLE AS yr_1996, (year = 1997)::INT::DOUBLE AS yr_1997,
           (year = 1998)::INT::DOUBLE AS yr_1998, (year = 1999)::INT::DOUBLE AS yr_1999 FROM focal"""))
def year_dummies(spark, sf):
    rows, names = fe.dummies(I.focal(spark, sf).select("review_id", "year"), "year", "yr")
    return rows.select("review_id", *names)


@query("time_split_x13_a19", using("focal", body="""
    SELECT CASE WHEN year <= 1995 THEN 'train' WHEN year <= 1996 THEN 'validation' ELSE 'test' END AS split,
           count(*) AS n, round(avg(y_continue), 6) AS base_rate FROM focal GROUP BY 1"""))
def time_split(spark, sf):
    from tidemark.operators.metrics import split_summary
    rows = I.focal(spark, sf).withColumn("split", sc.time_split(F.col("year"), 1995, 1996))
    return split_summary(rows, "split", "y_continue")


@query("city_target_rate_a3", using("focal", body="""
    SELECT f.review_id, round(coalesce((r.s + 50 * p.prior) / (r.n + 50), p.prior), 6) AS city_rate
    FROM focal f CROSS JOIN p LEFT JOIN r ON r.city_id = f.city_id""", extra={
    "p": "SELECT avg(y_continue) AS prior FROM focal WHERE year <= 1995",
    "r": "SELECT city_id, sum(y_continue) AS s, count(*) AS n FROM focal WHERE year <= 1995 GROUP BY city_id"}))
def city_target_rate(spark, sf):
    return fe.target_encode(I.focal(spark, sf), "city_id", "y_continue", F.col("year") <= 1995).select("review_id", "city_rate")


@query("city_means_a4", using("analysis", body="""
    SELECT review_id, round(avg(hits_ATT) OVER (PARTITION BY city_id), 6) AS cm_hits_ATT,
           round(avg(hits_BI) OVER (PARTITION BY city_id), 6) AS cm_hits_BI FROM analysis"""))
def city_means(spark, sf):
    return fe.group_means(I.analysis(spark, sf), "city_id", ["hits_ATT", "hits_BI"]).select(
        "review_id", "cm_hits_ATT", "cm_hits_BI")


_RAW = {"ATT": "ln(1 + hits_ATT)", "SN": "ln(1 + hits_SN)", "PBC": "ln(1 + hits_PBC)", "SAT": "ln(1 + hits_SAT)",
        "BI": "ln(1 + hits_BI)", "SENT": "vader_compound", "log_len": "ln(1 + n_tokens)",
        "log_prior": "ln(1 + listing_prior_reviews)", "log_age": "ln(1 + greatest(listing_age_days, 0))",
        **{f"cm_{c}": f"cm_{c}" for c in fe.CONSTRUCTS}}


@query("design_matrix_m1", using("analysis", body="SELECT b.review_id, " + ", ".join(
    f"round(({e} - s.m_{n}) / s.d_{n}, 6) AS {n}" for n, e in _RAW.items())
    + ", covid::DOUBLE AS covid, (year = 1996)::INT::DOUBLE AS yr_1996 FROM b CROSS JOIN s", extra={
    "b": "SELECT *, " + ", ".join(f"avg(hits_{c}) OVER (PARTITION BY city_id) AS cm_{c}" for c in fe.CONSTRUCTS) + " FROM analysis",
    "s": "SELECT " + ", ".join(f"avg({e}) AS m_{n}, stddev_pop({e}) AS d_{n}" for n, e in _RAW.items()) + " FROM b"}))
def design_matrix(spark, sf):
    rows, names = fe.design_matrix(I.analysis(spark, sf), keep=["review_id"])
    return rows.select("review_id", *[n for n in names if not n.startswith("yr_") or n == "yr_1996"])


@query("feature_matrix_l1", using("analysis", body="""
    SELECT a.review_id, y_continue::BIGINT AS y, """ + ", ".join(f"round(ln(1 + hits_{c}), 6) AS {c}" for c in fe.CONSTRUCTS) + """,
           vader_compound AS SENT, vader_pos, vader_neg, round(ln(1 + n_tokens), 6) AS log_len,
           round(ln(1 + n_exclaim), 6) AS n_exclaim, round(ln(1 + listing_prior_reviews), 6) AS log_prior,
           round(ln(1 + greatest(listing_age_days, 0)), 6) AS log_age, covid::DOUBLE AS covid,
           round(sin(2 * pi() * month / 12), 4) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12), 4) + 0.0 AS month_cos,
           round(coalesce((r.s + 50 * p.prior) / (r.n + 50), p.prior), 6) AS city_rate
    FROM analysis a CROSS JOIN p LEFT JOIN r ON r.city_id = a.city_id""", extra={
    "p": "SELECT avg(y_continue) AS prior FROM analysis WHERE year <= 1995",
    "r": "SELECT city_id, sum(y_continue) AS s, count(*) AS n FROM analysis WHERE year <= 1995 GROUP BY city_id"}))
def feature_matrix(spark, sf):
    rows = fe.feature_matrix(I.analysis(spark, sf), "y_continue", F.col("year") <= 1995, ["review_id"])
    return rows.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("month_sin", "month_cos")})


_CELLS = {"c": """SELECT city_id, round(avg(hits_ATT), 4) AS coef, round(stddev_samp(hits_ATT) / sqrt(count(*)), 4) AS se
                  FROM analysis GROUP BY city_id HAVING count(*) > 1"""}


def _cells(spark, sf):
    se = F.round(F.stddev_samp("hits_ATT") / F.sqrt(F.count(F.lit(1))), 4)
    return (I.analysis(spark, sf).groupBy("city_id").agg(F.round(F.avg("hits_ATT"), 4).alias("coef"), se.alias("se"),
                                                         F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"))


@query("coefficient_cells_x14", using("analysis", body="""
    SELECT city_id::BIGINT AS city_id, printf('%.4f', coef) || CASE WHEN se < .05 THEN '***' WHEN se < .10 THEN '**'
           WHEN se < .15 THEN '*' ELSE '' END || printf(' (%.4f)', se) AS cell FROM c""", extra=_CELLS))
def coefficient_cells(spark, sf):
    """The error, divided by 50, 10 and 3 at its own cuts, stands in for p so that every star level appears."""
    p = (F.when(F.col("se") < .05, F.lit(.0005)).when(F.col("se") < .10, F.lit(.005))
         .when(F.col("se") < .15, F.lit(.04)).otherwise(F.lit(.5)))
    return _cells(spark, sf).select("city_id", sc.coefficient_cell(F.col("coef"), F.col("se"), p).alias("cell"))


@query("parsed_cells_x15", using("analysis", body="""
    SELECT city_id::BIGINT AS city_id, coef, se, CASE WHEN se < .1 THEN '***' ELSE '' END AS stars FROM c""", extra=_CELLS))
def parsed_cells(spark, sf):
    p = F.when(F.col("se") < .1, F.lit(.0001)).otherwise(F.lit(.9))
    cells = _cells(spark, sf).select("city_id", sc.coefficient_cell(F.col("coef"), F.col("se"), p).alias("cell"))
    return cells.select("city_id", *[c.alias(n) for n, c in sc.parse_cell(F.col("cell")).items()])


@query("confidence_bounds_x20", using("analysis", body="""
    SELECT city_id::BIGINT AS city_id, round(100 * (coef - 1.96 * se), 4) AS lo, round(100 * (coef + 1.96 * se), 4) AS hi
    FROM c""", extra=_CELLS), digits=4)
def confidence_bounds(spark, sf):
    lo, hi = sc.bounds(F.col("coef"), F.col("se"), 100.0)
    return _cells(spark, sf).select("city_id", lo.alias("lo"), hi.alias("hi"))


@query("formatted_counts_x18", using("focal", body="""
    SELECT city_id::BIGINT AS city_id, format('{:,}', sum(n_future)::BIGINT) AS later,
           format('{:,}', sum(y_continue)::BIGINT) || ' (' || printf('%.2f', 100.0 * sum(y_continue) / count(*)) || '%)' AS stayed
    FROM focal GROUP BY city_id"""))
def formatted_counts(spark, sf):
    return I.focal(spark, sf).groupBy("city_id").agg(
        F.format_number(F.sum("n_future"), 0).alias("later"),
        sc.count_and_share(F.sum("y_continue"), F.count(F.lit(1))).alias("stayed"))


@query("mediation_labels_x19", using("analysis", body="""
    SELECT city_id::BIGINT AS city_id, CASE WHEN lo * hi > 0 AND p < .05 AND ab * d > 0 THEN 'complementary (partial)'
        WHEN lo * hi > 0 AND p < .05 THEN 'competitive (inconsistent)' WHEN lo * hi > 0 THEN 'indirect-only (full)'
        WHEN p < .05 THEN 'direct-only' ELSE 'no effect' END AS label
    FROM (SELECT city_id, ab, ab - 0.02 AS lo, ab + 0.02 AS hi, d, abs(d) / 4 AS p FROM (
        SELECT city_id, round(avg(hits_ATT) * avg(vader_compound) - 0.15, 4) AS ab, round(avg(hits_SAT) - avg(hits_BI), 4) AS d
        FROM analysis GROUP BY city_id))"""))
def mediation_labels(spark, sf):
    from tidemark.operators.regress import mediation_type
    t = I.analysis(spark, sf).groupBy("city_id").agg(
        F.round(F.avg("hits_ATT") * F.avg("vader_compound") - 0.15, 4).alias("ab"),
        F.round(F.avg("hits_SAT") - F.avg("hits_BI"), 4).alias("d"))
    ab, d = F.col("ab"), F.col("d")
    return t.select("city_id", mediation_type(ab, ab - 0.02, ab + 0.02, d, F.abs(d) / 4).alias("label"))


@query("coerced_fields_s3", using("reviews", body="""
    SELECT id_text, CASE WHEN id_text LIKE '%x' THEN NULL ELSE TRY_CAST(TRY_CAST(id_text AS DOUBLE) AS BIGINT) END AS review_id,
           CASE WHEN date_text LIKE '%-13-%' THEN NULL ELSE date_i END AS date_i FROM (
        SELECT date_i, CASE review_id % 5 WHEN 0 THEN review_id::VARCHAR || 'x' WHEN 1 THEN review_id::VARCHAR || '.0'
               WHEN 2 THEN review_id::VARCHAR || 'e0' ELSE review_id::VARCHAR END AS id_text,
               CASE WHEN review_id % 7 = 0 THEN '1996-13-01'
                    ELSE strftime(DATE '1970-01-01' + CAST(date_i AS INTEGER), '%Y-%m-%d') END AS date_text FROM reviews)"""))
def coerced_fields(spark, sf):
    r = F.col("review_id")
    text = (F.when(r % 5 == 0, F.concat(r, F.lit("x"))).when(r % 5 == 1, F.concat(r, F.lit(".0")))
            .when(r % 5 == 2, F.concat(r, F.lit("e0"))).otherwise(r.cast("string")))
    day = F.when(r % 7 == 0, "1996-13-01").otherwise(F.date_from_unix_date("date_i").cast("string"))
    raw = I.reviews(spark, sf).select(text.alias("id_text"), day.alias("date_text"))
    return raw.select("id_text", sc.to_whole_number(F.col("id_text")).alias("review_id"),
                      sc.to_day(F.col("date_text")).alias("date_i"))


@query("pruned_scan_s5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def pruned_scan(spark, sf):
    from tidemark.sources.tables import read_columns
    return read_columns(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey"]).groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"))


@query("average_ranks_w4", using("analysis", body="""
    SELECT DISTINCT n_tokens, rank() OVER (ORDER BY n_tokens) + (count(*) OVER (PARTITION BY n_tokens) - 1) / 2.0::DOUBLE AS avg_rank
    FROM analysis"""))
def average_ranks(spark, sf):
    return os_.ranked_values(I.analysis(spark, sf), ["n_tokens"]).select(F.col("value").cast("long").alias("n_tokens"), "avg_rank")


@query("quantile_bins_w7", using("analysis", body="""
    SELECT review_id, (v > q[2])::INT::BIGINT + (v > q[3])::INT + (v > q[4])::INT + (v > q[5])::INT AS bin
    FROM (SELECT review_id, n_tokens AS v FROM analysis) CROSS JOIN q""", extra={
    "q": "SELECT quantile_cont(n_tokens, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM analysis"}))
def quantile_bins(spark, sf):
    return os_.quantile_bins(I.analysis(spark, sf), "n_tokens", 5).select("review_id", "bin")


@query("order_values_a7", """
    SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.999]::DOUBLE[]) AS prob,
           unnest(list_transform(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.999]), lambda x: round(x, 6))) AS quantile
    FROM lineitem""")
def order_values(spark, sf):
    """Exact quantiles of a continuous column over every line item."""
    lines = I.table(spark, sf, "lineitem")
    return os_.quantiles(lines, ["l_extendedprice"], [0.01, 0.25, 0.5, 0.75, 0.999]).select(
        "prob", F.round("quantile", 6).alias("quantile"))
