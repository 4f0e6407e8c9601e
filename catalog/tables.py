"""Descriptive tables, set operations and result-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.inputs import scratch
from catalog.registry import query
from catalog.sql import text_literal, using
from tidemark.functions import lexicon as lx
from tidemark.operators import describe as de, regress as rg
from tidemark.operators.order_stats import hash_sample, running_centred
from tidemark.sources import raw_reviews as rr, tables as tb
from tidemark.streaming import jobs


_DESC = " UNION ALL ".join(
    f"SELECT {text_literal(label)} AS variable, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, "
    f"round(min({c})::DOUBLE, 3) AS min, round(quantile_cont({c}, 0.25), 3)::DOUBLE AS p25, "
    f"round(quantile_cont({c}, 0.5), 3)::DOUBLE AS median, round(quantile_cont({c}, 0.75), 3)::DOUBLE AS p75, "
    f"round(max({c})::DOUBLE, 2) AS max FROM analysis" for c, label in de.DESCRIBED.items())


@query("descriptives_a7", using("analysis", body=_DESC))
def descriptives(spark, sf):
    return de.descriptives(I.analysis(spark, sf))


_NAMES = list(de.CORRELATED.items())
_RANKED = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {n}" for c, n in _NAMES) + " FROM analysis"


@query("spearman_a8", using("analysis", extra={"r": _RANKED}, body=" UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, round(corr({a}, {b}), 3) + 0.0 AS rho FROM r" for _, a in _NAMES for _, b in _NAMES)))
def spearman(spark, sf):
    return de.spearman(I.analysis(spark, sf)).withColumn("rho", F.col("rho") + F.lit(0.0))


_N = "(SELECT count(*) FROM analysis)"
_FUNNEL = [
    ("'Raw reviews in the ' || (SELECT count(DISTINCT city_id) FROM reviews) || ' city corpora'", "format('{:,}', (SELECT count(*) FROM reviews))"),
    ("'Cities / destinations'", "format('{:,}', (SELECT count(DISTINCT city_id) FROM reviews))"),
    ("'Calendar coverage'", "(SELECT (DATE '1970-01-01' + CAST(min(date_i) AS INTEGER))::VARCHAR || ' to ' || (DATE '1970-01-01' + CAST(max(date_i) AS INTEGER))::VARCHAR FROM reviews)"),
    ("'Unique reviewers (estimated from the hash sample)'", "format('{:,}', (SELECT count(DISTINCT reviewer_id) FROM reviews))"),
    ("'Reviewers drawn into the sample (deterministic hash)'", "format('{:,}', (SELECT count(DISTINCT reviewer_id) FROM reviews))"),
    ("'Reviews written by sampled reviewers'", "format('{:,}', (SELECT count(*) FROM reviews))"),
    ("'Focal (first) reviews with a fully observable window'", "format('{:,}', (SELECT count(*) FROM focal))"),
    ("'Retained after English-language and minimum-length screening'", f"format('{{:,}}', {_N})"),
    ("'Analytic sample - cities represented'", "format('{:,}', (SELECT count(DISTINCT city) FROM analysis))"),
    ("'Analytic sample - period'", "(SELECT min(date)::VARCHAR || ' to ' || max(date)::VARCHAR FROM analysis)"),
] + [(f"'{label}'", f"(SELECT format('{{:,}}', {e}::BIGINT) || ' (' || printf('%.2f', 100.0 * {e} / count(*)) || '%)' FROM analysis)")
     for label, e in (("Behaviour 1: returned to the same listing (Y1)", "sum(y_revisit)"),
                      ("Behaviour 2: continued on the platform (Y2)", "sum(y_continue)"),
                      ("Pre-COVID-19 focal reviews", "count(*) FILTER (WHERE covid = 0)"),
                      ("During/after COVID-19 focal reviews", "count(*) FILTER (WHERE covid = 1)"))]


@query("corpus_funnel_a9", using("analysis", "reviews", body=" UNION ALL ".join(
    f"SELECT {a} AS step, {v} AS value" for a, v in _FUNNEL)))
def corpus_funnel(spark, sf):
    from tidemark.operators.cohort import panel_summary
    reviews, focal = I.reviews(spark, sf), I.focal(spark, sf)
    panel = panel_summary(reviews, focal, I.VIEW_RULE).select("total_sampled_reviews", "sampled_reviewers", "eligible_focal")
    return de.corpus_table(de.city_stats(reviews), panel, I.analysis(spark, sf), scale=1)


@query("lexicon_table_a10", using("analysis", body=" UNION ALL ".join(
    f"SELECT {text_literal(lx.CONSTRUCT_LABELS[c])} AS construct, {len(p)}::BIGINT AS patterns, "
    f"format('{{:,}}', sum(pres_{c})::BIGINT) || ' (' || printf('%.1f', 100.0 * sum(pres_{c}) / count(*)) || '%)' AS reviews_with_term, "
    f"round(avg(hits_{c}), 3) AS mean_hits, {text_literal('; '.join(x.replace('(?:', '(') for x in p[:8]))} AS examples FROM analysis"
    for c, p in lx.PATTERNS.items())))
def lexicon_table(spark, sf):
    return de.lexicon_table(I.analysis(spark, sf))


@query("largest_city_coverage_a11", using("analysis", body="""
    SELECT city, count(*) AS n, round(100 * avg(y_revisit), 2) AS y1, round(100 * avg(y_continue), 1) AS y2
    FROM analysis GROUP BY city ORDER BY n DESC, city LIMIT 10"""))
def largest_city_coverage(spark, sf):
    """The ten largest cities are the report."""
    return de.city_coverage(I.analysis(spark, sf), 10)


@query("year_series_a12", using("focal", body="""
    SELECT year, count(*) AS n, round(avg(y_revisit), 6) AS y1, round(avg(y_continue), 6) AS y2 FROM focal GROUP BY year"""))
def year_series(spark, sf):
    return de.year_series(I.focal(spark, sf))


@query("construct_prevalence_a13", using("analysis", body=" UNION ALL ".join(
    f"SELECT '{c}' AS construct, round(100 * avg(pres_{c}), 6) AS prevalence_pct FROM analysis" for c in lx.PATTERNS)))
def construct_prevalence(spark, sf):
    return de.prevalence(I.analysis(spark, sf))


@query("histogram_a17", using("analysis", body="""
    SELECT least(floor((n_tokens - lo) / ((hi - lo) / 60.0::DOUBLE)), 59)::BIGINT AS bin,
           round(lo + least(floor((n_tokens - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) * ((hi - lo) / 60.0::DOUBLE), 6) AS left_edge,
           count(*) AS n, round(any_value(m), 6) AS mean
    FROM analysis CROSS JOIN (SELECT min(n_tokens) AS lo, max(n_tokens) AS hi, avg(n_tokens) AS m FROM analysis) GROUP BY 1, 2"""))
def histogram(spark, sf):
    return de.histogram(I.analysis(spark, sf), "n_tokens")


@query("length_strata_a18", using("analysis", body="""
    SELECT CASE WHEN n_tokens < 40 THEN '15-40' WHEN n_tokens < 70 THEN '40-70' WHEN n_tokens < 120 THEN '70-120'
           ELSE '120+' END AS stratum, count(*) AS n, round(regr_slope(hits_BI, hits_ATT), 6) AS slope_hits_ATT,
           round(regr_slope(hits_BI, hits_SAT), 6) AS slope_hits_SAT FROM analysis GROUP BY 1"""))
def length_strata(spark, sf):
    rows = I.analysis(spark, sf).withColumn("stratum", rg.length_stratum(F.col("n_tokens")))
    return rg.simple_slopes(rows, "hits_BI", ["hits_ATT", "hits_SAT"], "stratum")


@query("cities_with_both_outcomes_a5", using("analysis", body="""
    SELECT review_id, city_id::BIGINT AS city_id FROM analysis WHERE city_id IN (
        SELECT city_id FROM analysis GROUP BY city_id HAVING count(DISTINCT y_revisit) >= 2)"""))
def cities_with_both_outcomes(spark, sf):
    return rg.vary_within(I.analysis(spark, sf), "city_id", "y_revisit").select("review_id", "city_id")


@query("cities_with_positives_a6", using("analysis", body="""
    SELECT review_id, city_id::BIGINT AS city_id FROM analysis WHERE city_id IN (
        SELECT city_id FROM analysis GROUP BY city_id HAVING sum(y_revisit) >= 2)"""))
def cities_with_positives(spark, sf):
    return rg.at_least_positives(I.analysis(spark, sf), "city_id", "y_revisit", 2).select("review_id", "city_id")


@query("fit_sample_a20", using("analysis", body="""
    SELECT count(*) AS n, count(DISTINCT city_id) AS cities, round(avg(y_revisit), 5) AS base_rate FROM analysis
    WHERE city_id IN (SELECT city_id FROM analysis GROUP BY city_id HAVING count(DISTINCT y_revisit) >= 2)"""), digits=5)
def fit_sample(spark, sf):
    return rg.vary_within(I.analysis(spark, sf), "city_id", "y_revisit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("city_id").alias("cities"), F.avg("y_revisit").alias("base_rate"))


@query("replaced_slice_u2", using("focal", body="""
    SELECT year, count(*) AS n, 'old' AS run FROM focal WHERE year <> 1996 GROUP BY year
    UNION ALL SELECT year, sum(n_future)::BIGINT AS n, 'new' AS run FROM focal WHERE year = 1996 GROUP BY year"""))
def replaced_slice(spark, sf):
    f = I.focal(spark, sf)
    old = f.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.lit("old").alias("run"))
    new = f.filter(F.col("year") == 1996).groupBy("year").agg(F.sum("n_future").alias("n"), F.lit("new").alias("run"))
    return de.replace_slice(old, F.col("year") == 1996, new)


def _rates(f, outcome):
    return f.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(outcome), 4).alias("rate"))


@query("side_by_side_j7", using("focal", body="""
    SELECT year, count(*) AS n_revisit, round(avg(y_revisit), 4) AS rate_revisit, count(*) AS n_continue,
           round(avg(y_continue), 4) AS rate_continue FROM focal GROUP BY year"""), digits=4)
def side_by_side(spark, sf):
    f = I.focal(spark, sf)
    return de.side_by_side(_rates(f, "y_revisit"), _rates(f, "y_continue"), "year", ("revisit", "continue"))


@query("run_comparison_j8", using("analysis", body="""
    SELECT city, printf('%.4f', avg(y_continue)) AS base, coalesce(printf('%.4f', avg(y_continue) FILTER (WHERE year = 1996)), '') AS r1,
           coalesce(printf('%.4f', avg(y_continue) FILTER (WHERE year = 1997)), '') AS r2
    FROM analysis WHERE city IN ('NATION_1', 'NATION_5', 'NATION_9', 'NATION_14', 'NATION_20') GROUP BY city"""))
def run_comparison(spark, sf):
    def cells(t):
        return t.groupBy("city").agg(F.format_string("%.4f", F.avg("y_continue")).alias("cell"))
    a = I.analysis(spark, sf)
    runs = {"base": cells(a), "r1": cells(a.filter(F.col("year") == 1996)), "r2": cells(a.filter(F.col("year") == 1997))}
    return de.compare_runs(runs, "city", "cell", ["NATION_1", "NATION_5", "NATION_9", "NATION_14", "NATION_20"])


@query("reconciled_numbers_j9", using("analysis", body="""
    SELECT city, printed, round(source, 6) AS source, CASE WHEN source IS NULL THEN 'missing_source' WHEN printed IS NULL THEN 'missing_printed'
           WHEN printed::DOUBLE = source THEN 'match' WHEN abs(printed::DOUBLE - source) <= 0.0005 + 1e-9 THEN 'rounding'
           ELSE 'mismatch' END AS status
    FROM (SELECT city, CASE WHEN min(city_id) % 4 = 1 THEN printf('%.3f', avg(hits_ATT) + 0.01) ELSE printf('%.3f', avg(hits_ATT)) END AS printed
          FROM analysis WHERE city_id % 4 <> 3 GROUP BY city) p
    FULL JOIN (SELECT city, avg(hits_ATT) AS source FROM analysis WHERE city_id % 5 <> 4 GROUP BY city) s USING (city)"""))
def reconciled_numbers(spark, sf):
    """Printed values of some cities are shifted and others are missing on one side, so that every status appears."""
    a = I.analysis(spark, sf)
    by = a.groupBy("city").agg(F.avg("hits_ATT").alias("value"), F.min("city_id").alias("c"))
    shown = F.format_string("%.3f", F.when(F.col("c") % 4 == 1, F.col("value") + 0.01).otherwise(F.col("value")))
    printed = by.filter(F.col("c") % 4 != 3).select("city", shown.alias("value"))
    return de.reconcile(printed, by.filter(F.col("c") % 5 != 4).select("city", "value"), "city", "value")


@query("effort_grid_j10", using("analysis", body="""
    SELECT s AS step, sum(CASE WHEN hits_BI + s / 20.0::DOUBLE * greatest(6 - hits_BI, 0) >= 3 THEN 1 ELSE 0 END)::BIGINT AS reached
    FROM analysis CROSS JOIN range(1, 21) r(s) GROUP BY s"""))
def effort_grid(spark, sf):
    rows = I.analysis(spark, sf).select("hits_BI").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(20))))
    value = F.col("hits_BI") + F.col("step") / 20.0 * F.greatest(6 - F.col("hits_BI"), F.lit(0))
    return rows.groupBy("step").agg(F.count_if(value >= 3).alias("reached"))


@query("centred_running_sum_w6", using("focal", body="""
    SELECT year, round(t - avg(t) OVER (), 6) AS running FROM (
        SELECT year, sum(rate) OVER (ORDER BY year) AS t FROM (SELECT year, avg(y_continue) AS rate FROM focal GROUP BY year))"""))
def centred_running_sum(spark, sf):
    rates = I.focal(spark, sf).groupBy("year").agg(F.avg("y_continue").alias("rate")).withColumn("series", F.lit(1))
    return running_centred(rates, ["series"], "year", "rate", "running").select("year", "running")


@query("zstd_round_trip_s6", using("focal", body="SELECT city_id::BIGINT AS city_id, count(*) AS n FROM focal GROUP BY city_id"))
def zstd_round_trip(spark, sf):
    path = scratch(spark)
    tb.write_table(I.focal(spark, sf), path, by=["city_id"])
    return spark.read.parquet(path).groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))


@query("report_round_trip_s7", using("focal", body="""
    SELECT n_name AS city, count(*)::VARCHAR AS n FROM focal JOIN nation ON n_nationkey = city_id GROUP BY n_name"""))
def report_round_trip(spark, sf):
    path = scratch(spark)
    tb.write_report(de.city_coverage(I.focal(spark, sf).join(F.broadcast(I.city_names(spark, sf)), "city_id")), path)
    return spark.read.option("header", True).csv(path).select("city", "n")


@query("ledger_s10", using("focal", body="SELECT year, count(*) AS n FROM focal GROUP BY year"))
def ledger(spark, sf):
    """Two runs over overlapping work: the second adds only what the first left."""
    book = tb.Ledger(spark, scratch(spark), ["year"])
    counts = I.focal(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    book.append(counts.filter(F.col("year") <= 1996))
    book.append(counts)
    return book.table()


def _raw_files(spark, sf, id_text=None) -> str:
    """The reviews with their texts as gzip CSV files, dates and ids as text. Every review carries a whole text, so the files outgrow the tables."""
    docs = I.aug_documents(spark, sf)
    n = docs.count()
    rows = I.reviews(spark, sf).withColumn("doc_id", F.col("review_id") % F.lit(n)).join(docs, "doc_id").select(
        "listing_id", (F.col("review_id") if id_text is None else id_text).alias("id"), F.date_from_unix_date("date_i").alias("date"), "reviewer_id",
        F.lit("x").alias("reviewer_name"), F.col("text").alias("comments"))
    path = scratch(spark)
    (rows.write.option("header", True).option("escape", '"').option("compression", "gzip").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("csv_metadata_s1_s2_s4", using("reviews", body="SELECT review_id, listing_id, reviewer_id, date_i FROM reviews"))
def csv_metadata(spark, sf):
    """Written as CSV, read back by column name, coerced, and stored per file; the second call adds nothing."""
    folder, target = _raw_files(spark, sf), scratch(spark)
    rr.ingest(spark, folder, target)
    return rr.ingest(spark, folder, target).select("review_id", "listing_id", "reviewer_id", "date_i")


@query("csv_texts_s1", using("reviews", "aug", body="""
    SELECT review_id, md5(text) AS digest FROM reviews JOIN aug ON doc_id = review_id % (SELECT count(*) FROM documents)"""))
def csv_texts(spark, sf):
    """Texts with line breaks, quotes and commas survive the round trip."""
    cities = rr.registry(spark, _raw_files(spark, sf))
    paths = [r["path"] for r in cities.select("path").collect()]
    blocks = rr.survey(spark, paths)
    texts = rr.texts(rr.with_city(rr.scan(spark, rr.layouts(spark, paths, blocks=blocks), blocks=blocks), cities))
    return texts.select("review_id", F.md5(F.col("comments").cast("binary")).alias("digest"))


@query("ingest_rejects_s3_s4", using("reviews", body="""
    SELECT count(*)::BIGINT AS n_read, count(*) FILTER (WHERE review_id % 10 = 0)::BIGINT AS n_dropped, 0::BIGINT AS n_refused FROM reviews"""))
def ingest_rejects(spark, sf):
    """Every tenth id is no number; counts come from the tables that the ingest leaves beside its rows."""
    odd_id = F.concat(F.when(F.col("review_id") % 10 == 0, F.lit("x")).otherwise(F.lit("")), F.col("review_id"))
    folder, target = _raw_files(spark, sf, odd_id), scratch(spark)
    rr.ingest(spark, folder, target)
    refused = spark.read.parquet(f"{target}.refused").agg(F.count(F.lit(1)).alias("n_refused"))
    counts = spark.read.parquet(f"{target}.rejects").agg(F.sum("n_read").alias("n_read"), F.sum("n_dropped").alias("n_dropped"))
    return counts.crossJoin(refused)                            # one row each


@query("streamed_ingest_st1", using("reviews", body="SELECT review_id, listing_id, reviewer_id, date_i FROM reviews"))
def streamed_ingest(spark, sf):
    """A stream over the raw files; the second one sees all of them again and adds nothing."""
    folder, target = _raw_files(spark, sf), scratch(spark)
    for _ in range(2):
        jobs.ingest_new_files(spark, folder, target, scratch(spark)).awaitTermination()
    return spark.read.parquet(target).select("review_id", "listing_id", "reviewer_id", "date_i")
