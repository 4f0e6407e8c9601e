"""Ranking metrics, thresholds, curves, calibration and agreement, from a fixed score of every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from catalog.sql import using
from tidemark.operators import metrics as mt

# Score: whole numbers over 400, so ties are the same numbers on both sides.
_SCORE = "least(hits_ATT * 20 + hits_BI * 30 + n_exclaim * 7 + n_tokens % 97 + month, 399) / 400.0::DOUBLE"
_SC = {"sc": f"""SELECT review_id, city_id, y_continue AS y, {_SCORE} AS score,
                 CASE WHEN year <= 1995 THEN 'validation' ELSE 'test' END AS split FROM analysis"""}
_BY = {**_SC, "d": "SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM sc GROUP BY score",
       "c": """SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d"""}


def _scored(spark, sf):
    points = (F.col("hits_ATT") * 20 + F.col("hits_BI") * 30 + F.col("n_exclaim") * 7 + F.col("n_tokens") % 97 + F.col("month"))
    return I.analysis(spark, sf).select(
        "review_id", "city_id", F.col("y_continue").alias("y"), (F.least(points, F.lit(399)) / 400.0).alias("score"),
        F.when(F.col("year") <= 1995, "validation").otherwise("test").alias("split"))


def _table(spark, sf):
    return mt.score_table(_scored(spark, sf), "score", "y")


@query("roc_auc_e1", using("analysis", extra=_SC, body="""
    SELECT round((sum(r) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM (
        SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
               count(*) FILTER (WHERE y = 1) OVER () AS n1, count(*) FILTER (WHERE y = 0) OVER () AS n0 FROM sc)
    GROUP BY n1, n0"""))
def roc_auc(spark, sf):
    return mt.ranking_metrics(_table(spark, sf)).select("auc")


@query("average_precision_e2", using("analysis", extra=_BY, body="""
    SELECT round(sum(pos / P::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS average_precision FROM c"""))
def average_precision(spark, sf):
    return mt.ranking_metrics(_table(spark, sf)).select("average_precision")


@query("brier_e3", using("analysis", extra=_SC, body="SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM sc"))
def brier(spark, sf):
    return mt.ranking_metrics(_table(spark, sf)).select("brier")


_PROBS = "[" + ", ".join(f"{p!r}::DOUBLE" for p in mt.THRESHOLD_PROBS) + "]"
_CUTS = {"q": f"SELECT split, quantile_cont(score, {_PROBS}) AS q FROM sc GROUP BY split",
         "t": "SELECT split, unnest(q) AS threshold, generate_subscripts(q, 1) - 1 AS ord FROM q",
         "f": """SELECT t.split, t.ord, t.threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp,
                        count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
                        count(*) FILTER (WHERE score < threshold AND y = 1) AS fn
                 FROM t JOIN sc ON sc.split = t.split GROUP BY ALL""",
         "g": "SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f"}


@query("threshold_search_e4", using("analysis", extra={**_SC, **_CUTS}, body="""
    SELECT split, ord, round(threshold, 6) AS threshold, tp, fp, fn, round(f1, 6) AS f1 FROM g"""))
def threshold_search(spark, sf):
    return mt.threshold_table(mt.score_table(_scored(spark, sf), "score", "y", ["split"]), ["split"])


@query("best_threshold_e4", using("analysis", extra={**_SC, **_CUTS}, body="""
    SELECT split, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM g
    QUALIFY row_number() OVER (PARTITION BY split ORDER BY f1 DESC, ord) = 1"""))
def best_threshold(spark, sf):
    return mt.best_threshold(mt.score_table(_scored(spark, sf), "score", "y", ["split"]), ["split"])


def _auc(split: str) -> str:
    return f"""(SELECT round((sum(r) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 4) FROM (
        SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
               count(*) FILTER (WHERE y = 1) OVER () AS n1, count(*) FILTER (WHERE y = 0) OVER () AS n0
        FROM sc WHERE split = '{split}') GROUP BY n1, n0)"""


def _ap(split: str) -> str:
    return f"""(SELECT round(sum(pos / P::DOUBLE * (tp / (tp + fp)::DOUBLE)), 5) FROM (
        SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS P
        FROM (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
              FROM sc WHERE split = '{split}' GROUP BY score)))"""


@query("evaluation_record_e5", using("analysis", extra={**_SC, **_CUTS}, body=f"""
    SELECT 'given' AS model, '' AS config, {_auc('validation')} AS val_auc, {_auc('test')} AS test_auc,
           {_ap('validation')} AS val_pr_auc, {_ap('test')} AS test_pr_auc,
           (SELECT round(avg((score - y) * (score - y)), 6) FROM sc WHERE split = 'test') AS test_brier,
           (SELECT round(2.0::DOUBLE * count(*) FILTER (WHERE score >= th AND y = 1)
                   / (count(*) FILTER (WHERE score >= th) + count(*) FILTER (WHERE y = 1)), 4) FROM sc CROSS JOIN (
                SELECT threshold AS th FROM g WHERE split = 'validation' ORDER BY f1 DESC, ord LIMIT 1)
            WHERE split = 'test') AS test_f1"""))
def evaluation_record(spark, sf):
    return mt.evaluate(_scored(spark, sf).withColumns({"model": F.lit("given"), "config": F.lit("")}))


@query("roc_points_e6", using("analysis", extra=_BY, body="""
    SELECT score, round(fp / N::DOUBLE, 6) AS fpr, round(tp / P::DOUBLE, 6) AS tpr FROM c"""))
def roc_points(spark, sf):
    return mt.roc_points(_table(spark, sf))


@query("pr_points_e7", using("analysis", extra=_BY, body="""
    SELECT score, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / P::DOUBLE, 6) AS recall FROM c"""))
def pr_points(spark, sf):
    return mt.pr_points(_table(spark, sf))


@query("calibration_deciles_e8", using("analysis", extra={
    **_SC, "e": "SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM sc"},
    body="""SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed FROM (
        SELECT score, y, len(list_filter(q[2:len(q) - 1], lambda x: score > x)) AS bin FROM sc CROSS JOIN e) GROUP BY bin"""))
def calibration_deciles(spark, sf):
    return mt.calibration(_scored(spark, sf), "score", "y")


_HUMAN = {"h": """SELECT 'dictionary' AS instrument, hits_BI::DOUBLE AS score, pres_BI AS flag, l.quality AS human
                  FROM feat JOIN labels l ON l.doc_id = feat.doc_id
                  UNION ALL SELECT 'sentiment', vader_compound, CASE WHEN vader_compound > 0.5 THEN 1 ELSE 0 END, l.quality
                  FROM feat JOIN labels l ON l.doc_id = feat.doc_id"""}


@query("instrument_agreement_e9", using("feat", extra=_HUMAN, body="""
    SELECT instrument, round((sum(r) FILTER (WHERE human = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc,
           round(sum(flag * human) / sum(flag)::DOUBLE, 6) AS prec, round(sum(flag * human) / sum(human)::DOUBLE, 6) AS rec,
           round(2.0::DOUBLE * sum(flag * human) / (sum(flag) + sum(human)), 6) AS f1,
           round(avg(flag), 6) AS inst_prev, round(avg(human), 6) AS human_prev
    FROM (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY score)
                    + (count(*) OVER (PARTITION BY instrument, score) - 1) / 2.0::DOUBLE AS r,
                 count(*) FILTER (WHERE human = 1) OVER (PARTITION BY instrument) AS n1,
                 count(*) FILTER (WHERE human = 0) OVER (PARTITION BY instrument) AS n0 FROM h)
    GROUP BY instrument, n1, n0"""))
def instrument_agreement(spark, sf):
    both = I.features(spark, sf).join(I.table(spark, sf, "labels"), "doc_id")
    given = (("dictionary", F.col("hits_BI").cast("double"), F.col("pres_BI")),
             ("sentiment", F.col("vader_compound"), (F.col("vader_compound") > 0.5).cast("int")))
    each = [F.struct(F.lit(n).alias("instrument"), score.alias("score"), flag.alias("flag")) for n, score, flag in given]
    rows = both.select(F.col("quality").alias("human"), F.explode(F.array(*each)).alias("i")).select("human", "i.*")
    return mt.instrument_agreement(rows.persist(), "instrument", "score", "flag", "human")


_CODES = {"codes": """
    SELECT 'quality' AS construct, doc_id AS unit, 'label' AS coder, quality AS v FROM labels
    UNION ALL SELECT 'quality', doc_id, 'long', CASE WHEN n_tokens > 200 THEN 1 ELSE 0 END FROM feat
    UNION ALL SELECT 'quality', doc_id, 'clean', CASE WHEN hits_SAT = 0 THEN 1 ELSE 0 END FROM feat
    UNION ALL SELECT 'toxic', doc_id, 'label', toxic FROM labels
    UNION ALL SELECT 'toxic', doc_id, 'mood', CASE WHEN vader_neg > vader_pos THEN 1 ELSE 0 END FROM feat""",
    "pv": "SELECT construct, unit, v, count(*) AS c FROM codes GROUP BY ALL",
    "u": "SELECT construct, unit, sum(c) AS m, sum(c * c) AS q FROM pv GROUP BY ALL HAVING sum(c) >= 2",
    "do_": """SELECT construct, sum(m) AS n, sum((m * m - q) / (m - 1)::DOUBLE) AS apart,
                     sum(q - m) / sum(m * (m - 1))::DOUBLE AS agree FROM u GROUP BY construct""",
    "de_": """SELECT construct, sum(t * t) AS same FROM (SELECT pv.construct, v, sum(c) AS t FROM pv
              JOIN u ON u.construct = pv.construct AND u.unit = pv.unit GROUP BY ALL) GROUP BY construct""",
    "r": """SELECT construct, min(rate) AS coder_min, max(rate) AS coder_max, sum(rate * k) / sum(k) AS prevalence
            FROM (SELECT construct, coder, avg(v) AS rate, count(*) AS k FROM codes GROUP BY ALL) GROUP BY construct""",
    "al": """SELECT do_.construct, 1 - (n - 1) * apart / (n * n - same) AS alpha, agree, prevalence, coder_min, coder_max
             FROM do_ JOIN de_ USING (construct) JOIN r USING (construct)"""}


@query("coder_reliability_e10", using("feat", extra=_CODES, body="""
    SELECT construct, round(alpha, 6) AS krippendorff_alpha, round(agree, 6) AS raw_pairwise_agreement,
           round(prevalence, 6) AS prevalence, round(coder_min, 6) AS coder_min, round(coder_max, 6) AS coder_max,
           CASE WHEN greatest(prevalence, 1 - prevalence) >= 0.97 THEN 'Degenerate (no variance)'
                WHEN alpha >= 0.667 THEN 'Usable' ELSE 'Below threshold' END AS verdict FROM al"""))
def coder_reliability(spark, sf):
    labels, feats = I.table(spark, sf, "labels"), I.features(spark, sf)

    def codes(rows, *given):
        each = [F.struct(F.lit(construct).alias("construct"), F.lit(coder).alias("coder"), value.cast("int").alias("v"))
                for construct, coder, value in given]
        return rows.select(F.col("doc_id").alias("unit"), F.explode(F.array(*each)).alias("c")).select("unit", "c.*")

    every = codes(labels, ("quality", "label", F.col("quality")), ("toxic", "label", F.col("toxic"))).unionByName(codes(
        feats, ("quality", "long", F.col("n_tokens") > 200), ("quality", "clean", F.col("hits_SAT") == 0),
        ("toxic", "mood", F.col("vader_neg") > F.col("vader_pos"))))
    return mt.coder_reliability(every.persist(), "construct", "unit", "coder", "v")


@query("price_ranking_e1", """
    SELECT round((sum(r) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1::DOUBLE * n0), 6) AS auc, n1 + n0 AS n FROM (
        SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
               count(*) FILTER (WHERE y = 1) OVER () AS n1, count(*) FILTER (WHERE y = 0) OVER () AS n0
        FROM (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)) GROUP BY n1, n0""")
def price_ranking(spark, sf):
    """The ranking metric over every line item, with nearly all scores distinct."""
    rows = I.table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return mt.ranking_metrics(mt.score_table(rows, "l_extendedprice", "y")).select("auc", "n")
