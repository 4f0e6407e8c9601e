"""Text queries over the whole documents with phrases of known content appended."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.inputs import scratch
from catalog.registry import query
from catalog.sql import text_list, text_literal, using
from tidemark.functions import lexicon as lx, text as tx
from tidemark.operators import measure as me
from tidemark.streaming import jobs


@query("stored_length_t1", using("aug", body="""
    SELECT doc_id, length(substr(text, 1, 4000)) AS stored, length(text) AS whole,
           md5(substr(text, 1, 4000)) AS digest FROM aug"""))
def stored_length(spark, sf):
    """Truncation is the operator; every other query scores whole texts."""
    stored = tx.truncate(F.col("text"), lx.STORED_CHARS)
    return I.aug_documents(spark, sf).select("doc_id", F.length(stored).alias("stored"), F.length("text").alias("whole"),
                                             F.md5(stored.cast("binary")).alias("digest"))


@query("cleaned_text_t2", using("cleaned", body="SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM cleaned"))
def cleaned_text(spark, sf):
    t = tx.clean(F.col("text"))
    return I.aug_documents(spark, sf).select("doc_id", F.length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("long_enough_t3", using("cleaned", body="SELECT doc_id FROM cleaned WHERE length(t) >= 100"))
def long_enough(spark, sf):
    return I.aug_documents(spark, sf).filter(F.length(tx.clean(F.col("text"))) >= lx.MIN_CHARS).select("doc_id")


@query("automated_posts_t4", using("judged", body="SELECT doc_id FROM judged WHERE automated"))
def automated_posts(spark, sf):
    return I.aug_documents(spark, sf).filter(tx.is_automated(tx.clean(F.col("text")))).select("doc_id")


@query("token_counts_t5_t6", using("split", body="""
    SELECT doc_id, len(toks) AS n_tokens, toks[1] AS first_token, toks[-1] AS last_token,
           CAST(len(toks) >= 15 AS BIGINT) AS enough FROM split"""))
def token_counts(spark, sf):
    toks = I.aug_documents(spark, sf).select("doc_id", F.explode(F.array(tx.tokens(tx.clean(F.col("text"))))).alias("k"))
    return toks.select("doc_id", F.size("k").alias("n_tokens"), F.try_element_at("k", F.lit(1)).alias("first_token"),
                       F.try_element_at("k", F.lit(-1)).alias("last_token"),
                       (F.size("k") >= lx.MIN_TOKENS).cast("long").alias("enough"))


@query("language_screen_t7", using("split", body="""
    SELECT doc_id, n AS n_stop, CAST(n >= 3 AS BIGINT) AS passes FROM (SELECT doc_id, len(list_filter(toks[1:80], lambda w: list_contains("""
    + text_list(lx.STOP_WORDS) + """, w))) AS n FROM split)"""))
def language_screen(spark, sf):
    toks = I.aug_documents(spark, sf).select("doc_id", F.explode(F.array(tx.tokens(tx.clean(F.col("text"))))).alias("k"))
    n = tx.stop_word_count(F.col("k"), first=lx.LANGUAGE_TOKENS)      # the rule of the first tokens
    return toks.select("doc_id", n.alias("n_stop"), (n >= lx.MIN_STOP_WORDS).cast("long").alias("passes"))


@query("surface_counts_t8", using("hits", body="SELECT doc_id, n_chars, n_exclaim, n_sent FROM hits"))
def surface_counts(spark, sf):
    return I.features(spark, sf).select("doc_id", "n_chars", "n_exclaim", "n_sent")


@query("construct_hits_t9", using("cleaned", body="SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(t, {text_literal(lx.joined(p))}, 0, 'i')) AS hits_{c}"
    for c, p in lx.PATTERNS.items()) + " FROM cleaned"))
def construct_hits(spark, sf):
    docs = I.aug_documents(spark, sf).select("doc_id", tx.clean(F.col("text")).alias("t"))
    return docs.select("doc_id", *[tx.lexicon_hits(F.col("t"), p).alias(f"hits_{c}") for c, p in lx.PATTERNS.items()])


@query("density_presence_t10", using("feat", body="SELECT doc_id, " + ", ".join(
    f"round(dens_{c}, 6) AS dens_{c}, pres_{c}::BIGINT AS pres_{c}" for c in lx.PATTERNS) + " FROM feat"))
def density_presence(spark, sf):
    return I.features(spark, sf).select("doc_id", *[f"{k}_{c}" for c in lx.PATTERNS for k in ("dens", "pres")])


@query("valence_sentiment_t11", using("feat", body="SELECT doc_id, vader_compound, vader_pos, vader_neg FROM feat"))
def valence_sentiment(spark, sf):
    return I.features(spark, sf).select("doc_id", "vader_compound", "vader_pos", "vader_neg")


@query("scored_text_t12", using("feat", body="SELECT doc_id, n_tokens, n_chars, n_exclaim, n_sent, " + ", ".join(
    f"hits_{c}, round(dens_{c}, 6) AS dens_{c}, pres_{c}::BIGINT AS pres_{c}" for c in lx.PATTERNS)
    + ", vader_compound, vader_pos, vader_neg FROM feat"))
def scored_text(spark, sf):
    return I.features(spark, sf)


@query("streamed_scores_st2", using("feat", body="SELECT doc_id, n_tokens, n_sent, vader_compound, "
       + ", ".join(f"hits_{c}" for c in lx.PATTERNS) + " FROM feat"))
def streamed_scores(spark, sf):
    """The scorer on a stream of the documents."""
    # As a pattern the path may be a folder or one file; a stream takes a plain path for a folder.
    docs = spark.readStream.schema(I.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    target = scratch(spark)
    jobs.score_stream(I.augmented(docs).withColumnRenamed("text", "comments"), target, scratch(spark), keep=["doc_id"]).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "n_tokens", "n_sent", "vader_compound", *[f"hits_{c}" for c in lx.PATTERNS])


@query("screening_funnel_t13", using("judged", body="""
    SELECT source, count(*) AS n_read, count(*) FILTER (WHERE r = 'kept') AS n_kept,
           count(*) FILTER (WHERE r = 'missing') AS n_missing, count(*) FILTER (WHERE r = 'short') AS n_short,
           count(*) FILTER (WHERE r = 'automated') AS n_automated, count(*) FILTER (WHERE r = 'few') AS n_few_tokens,
           count(*) FILTER (WHERE r = 'language') AS n_language
    FROM (SELECT source, CASE WHEN t IS NULL THEN 'missing' WHEN length(t) < 100 THEN 'short' WHEN automated THEN 'automated'
                              WHEN len(toks) < 15 THEN 'few' WHEN n_stop * 80 < 3 * greatest(len(toks), 80) THEN 'language' ELSE 'kept' END AS r FROM judged)
    GROUP BY source"""))
def screening_funnel(spark, sf):
    return me.screening_funnel(I.aug_documents(spark, sf), "text", "source")


@query("conversation_scores_t12", """
    SELECT conv_id, turn, len(toks) AS n_tokens, length(t) - length(replace(t, '!', '')) AS n_exclaim FROM (
        SELECT conv_id, turn, t, regexp_extract_all(lower(t), '[a-zA-Z'']+') AS toks FROM (
            SELECT conv_id, turn, regexp_replace(regexp_replace(text, '<br\\s*/?>|\\r|\\n', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t
            FROM conversations))
    WHERE length(t) >= 20 AND len(toks) >= 3 AND 80 * len(list_filter(toks, lambda w: list_contains(
        [""" + ", ".join(text_literal(w) for w in lx.STOP_WORDS) + """], w))) >= greatest(len(toks), 80)""")
def conversation_scores(spark, sf):
    """The same scorer over short turns, with looser screens."""
    turns = I.table(spark, sf, "conversations")
    scored = me.score_text(turns, "text", ["conv_id", "turn"], min_chars=20, min_tokens=3, min_stop_words=1)
    return scored.select("conv_id", "turn", "n_tokens", "n_exclaim")


@query("late_text_fetch_j1", using("focal", "aug", body="""
    SELECT f.review_id, length(a.text) AS n_chars, md5(a.text) AS digest
    FROM focal f JOIN aug a ON a.doc_id = f.review_id % (SELECT count(*) FROM documents)"""))
def late_text_fetch(spark, sf):
    docs = I.aug_documents(spark, sf)
    n = docs.count()
    reviews = I.reviews(spark, sf).withColumn("doc_id", F.col("review_id") % F.lit(n))
    raw = reviews.join(docs, "doc_id").select("city_id", "review_id", F.col("text").alias("comments"))
    return me.fetch_text(raw, I.focal(spark, sf), None).select(
        "review_id", F.length("comments").alias("n_chars"), F.md5(F.col("comments").cast("binary")).alias("digest"))


@query("analysis_table_j6", using("analysis", body="""
    SELECT review_id, city, y_revisit::BIGINT AS y_revisit, y_continue::BIGINT AS y_continue, n_tokens, hits_BI,
           round(dens_ATT, 6) AS dens_ATT, vader_compound, listing_prior_reviews FROM analysis"""))
def analysis_table(spark, sf):
    return I.analysis(spark, sf).select("review_id", "city", "y_revisit", "y_continue", "n_tokens", "hits_BI",
                                        "dens_ATT", "vader_compound", "listing_prior_reviews")
