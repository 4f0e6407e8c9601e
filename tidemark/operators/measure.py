"""Text measurement: screens, construct hits and sentiment, one narrow pass per row."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.functions import lexicon as lx, scan as sn, text as tx
from tidemark.operators.skew import lookup_join


def fetch_text(raw: DataFrame, focal: DataFrame, max_chars: int | None = None,
               possible: Column | None = None) -> DataFrame:
    """(city_id, review_id, comments) of the raw rows whose (city_id, review_id) is in the cohort, copies included.

    Text is read late and only cohort rows are kept: by broadcast when the counted cohort
    is small. Beyond that both sides shuffle, and the adaptive skew join splits a hot
    review id. `possible` is a condition every wanted row is known to meet; it is applied
    before the shuffle.
    """
    rows = raw if possible is None else raw.filter(possible)
    wanted = focal.select("city_id", "review_id")
    kept = lookup_join(rows, wanted, ["city_id", "review_id"], "left_semi", hot_rows=None)
    return kept.select("city_id", "review_id", tx.truncate(F.col("comments"), max_chars).alias("comments"))


def drop_reason(df: DataFrame, text_col: str, min_chars: int = lx.MIN_CHARS, min_tokens: int = lx.MIN_TOKENS,
                min_stop_words: int = lx.MIN_STOP_WORDS) -> DataFrame:
    """Add `reason`: kept, missing, short, automated, few_tokens or language."""
    cleaned = df.withColumn("_text", F.explode(F.array(tx.clean(F.col(text_col)))))
    split = cleaned.withColumn("_tokens", F.explode(F.array(tx.tokens(F.col("_text")))))
    return split.withColumn("reason", F.when(F.col("_text").isNull(), "missing")
                            .when(F.length("_text") < min_chars, "short")
                            .when(tx.is_automated(F.col("_text")), "automated")
                            .when(F.size("_tokens") < min_tokens, "few_tokens")
                            .when(~tx.is_in_language(F.col("_tokens"), min_stop_words), "language")
                            .otherwise("kept")).drop("_text", "_tokens")


def screening_funnel(df: DataFrame, text_col: str, by: str) -> DataFrame:
    """Rows read, kept and dropped for each reason, per group."""
    def count(reason: str):
        return F.count_if(F.col("reason") == reason).alias(f"n_{reason}")
    return drop_reason(df, text_col).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_read"),
        *[count(r) for r in ("kept", "missing", "short", "automated", "few_tokens", "language")])


def score_text(df: DataFrame, text_col: str = "comments", keep: Sequence[str] = ("review_id",),
               patterns: Mapping[str, Sequence[str]] = lx.PATTERNS,
               valences: Mapping[str, float] = lx.VALENCES, negators: Sequence[str] = lx.NEGATORS,
               sentiment_chars: int | None = None, min_chars: int = lx.MIN_CHARS, min_tokens: int = lx.MIN_TOKENS,
               min_stop_words: int = lx.MIN_STOP_WORDS) -> DataFrame:
    """Surface counts, construct hits, density and presence, and sentiment of every row that passes.

    Narrow and stateless, so it works on a stream as well. Sentiment reads the whole
    text unless `sentiment_chars` is set. Words and plain patterns are counted over Arrow batches.
    """
    t, n = F.col("_text"), F.col("n_tokens")
    # `explode(array(x))` evaluates x once per row: the filter cannot be pushed through it.
    long = (df.withColumn("_text", F.explode(F.array(tx.clean(F.col(text_col))))).filter(F.length("_text") >= min_chars)
            .select(*keep, "_text", F.lower(t).alias("_lower"),
                    *([] if sentiment_chars is None else [F.lower(tx.truncate(t, sentiment_chars)).alias("_heard")])))
    kept = [f for f in long.schema.fields if f.name not in ("_text", "_lower", "_heard")]
    plain = {c: tuple(p) for c, p in patterns.items() if sn.is_plain(p)}
    counts = ["n_tokens", "n_chars", "n_exclaim", "n_sent", "_automated", "_stops", *[f"hits_{c}" for c in plain]]
    sums = ["_total", "_pos", "_neg", "_neutral"]
    rest = ["_text"] if len(plain) < len(patterns) else []          # other expressions are left to Spark's engine
    schema = StructType([*kept, *[StructField(c, IntegerType()) for c in counts], *[StructField(c, DoubleType()) for c in sums],
                         *[StructField(c, StringType()) for c in rest]])
    first, valences, negators = len(kept), dict(valences), list(negators)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts, lowered, heard = (b.column(i).cast(pa.string()) for i in (first, first + 1, b.num_columns - 1))
            folded = sn.folded(texts)
            marks = pc.count_substring(texts, "!")
            n_tokens, stops = sn.word_counts(lowered, lx.STOP_WORDS)
            found = [n_tokens, pc.utf8_length(texts), marks, pc.add(pc.add(pc.count_substring(texts, "."), marks), 1),
                     sn.has_any(folded, lx.AUTOMATED_POSTS).cast(pa.int32()), stops, *[sn.matches(folded, p) for p in plain.values()]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:first], *[pa.array(np.asarray(c), pa.int32()) for c in found],
                 *[pa.array(s, pa.float64()) for s in sn.valence_sums(heard, valences, negators, tx.NEGATED, tx.NEGATION_REACH)],
                 *[texts] * len(rest)], schema.names)

    per = F.lit(lx.LANGUAGE_TOKENS)
    passed = long.mapInArrow(scan, schema).filter(
        (F.col("_automated") == 0) & (n >= min_tokens) & (F.col("_stops") * per >= F.greatest(n, per) * min_stop_words))
    counted = passed.withColumns({f"hits_{c}": tx.lexicon_hits(t, p) for c, p in patterns.items() if c not in plain}) if rest else passed
    total = F.col("_pos") - F.col("_neg") + F.col("_neutral")
    return counted.select(
        *[f.name for f in kept], "n_tokens", "n_chars", "n_exclaim", "n_sent",
        *[col for c in patterns for col in (
            F.col(f"hits_{c}"),
            (F.lit(100.0) * F.col(f"hits_{c}") / n).alias(f"dens_{c}"),
            (F.col(f"hits_{c}") > 0).cast("int").alias(f"pres_{c}"))],
        F.round(tx.compound(F.col("_total")), 4).alias("vader_compound"),
        F.round(F.coalesce(F.try_divide(F.col("_pos"), total), F.lit(0.0)), 3).alias("vader_pos"),
        F.round(F.coalesce(F.try_divide(F.abs("_neg"), total), F.lit(0.0)), 3).alias("vader_neg"))
