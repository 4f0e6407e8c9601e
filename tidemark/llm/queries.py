"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (bpe, chat, contamination, fim, fingerprint, jaccard, lm, negatives, packing, pii, quality, repeats,
                          tokens)
from tidemark.llm.common import fold_of, table
from tidemark.llm.oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def quality_model(spark: SparkSession, docs: DataFrame, sf: str):
    """Learned from labels whose document's fold (crc32 of the id modulo 4) isn't 2."""
    labels = table(spark, sf, "labels").where(fold_of("doc_id", 4) != 2)
    return quality.train(docs, labels, "quality")


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf))
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words left after removing windows of 20 words that also start earlier."""
    return repeats.remove_repeats(table(spark, sf, "documents"), with_text=False).drop("kept")


@query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or paraphrased."""
    return contamination.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf, "documents"), TOKENIZER, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation, and -7, which holds the template's own control strings, formatted and read back."""
    control = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(control).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_chats(rows))


@query
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"), TOKENIZER)


@query
def op8_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have Jaccard 0.9 or more."""
    return jaccard.near_duplicates(table(spark, sf, "documents"), size=3, percent=90)


@query
def op9_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all texts under a model of those whose fold (crc32 of the id modulo 7) isn't 2."""
    return lm.score_texts(table(spark, sf, "documents"), fold_of("doc_id", 7) == 2)


@query
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every whole text; base kinds apart from what checksums and context words add."""
    found = pii.find_spans(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] < pii.BASE)
    count = lambda i: F.size(F.filter("pii", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:pii.BASE])],
                        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every text cut in three at lines, its parts reordered, and put back together."""
    made = fim.fill_in_middle(table(spark, sf, "documents"), unit="line", seed=7, percent=100, percent_spm=50)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Negatives for every positive of the anchors, ids divisible by 100; a seventh of the labels is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op13_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to."""
    coded = bpe.encode_texts(table(spark, sf, "documents"), BYTE_TOKENIZER, decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
