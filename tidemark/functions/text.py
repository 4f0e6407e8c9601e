"""Column expressions over review text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidemark.functions.alternation import merged
from tidemark.functions.lexicon import AUTOMATED_POSTS, LANGUAGE_TOKENS, MIN_STOP_WORDS, STOP_WORDS

BREAK_TAG = r"(?U)<br\s*/?>"
EDGE = r"(?U)[\s\x1c-\x1f]"
EDGES = rf"(?U)^{EDGE[4:]}+|{EDGE[4:]}+$"
TOKEN = r"[a-zA-Z']+"
# Published constants of the valence rule: normalisation, and the weight of a negated word.
NORMALISER = 15.0
NEGATED = -0.74
NEGATION_REACH = 3


def truncate(text: Column, chars: int | None) -> Column:
    """First `chars` code points; the whole text when `chars` is None."""
    return text if chars is None else F.substring(text, 1, chars)


def clean(text: Column) -> Column:
    """Line breaks (`<br/>`, CR, LF) become spaces, then the ends are stripped.

    The two expressions go over a text only when it holds a tag, or a space at an end.
    """
    tagless = F.when(F.contains(text, F.lit("<br")), F.regexp_replace(text, BREAK_TAG, " ")).otherwise(text)
    line = F.replace(F.replace(tagless, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    loose = F.substring(line, 1, 1).rlike(EDGE) | F.substring(line, -1, 1).rlike(EDGE)
    return F.when(loose, F.regexp_replace(line, EDGES, "")).otherwise(line)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_automated(text: Column, phrases: Sequence[str] = AUTOMATED_POSTS) -> Column:
    return text.rlike("(?iu)" + "|".join(phrases))


def stop_word_count(toks: Column, words: Sequence[str] = STOP_WORDS, first: int | None = None) -> Column:
    """Occurrences of stop words among all tokens, or among the first ones."""
    heard = toks if first is None else F.slice(toks, 1, first)
    return F.size(F.filter(heard, lambda w: w.isin(list(words))))


def is_in_language(toks: Column, least: int = MIN_STOP_WORDS, per: int = LANGUAGE_TOKENS) -> Column:
    """At least `least` stop words for every `per` tokens of the whole text, and `least` in a shorter one."""
    return stop_word_count(toks) * per >= F.greatest(F.size(toks), F.lit(per)) * least


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def sentence_count(text: Column) -> Column:
    """Full stops and exclamation marks, plus one."""
    return count_char(text, ".") + count_char(text, "!") + F.lit(1)


def lexicon_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Non-overlapping, case-blind matches of any of the patterns."""
    merged_patterns = merged(patterns)
    if not merged_patterns.isascii():
        return F.regexp_count(text, F.lit("(?iu)" + merged_patterns))
    # Four other letters equal an ASCII one when case is ignored; with them replaced, the
    # faster ASCII-only matching finds the same.
    return F.regexp_count(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"), F.lit("(?i)" + merged_patterns))


def valence(word: Column, valences: Mapping[str, float]) -> Column:
    """Valence of a word, 0 when it has none; one hash lookup for the many words without."""
    by_value: dict[float, list[str]] = {}
    for w, v in valences.items():
        by_value.setdefault(float(v), []).append(w)
    pick = F.lit(0.0)
    for v, words in sorted(by_value.items()):
        pick = F.when(word.isin(words), F.lit(v)).otherwise(pick)
    return F.when(word.isin(list(valences)), pick).otherwise(F.lit(0.0))


def sentiment(toks: Column, valences: Mapping[str, float], negators: Sequence[str]) -> Column:
    """Struct of the summed valence, its positive and negative parts and the neutral count.

    A word is negated when one of the three words before it is a negator.
    """
    flip = F.array(*[F.lit(w) for w in negators])

    def score(word: Column, i: Column) -> Column:
        before = F.slice(toks, F.greatest(i - (NEGATION_REACH - 1), F.lit(1)), F.least(i, F.lit(NEGATION_REACH)))
        weight = F.when(F.arrays_overlap(before, flip), F.lit(NEGATED)).otherwise(F.lit(1.0))
        return F.when(word.isin(list(valences)), valence(word, valences) * weight).otherwise(F.lit(0.0))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"),
                     F.lit(0.0).alias("neutral"))
    return F.aggregate(F.transform(toks, score), start, lambda acc, v: F.struct(
        (acc["total"] + v).alias("total"),
        (acc["pos"] + F.when(v > 0, v + 1).otherwise(F.lit(0.0))).alias("pos"),
        (acc["neg"] + F.when(v < 0, v - 1).otherwise(F.lit(0.0))).alias("neg"),
        (acc["neutral"] + F.when(v == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("neutral")))


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + F.lit(NORMALISER))
