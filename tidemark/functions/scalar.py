"""Column expressions: sampling hash, calendar, scaling, labels and report cells."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Multiplier of the sampling hash, and the flagged period.
HASH_MULTIPLIER = 2654435761
PERIOD_START, PERIOD_END = "2020-03-11", "2023-05-05"
SEED = 20260901


def hash32(key: Column, seed: int = 0) -> Column:
    """Low 32 bits of (key + seed) * HASH_MULTIPLIER, kept inside 63 bits so ANSI mode never overflows."""
    k = key.cast("long") + F.lit(seed).cast("long") if seed else key.cast("long")
    low = k.bitwiseAND(F.lit(65535))
    high = F.shiftright(k, 16).bitwiseAND(F.lit(65535))
    carried = F.shiftleft((high * F.lit(HASH_MULTIPLIER)).bitwiseAND(F.lit(65535)), 16)
    return (low * F.lit(HASH_MULTIPLIER) + carried).bitwiseAND(F.lit(4294967295))


def in_hash_sample(key: Column, per_1000: int) -> Column:
    """True for a fixed, reproducible `per_1000` / 1000 of the keys."""
    return F.pmod(hash32(key), F.lit(1000)) < F.lit(per_1000)


def fold_of(key: Column, folds: int, seed: int = SEED) -> Column:
    """Fold 0 .. folds-1 of a row, from its key."""
    return F.pmod(hash32(key, seed), F.lit(folds)).cast("int")


def to_whole_number(text: Column) -> Column:
    """Integer value of a string (`12`, `12.0`, `1e3`), null when it is not a number."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def to_day(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")) -> Column:
    """Days since 1970-01-01, trying the formats in turn; null when none fits."""
    parsed = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.unix_date(F.coalesce(*parsed))


def in_period(day: Column, start: str = PERIOD_START, end: str = PERIOD_END) -> Column:
    """1 when the day lies in the closed period, else 0."""
    return day.between(F.unix_date(F.lit(start).cast("date")), F.unix_date(F.lit(end).cast("date"))).cast("int")


def log1p_floor(x: Column) -> Column:
    """log(1 + x) with negative x raised to 0."""
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))


def month_sin(month: Column) -> Column:
    return F.sin(month * F.lit(2.0) * F.pi() / F.lit(12.0))


def month_cos(month: Column) -> Column:
    return F.cos(month * F.lit(2.0) * F.pi() / F.lit(12.0))


def time_split(period: Column, train_to: int, validation_to: int) -> Column:
    """train / validation / test by two closed upper cuts."""
    return (F.when(period <= train_to, "train").when(period <= validation_to, "validation")
            .when(period.isNotNull(), "test"))


def stars(p: Column) -> Column:
    return F.when(p < .001, "***").when(p < .01, "**").when(p < .05, "*").otherwise("")


def coefficient_cell(coef: Column, se: Column, p: Column) -> Column:
    """`0.2339*** (0.0107)`; null without a coefficient."""
    return F.when(coef.isNotNull(), F.concat(F.format_string("%.4f", coef), stars(p),
                                             F.format_string(" (%.4f)", se)))


NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
CELL = rf"^\s*(-?{NUMBER})(\*{{0,3}})\s*\(({NUMBER})\)"


def parse_cell(cell: Column) -> dict[str, Column]:
    """coef, se and stars of a coefficient cell; null numbers when the cell is blank or malformed."""
    def number(group: int) -> Column:
        return F.regexp_extract(cell, CELL, group).try_cast("double")
    return {"coef": number(1), "se": number(3), "stars": F.coalesce(F.regexp_extract(cell, CELL, 2), F.lit(""))}


def bounds(estimate: Column, se: Column, scale: float = 1.0, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper confidence bound, times `scale` (100 for percentage points)."""
    return (estimate - se * z) * scale, (estimate + se * z) * scale


def pseudonym(key: Column, salt: str, chars: int = 16) -> Column:
    """Prefix of the salted SHA-256 of an id."""
    return F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, chars)


def count_and_share(count: Column, total: Column, decimals: int = 2) -> Column:
    """`5,394 (0.76%)`."""
    share = F.format_string(f"%.{decimals}f", F.lit(100.0) * count / total)
    return F.concat(F.format_number(count, 0), F.lit(" ("), share, F.lit("%)"))


#: Characters of a combining class other than 0, and what is neither a word character nor `-`.
ACCENT, NOT_KEPT = regex.compile(r"\P{ccc=0}"), regex.compile(r"[^\w-]")


@F.pandas_udf(StringType())
def slug(names: pd.Series) -> pd.Series:
    """Letters, digits, `-` and `_` kept, accents dropped, anything else replaced by `_`."""
    decomposed = names.str.normalize("NFKD")
    return decomposed.map(lambda name: NOT_KEPT.sub("_", ACCENT.sub("", name)), na_action="ignore")
