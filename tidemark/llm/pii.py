"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions. The matches of a pattern and the gaps between them (`split` with the
same pattern) give positions in code points. Patterns are written so that Java's matcher needs no
recursion and no repeated scan: repetitions are possessive where giving back can't help, and a
proposal begins at the start of a run or where the last match ended, which is where the leftmost
match of the plain pattern begins.

Kinds: email; ip (parts at most 255); card (14 to 19 digits, Luhn); phone (10 to 15 digits); iban
(mod 97); short_card (13 digits, Luhn) and national_id, which need a context word near by. The
first four always stay; a context word raises their score only.

Defined results: a null text is empty and has no span. Repeated rows and ties stay as they are:
spans of the same start follow in the order of KINDS. Other columns pass through `find_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fresh

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
NATIONAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
BETWEEN = "(?!^)(?!$)"                        # every place between two characters
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BYTES = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "national_id")
BASE = 4                                        # the first kinds stay whatever their score
SCORES = (0.9, 0.6, 0.8, 0.6, 0.9, 0.4, 0.3)
CONTEXT = (
    "mail|contact|kontakt|correo|courriel",
    "server|host|address|adresse",
    "card|visa|credit|karte|carte|tarjeta",
    "phone|call|tel|mobile|telefon",
    "iban|bank|account|konto|compte|cuenta",
    "card|visa|credit|karte|carte|tarjeta",
    "ssn|social security|tax|national id",
)
RAISE, NEEDED, NEAR = 0.3, 0.5, 40              # added by a context word; least score; code points looked back


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right, every second digit doubled, less 9 if over 9; the sum divides by 10."""
    def term(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)
    each = F.transform(F.split(F.reverse(digits), BETWEEN), lambda c: c.cast("int"))
    return F.aggregate(F.transform(each, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """First four characters moved to the end, letters as 10..35, the number is 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def fed(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)
    return F.aggregate(F.split(moved, BETWEEN), F.lit(0), fed) == 1


def positioned(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points, end exclusive."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["g"])
        end = start + F.length(pair["v"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    # Gaps are cut only where there is a match.
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _valid(kind: str, text: Column, span: Column) -> Column:
    value = span["value"]
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(BYTES)
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(value))
    if kind == "short_card":
        return (n == 13) & luhn(_digits(value))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "national_id":
        around = F.concat(F.when(span["start"] > 0, text.substr(span["start"], F.lit(1))).otherwise(""),
                          text.substr(span["end"] + 1, F.lit(1)))
        return ~around.rlike("[0-9]")
    return F.lit(True)


def find_spans(docs: DataFrame, text_col: str = "text", to: str = "pii") -> DataFrame:
    """Adds `to`, or puts it in place of a column of that name: array of (start, kind number, end, score), by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, CARD, NATIONAL)))
    hints = dict(email="@", phone="+")             # a character that every match holds
    marks: dict[str, str] = {}
    proposed = docs
    for kind, pattern in patterns.items():
        if pattern not in marks:
            marks[pattern] = fresh(proposed, f"_pii_{len(marks)}")
            found = positioned(text, pattern)
            if kind in hints:
                found = F.when(F.instr(text, hints[kind]) > 0, found)
            proposed = proposed.withColumn(marks[pattern], found)

    def scored(i: int, kind: str) -> Column:
        def score(span: Column) -> Column:
            # Only the code points just before the span are looked at.
            from_ = F.greatest(span["start"] - NEAR, F.lit(0))
            near = F.lower(text.substr(from_ + 1, span["start"] - from_)).rlike(CONTEXT[i])
            points = F.least(F.lit(SCORES[i]) + F.when(near, RAISE).otherwise(0.0), F.lit(1.0))
            return F.struct(span["start"].alias("start"), F.lit(i).alias("kind"), span["end"].alias("end"), points.alias("score"))
        spans = F.coalesce(F.col(marks[patterns[kind]]), F.array().cast("array<struct<start:int,end:int,value:string>>"))
        kept = F.transform(F.filter(spans, lambda s: _valid(kind, text, s)), score)
        return kept if i < BASE else F.filter(kept, lambda s: s["score"] >= NEEDED)

    every = F.array_sort(F.concat(*[scored(i, k) for i, k in enumerate(KINDS)]))
    return proposed.withColumn(to, every).drop(*marks.values())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"),
                         F.greatest(last["end"], s["end"]).alias("end"))
        return (F.when(F.size(acc) == 0, F.array(one))
                .when(s["start"] >= last["end"], F.concat(acc, F.array(one)))
                .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))))

    apart = F.aggregate(spans, empty, merge)

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(apart, i - 1)["end"])
        return F.concat(text.substr(begin + 1, s["start"] - begin), F.get(names, s["kind"]))
    tail = text.substr(F.element_at(apart, -1)["end"] + 1, F.lit(2 ** 31 - 1) - F.element_at(apart, -1)["end"])
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(apart, piece), ""), tail))
