import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx, text as tx
from tidemark.functions.alternation import merged
from tidemark.functions.scalar import parse_cell, slug, to_day, to_whole_number
from tidemark.operators.describe import reconcile
from tidemark.operators.measure import drop_reason, score_text

FILL = "the room was clean and it had a view of the sea, we were there with our two kids for a week in early"
assert len(FILL) == 100


CASES = [
    None, "", FILL, FILL[:-1], "x" + FILL,
    FILL + " <BR> and<br />then\r\nwe would definitely come back!", "  " + FILL + "  \x1c",
    FILL + " recommended recommendations, highly recommended", FILL + " ſtay again, we would ſtay again? Coıncidence",
    FILL + " THIS IS AN AUTOMATED POSTING", FILL + " not amazing at all. never a great stay. terrible and dirty, no good",
    ("zq " * 80) + "the and was were " * 4, ("zq " * 77) + "the and was " * 4, "a b c " * 4 + "d e" + "." * 90, "a b c " * 4 + "d e f" + "." * 90,
    "bonjour tout le monde " * 8, FILL + "?", FILL + " can't wait to return; we'll be back. I a would be returning " + "word " * 1500 + "lovely",
]


# Rows that pass, by place in CASES: tokens, characters, exclamation marks, sentences, hits of the five constructs in
# the order of the lexicon, compound, positive and negative share. FILL alone has 24 words, none of them with a valence.
WANT = {
    2: (24, 100, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    4: (24, 101, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    5: (32, 146, 1, 2, 0, 0, 0, 1, 0, 0.0, 0.0, 0.0),
    6: (24, 100, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    7: (28, 148, 0, 1, 0, 3, 0, 0, 0, 0.3818, 0.122, 0.0),
    8: (32, 145, 0, 1, 0, 0, 0, 2, 0, 0.0, 0.0, 0.0),
    10: (37, 168, 0, 3, 2, 0, 0, 0, 0, -0.9296, 0.0, 0.316),
    11: (96, 307, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    12: (89, 278, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    14: (15, 119, 0, 91, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
    16: (24, 101, 0, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
}


def test_scores_equal_the_plain_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "review_id long, comments string")
    got = {r["review_id"]: (r["n_tokens"], r["n_chars"], r["n_exclaim"], r["n_sent"], *[r[f"hits_{c}"] for c in lx.PATTERNS],
                            r["vader_compound"], r["vader_pos"], r["vader_neg"]) for r in score_text(df).collect()}
    assert set(got) == set(WANT)
    for i in WANT:
        assert got[i] == pytest.approx(WANT[i]), CASES[i]


def test_density_and_presence(spark):
    df = spark.createDataFrame([(1, FILL + " lovely and lovely")], "review_id long, comments string")
    r = score_text(df).first()
    assert (r["hits_ATT"], r["pres_ATT"], r["pres_SN"]) == (2, 1, 0)
    assert r["dens_ATT"] == pytest.approx(200.0 / r["n_tokens"])


def test_copies_of_a_row_are_both_scored(spark):
    df = spark.createDataFrame([(1, FILL), (1, FILL)], "review_id long, comments string")
    assert score_text(df).count() == 2


def test_drop_reasons(spark):
    cases = [(None, "missing"), ("short", "short"), (FILL + " the reservation was canceled", "automated"),
             ("." * 120, "few_tokens"), ("bonjour tout le monde " * 8, "language"), (FILL, "kept")]
    df = spark.createDataFrame([(t, w) for t, w in cases], "t string, want string")
    assert all(r["reason"] == r["want"] for r in drop_reason(df, "t").collect())


@pytest.mark.parametrize("construct", list(lx.PATTERNS))
def test_merged_patterns_match_at_the_same_places(construct):
    rng = random.Random(construct)
    pats = lx.PATTERNS[construct]
    words = [w for p in pats for w in re.findall(r"[a-z'5]+", p)]
    plain, fast = re.compile(lx.joined(pats), re.I), re.compile(merged(pats), re.I)
    for _ in range(3000):
        t = rng.choice(["", " "]).join(rng.choice(words) for _ in range(12))
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in fast.finditer(t)]


def test_merged_keeps_order_around_patterns_without_a_plain_start():
    pats = ["ab", "[a-c]b?", "abc", "(?:b|c)d", "x?y", "bde"]
    for t in ("abc", "bde", "cd", "xyab", "bd"):
        assert re.findall(lx.joined(tuple(pats)), t) == re.findall(merged(pats), t)


def test_alternatives_outside_groups_and_mixed_case():
    for pats in (["foo|bar", "fit"], ["(?:a|b)c|d", "ac", "D"], ["Ab", "aC", "ab"], ["a[|b]c", "x\\|y|z"]):
        for t in ("foobar fbar fit", "acbcdD", "abAC aBc", "a|c abc x|yz"):
            want = [m.span() for m in re.finditer(lx.joined(tuple(pats)), t, re.I)]
            assert [m.span() for m in re.finditer(merged(pats), t, re.I)] == want, (pats, t)


def test_language_is_judged_by_the_whole_text(spark):
    late = ("zq " * 90) + "the and was were " * 14                     # English after the first 80 tokens
    thin = FILL + " " + "zq " * 600                                    # a few stop words in a long text
    df = spark.createDataFrame([(late, "kept"), (thin, "language")], "t string, want string")
    assert all(r["reason"] == r["want"] for r in drop_reason(df, "t").collect())


def test_other_alphabets_are_matched_too(spark):
    df = spark.createDataFrame([("SCHÖN und schön",)], "t string")
    assert df.select(tx.lexicon_hits(F.col("t"), ["schön"]).alias("n")).first()["n"] == 2


def test_coercion_keeps_large_ids_exact(spark):
    cases = [("12", 12), ("12.0", 12), ("1e3", 1000), ("12x", None), ("", None), ("9007199254740993", 9007199254740993)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string")
    assert [r["v"] for r in df.select(to_whole_number(F.col("s")).alias("v")).collect()] == [b for _, b in cases]


def test_dates_outside_the_calendar_are_null(spark):
    df = spark.createDataFrame([("2020-01-02",), ("2020-13-01",), (None,), ("1970/01/02",)], "s string")
    assert [r["d"] for r in df.select(to_day(F.col("s")).alias("d")).collect()] == [18263, None, None, 1]


def test_slug(spark):
    df = spark.createDataFrame([("São Paulo (BR)",), ("a-b_c",)], "s string")
    assert [r["v"] for r in df.select(slug("s").alias("v")).collect()] == ["Sao_Paulo__BR_", "a-b_c"]


def test_parse_cells(spark):
    df = spark.createDataFrame([("0.2339*** (0.0107)",), ("",), ("-0.0096* (0.0039)",), (None,)], "c string")
    rows = df.select(*[v.alias(k) for k, v in parse_cell(F.col("c")).items()]).collect()
    assert [tuple(r) for r in rows] == [(0.2339, 0.0107, "***"), (None, None, ""), (-0.0096, 0.0039, "*"), (None, None, "")]


def test_reconcile_statuses(spark):
    printed = spark.createDataFrame([("a", "0.234"), ("b", "0.2339"), ("c", "0.5"), ("d", "1")], "k string, v string")
    source = spark.createDataFrame([("a", 0.2339), ("b", 0.2339), ("c", 0.4), ("e", 2.0)], "k string, v double")
    assert {r["k"]: r["status"] for r in reconcile(printed, source, "k", "v").collect()} == {
        "a": "rounding", "b": "match", "c": "mismatch", "d": "missing_source", "e": "missing_printed"}


def test_batches_are_counted_as_the_column_expressions_count_one_text(spark):
    texts = ["İ want to return. ſtay here again K İt is lovely ı love", "    good  \x1c", "a<br\n/>b<BR>c\r\nd<br >e", "ſmooth reKommend first-class 'good'",
             "no good. not very very good, not so very very good. isn't good. Not all that very bad", "easyeasily we could COME BACK we're back", "a\u0085", "good", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    own = {"A": ["gr(?=eat)", "sch.n", "(?:very )+"], **lx.PATTERNS}                    # the first is left to Spark's engine
    got = score_text(df, "t", ["id"], patterns=own, min_chars=0, min_tokens=1, min_stop_words=0)
    t, toks = tx.clean(F.col("t")), tx.tokens(tx.clean(F.col("t")))
    s = tx.sentiment(toks, lx.VALENCES, lx.NEGATORS)
    want = df.select("id", F.size(toks).alias("n_tokens"), F.length(t).alias("n_chars"), F.round(tx.compound(s["total"]), 4).alias("vader_compound"),
                     *[tx.lexicon_hits(t, p).alias(f"hits_{c}") for c, p in own.items()])
    assert got.count() == len(texts) and got.select(*want.columns).exceptAll(want).count() == 0
    # No word is looked at by itself: nothing of the plan runs a function over an array of words.
    plan = score_text(df, "t", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_extract_all" not in plan
