"""SQL building blocks over the registered tables, written independently of the Spark plans."""

from __future__ import annotations

from catalog.inputs import PHRASES
from tidemark.functions import lexicon as lx


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_list(words) -> str:
    return "[" + ", ".join(text_literal(w) for w in words) + "]"


_PHRASE_CASE = "CASE doc_id % 8 " + " ".join(
    f"WHEN {i} THEN {text_literal(p)}" for i, p in enumerate(PHRASES)) + " END"
_VALENCES = ", ".join(f"({text_literal(w)}, CAST({v} AS DOUBLE))" for w, v in lx.VALENCES.items())
_NEG = "(" + ", ".join(text_literal(w) for w in lx.NEGATORS) + ")"
_HITS = ", ".join(f"len(regexp_extract_all(t, {text_literal(lx.joined(p))}, 0, 'i')) AS hits_{c}"
                  for c, p in lx.PATTERNS.items())
_SHARES = ", ".join(f"h.hits_{c}, 100.0 * h.hits_{c}::DOUBLE / h.n_tokens AS dens_{c}, "
                    f"CASE WHEN h.hits_{c} > 0 THEN 1 ELSE 0 END AS pres_{c}" for c in lx.PATTERNS)
_AUTO = text_literal("|".join(lx.AUTOMATED_POSTS))

# name -> (needed blocks, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), "SELECT l_orderkey, min(l_suppkey) AS listing_id FROM lineitem GROUP BY l_orderkey"),
    "reviews": (("lines",), """
        SELECT o_orderkey AS review_id, o_custkey AS reviewer_id, listing_id, s_nationkey AS city_id,
               date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS date_i
        FROM orders JOIN lines ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = listing_id"""),
    "ctx": (("reviews",), """
        SELECT *, row_number() OVER (PARTITION BY city_id, listing_id ORDER BY date_i, review_id) - 1
                      AS listing_prior_reviews,
               min(date_i) OVER (PARTITION BY city_id, listing_id) AS listing_first_date FROM reviews"""),
    "firsts": (("ctx",), """
        SELECT * FROM ctx QUALIFY row_number() OVER (
            PARTITION BY reviewer_id ORDER BY date_i, review_id, city_id, listing_id) = 1"""),
    "eligible": (("firsts",), "SELECT * FROM firsts WHERE date_i <= 11535 - 730"),
    "pairs": (("eligible",), """
        SELECT e.reviewer_id, r.review_id, r.listing_id, r.date_i, e.date_i AS t0, e.listing_id AS l0,
               r.date_i - e.date_i AS gap
        FROM eligible e JOIN reviews r ON r.reviewer_id = e.reviewer_id
        WHERE r.date_i - e.date_i >= 90 AND r.date_i - e.date_i <= 730"""),
    "counts": (("pairs",), """
        SELECT reviewer_id, count(*) AS n_future, count(*) FILTER (WHERE listing_id = l0) AS n_future_same,
               min(gap) AS days_to_next FROM pairs GROUP BY reviewer_id"""),
    "focal": (("counts",), """
        SELECT e.reviewer_id, e.review_id, e.listing_id, e.city_id, DATE '1970-01-01' + CAST(e.date_i AS INTEGER) AS date,
               e.date_i, year(DATE '1970-01-01' + CAST(e.date_i AS INTEGER)) AS year,
               month(DATE '1970-01-01' + CAST(e.date_i AS INTEGER)) AS month,
               CASE WHEN e.date_i BETWEEN 9312 AND 9677 THEN 1 ELSE 0 END AS covid, e.listing_prior_reviews,
               e.date_i - e.listing_first_date AS listing_age_days, coalesce(c.n_future, 0) AS n_future,
               coalesce(c.n_future_same, 0) AS n_future_same, c.days_to_next,
               CASE WHEN c.n_future_same > 0 THEN 1 ELSE 0 END AS y_revisit,
               CASE WHEN c.n_future > 0 THEN 1 ELSE 0 END AS y_continue
        FROM eligible e LEFT JOIN counts c ON c.reviewer_id = e.reviewer_id"""),
    "aug": ((), f"SELECT doc_id, source, text || {_PHRASE_CASE} AS text FROM documents"),
    "cleaned": (("aug",), r"""
        SELECT doc_id, source, text,
               regexp_replace(regexp_replace(text, '<br\s*/?>|\r|\n', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM aug"""),
    "split": (("cleaned",), "SELECT *, regexp_extract_all(lower(t), '[a-zA-Z'']+') AS toks FROM cleaned"),
    "judged": (("split",), f"""
        SELECT *, len(list_filter(toks, lambda w: list_contains({text_list(lx.STOP_WORDS)}, w)))
                      AS n_stop, regexp_matches(t, {_AUTO}, 'i') AS automated FROM split"""),
    "kept": (("judged",), f"""
        SELECT * FROM judged WHERE length(t) >= {lx.MIN_CHARS} AND NOT automated AND len(toks) >= {lx.MIN_TOKENS}
                                   AND n_stop * {lx.LANGUAGE_TOKENS} >= {lx.MIN_STOP_WORDS} * greatest(len(toks), {lx.LANGUAGE_TOKENS})"""),
    "words": (("kept",), "SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM kept"),
    "near": (("words",), """
        SELECT doc_id, w, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3 FROM words
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)"""),
    "valued": (("near",), f"""
        SELECT doc_id, coalesce(v.valence, 0.0::DOUBLE) * CASE WHEN w1 IN {_NEG} OR w2 IN {_NEG} OR w3 IN {_NEG}
                   THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END AS s
        FROM near LEFT JOIN (VALUES {_VALENCES}) v(word, valence) ON v.word = near.w"""),
    "sent": (("valued",), """
        SELECT doc_id, sum(s) AS total, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS pos,
               sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS neg, count(*) FILTER (WHERE s = 0) AS neutral
        FROM valued GROUP BY doc_id"""),
    "hits": (("kept",), f"""
        SELECT doc_id, source, len(toks) AS n_tokens, length(t) AS n_chars,
               length(t) - length(replace(t, '!', '')) AS n_exclaim,
               2 * length(t) - length(replace(t, '.', '')) - length(replace(t, '!', '')) + 1 AS n_sent, {_HITS}
        FROM kept"""),
    "feat": (("hits", "sent"), f"""
        SELECT h.doc_id, h.source, h.n_tokens, h.n_chars, h.n_exclaim, h.n_sent, {_SHARES},
               round(s.total / sqrt(s.total * s.total + 15), 4) AS vader_compound,
               round(s.pos / (s.pos + s.neg + s.neutral), 3) AS vader_pos,
               round(s.neg / (s.pos + s.neg + s.neutral), 3) AS vader_neg
        FROM hits h JOIN sent s ON s.doc_id = h.doc_id"""),
    "analysis": (("focal", "feat"), """
        SELECT f.*, x.* EXCLUDE (source), n.n_name AS city FROM focal f
        JOIN feat x ON x.doc_id = f.review_id % (SELECT count(*) FROM documents)
        JOIN nation n ON n.n_nationkey = f.city_id"""),
}


def needs(names: tuple[str, ...], seen: list[str] | None = None) -> list[str]:
    seen = [] if seen is None else seen
    for n in names:
        if n not in seen:
            needs(BLOCKS[n][0], seen)
            seen.append(n)
    return seen


def using(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """A statement over the named blocks, followed by its own `extra` ones."""
    # Blocks read more than once are kept, so the text is scored a single time.
    parts = [f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in needs(names)]
    parts += [f"{n} AS MATERIALIZED ({b})" for n, b in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
