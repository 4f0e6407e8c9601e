"""SQL for the corpus queries that it can express, written apart from the Spark plans."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x20\x09-\x0D]+')")

REPEATS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM d, unnest(range(1, len(ws) - 18)) t(s)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range(0, 20) r(i)),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

# A turn's header has 4 + name + 2 characters, its end 8; a marked character takes one more.
CHATS = r"""
WITH rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + 14 AS size FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {FOLDED} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
      FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""

_NUMBER = r"0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT
         ELSE reverse({_DIGITS})[i]::INT * 2 - CASE WHEN reverse({_DIGITS})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_MOVED = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
_MOD97 = f"""list_reduce([0] || list_transform(string_split({_MOVED}, ''), lambda c:
    CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::INT END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"""
_NEAR = "lower(substr(text, greatest(pos - 40, 0) + 1, least(pos, 40)))"
_CARD = r"[0-9]([\x20-]?[0-9])+"
#: kind, pattern, what a match must meet
_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(v, '{_NUMBER}\.{_NUMBER}\.{_NUMBER}\.{_NUMBER}')"),
    ("card", _CARD, f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", _MOD97),
    ("short_card", _CARD, f"length({_DIGITS}) = 13 AND {_LUHN} AND regexp_matches({_NEAR}, 'card|visa|credit|karte|carte|tarjeta')"),
    ("national_id", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
     f"NOT regexp_matches(CASE WHEN pos > 0 THEN substr(text, pos, 1) ELSE '' END || substr(text, pos + length(v) + 1, 1), '[0-9]') "
     f"AND regexp_matches({_NEAR}, 'ssn|social security|tax|national id')"),
)


def _spans(number: int, kind: str, pattern: str, rule: str) -> str:
    return f"""
SELECT doc_id, {number} AS k, '{kind}' AS kind, pos, pos + length(v) AS stop FROM (
    SELECT doc_id, text, m[i] AS v,
           (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) t(i))
WHERE {rule}"""


PERSONAL = ("WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS MATERIALIZED ("
            + " UNION ALL ".join(_spans(i, *r) for i, r in enumerate(_RULES)) + r""")
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip,
       count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, k) FILTER (WHERE k < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, k), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""")


# Eight hex digits as a number.
_GROUP = "list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', h[{0} + i]) - 1) * (16 ** (8 - i))::BIGINT))::BIGINT"
FILLED = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, u, len(u) AS n, {_GROUP.format(0)} % (len(u) + 1) AS x, {_GROUP.format(8)} % (len(u) + 1) AS y,
      {_GROUP.format(24)} % 100 < 50 AS spm, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
p AS (SELECT doc_id, t, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b,
      array_to_string(u[greatest(x, y) + 1:], '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
      FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

SQL = {"op2_substring_dedup": REPEATS, "op5_chat_formatting": CHATS, "op8_ngram_jaccard": COMPONENTS, "op10_pii": PERSONAL,
       "op11_fill_in_middle": FILLED, "op12_hard_negatives": NEGATIVES}
