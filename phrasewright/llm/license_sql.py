"""The result of op9_license_scans in DuckDB SQL."""

from __future__ import annotations

from .license_rules import rules
from .license_scans import REACH, keywords


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op9_sql() -> str:
    table = ", ".join(f"({r.order}, {_lit(r.label)}, {_lit(r.keyword)}, {_lit(r.also)}, {_lit(' (' + r.pattern + ') ')}, {r.priority}, {r.score}, {r.base})" for r in rules())
    gate = " (?:" + "|".join(keywords()) + ") "
    return f"""WITH rules AS (SELECT * FROM (VALUES {table}) r("order", label, keyword, also, pattern, priority, score, base)),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(' ' || trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') || ' ',
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS spaced FROM documents),
counted AS (SELECT rid, doc_id, spaced, CASE WHEN length(spaced) <= 2 THEN 0 ELSE length(spaced) - length(replace(spaced, ' ', '')) - 1 END::BIGINT AS n_words FROM d),
w AS (SELECT rid, string_split(trim(spaced, ' '), ' ') AS w FROM d WHERE regexp_matches(spaced, {_lit(gate)})),
each_ AS (SELECT rid, w, unnest(w) AS kw, unnest(range(len(w))) AS i FROM w),
contexts AS (SELECT rid, i, kw, ' ' || array_to_string(w[greatest(i - {REACH}, 0) + 1 : i], ' ') || ' @' || kw || ' ' || array_to_string(w[i + 2 : i + 1 + {REACH}], ' ') || ' ' AS around
 FROM each_ WHERE kw IN (SELECT keyword FROM rules)),
met AS (SELECT c.rid, c.i, r.*, regexp_extract(c.around, r.pattern, 1) AS m FROM contexts c JOIN rules r ON c.kw = r.keyword
 WHERE r.also = '' OR contains(c.around, ' ' || r.also || ' ') OR contains(c.around, '@' || r.also || ' ')),
placed AS (SELECT *, i - (length(string_split(m, '@')[1]) - length(replace(string_split(m, '@')[1], ' ', ''))) AS s FROM met WHERE m <> ''),
found AS (SELECT DISTINCT rid, s, s + length(m) - length(replace(m, ' ', '')) + 1 AS e, "order", label, priority, score, base FROM placed),
kept AS (SELECT * FROM found a WHERE base OR NOT EXISTS (SELECT 1 FROM found b WHERE b.rid = a.rid AND b.s <= a.s AND b.e >= a.e AND (b.priority > a.priority OR (b.priority = a.priority
 AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b."order" < a."order")))))),
lists AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(1 - product(1 - score::DOUBLE), 9) AS score FROM kept GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 coalesce(score, 0.0)::DOUBLE AS score FROM counted LEFT JOIN lists USING (rid)"""
