"""The result of op5_secret_scans in DuckDB SQL."""

from __future__ import annotations

from .secret_scans import ANCHORS, BASE, KINDS, PATTERNS, SCOPE


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(kind: str) -> str:
    p = _lit(PATTERNS[kind])
    ok = {
        "assign": f"length(regexp_extract(x, {p}, 2)) >= 6", "access": "length(x) >= 20", "login": f"length(regexp_extract(x, {p}, 2)) >= 3",
        "random": "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')",
    }.get(kind, "true")
    return f"""SELECT rid, {KINDS.index(kind)} AS kind, x, gap, i, {ok} AS ok FROM (
 SELECT rid, unnest(ms) AS x, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
  SELECT rid, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d WHERE anchored))"""


def op5_sql() -> str:
    k = {name: i for i, name in enumerate(KINDS)}
    names = ", ".join(_lit(x) for x in KINDS)
    anchored = _lit("|".join(PATTERNS[x] for x in ANCHORS))
    strong = f"kind < {len(BASE)}"
    shown = f"([{names}])[kind + 1] || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), {anchored}) AS anchored FROM documents),
m AS ({' UNION ALL '.join(map(_found, KINDS))}),
placed AS (SELECT rid, kind, x, ok, sum(length(gap) + length(x)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM m),
parts AS (SELECT rid, kind, (e - length(x))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE ok),
strong AS (SELECT * FROM parts WHERE {strong}),
weak AS (SELECT * FROM parts w WHERE NOT {strong} AND NOT (kind = {k['random']} AND EXISTS (
 SELECT 1 FROM strong q WHERE q.rid = w.rid AND (w.s BETWEEN q.s AND q.e OR (q.s >= w.s AND q.s < w.e))))),
met AS (SELECT w.rid, w.kind, w.s, w.e, bool_or(q.kind IN ({k['access']}, {k['login']})) AS identifier, bool_or(q.kind IN ({k['assign']}, {k['hex']}, {k['random']})) AS secret
 FROM weak w JOIN (SELECT * FROM strong UNION ALL SELECT * FROM weak) q ON q.rid = w.rid AND w.s BETWEEN q.s - {SCOPE} AND q.e + {SCOPE} AND (w.kind <> q.kind OR w.s <> q.s)
 GROUP BY w.rid, w.kind, w.s, w.e),
spans AS (SELECT * FROM strong UNION ALL SELECT rid, kind, s, e FROM met WHERE CASE kind WHEN {k['login']} THEN secret WHEN {k['random']} THEN identifier ELSE identifier AND secret END),
lists AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{x}" for i, x in enumerate(BASE))},
 coalesce(string_agg({shown}, ',' ORDER BY s, kind, e) FILTER ({strong}), '') AS base, string_agg({shown}, ',' ORDER BY s, kind, e) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (rid)"""
