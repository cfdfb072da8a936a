"""DuckDB equivalents of the document queries, built from shared CTEs.

Sentence ends are decided here from token windows, not from look-behinds as in Spark, so the
two sides check each other.
"""

from __future__ import annotations

import re

from folioflow.functions.segment import ABBREVIATIONS, LONGEST

_WORDS = ", ".join(f"'{w}'" for w in ABBREVIATIONS)

#: One row per paragraph or run of line breaks of ``source(id, text)``.
PAR = """
par AS (
  SELECT id, unnest(range(len(ps))) AS par_no, unnest(ps) AS p
  FROM (SELECT id, regexp_extract_all(coalesce(text, ''), '[\\r\\n]+|[^\\r\\n]+') AS ps FROM source))"""

_SPANS = f"""
tok AS (
  SELECT id, par_no, unnest(range(len(ts))) AS k, unnest(ts) AS t, p
  FROM (SELECT *, regexp_extract_all(p, '[^.!?…।॥]*(?:[.!?…]+["''”’)\\]»]*|[।॥]+["''”’)\\]]*)|[^.!?…।॥]+') AS ts FROM par WHERE NOT regexp_matches(p, '^[\\r\\n]'))),
pos AS (
  SELECT *, (sum(length(t)) OVER (PARTITION BY id, par_no ORDER BY k))::BIGINT AS e, regexp_extract(t, '([.!?…]+["''”’)\\]»]*|[।॥]+["''”’)\\]]*)$') AS run FROM tok),
side AS (
  SELECT *, substring(p, 1, e - length(run)) AS before, substring(p, e + 1) AS after FROM pos),
word AS (
  SELECT *, lower(regexp_extract(before, '[^\\s\\x1c-\\x1f(\\["'']*$')) AS w,
    regexp_matches(after, '^[\\s\\x1c-\\x1f]*$') OR regexp_matches(after, '^[\\s\\x1c-\\x1f]*["''“‘(\\[«ऀ-ॿ\\p{{Nd}}A-ZÀ-Þ]') AS fresh FROM side),
cut AS (
  SELECT *, CASE
    WHEN run = '' THEN false
    WHEN regexp_matches(run, '^[।॥]') THEN true
    WHEN after <> '' AND NOT regexp_matches(after, '^[\\s\\x1c-\\x1f]') THEN false
    WHEN substring(run, 1, 1) <> '.' THEN true
    WHEN regexp_matches(before, '\\p{{Nd}}$') THEN fresh
    WHEN regexp_matches(before, '(^|[\\s\\x1c-\\x1f(\\["''])[A-ZÀ-Þ]$') THEN false
    WHEN trim(w, '.') IN ({_WORDS}) THEN false
    WHEN regexp_full_match(trim(w, '.'), '([\\p{{L}}\\p{{N}}_]\\.)+[\\p{{L}}\\p{{N}}_]') THEN false
    ELSE fresh END AS boundary FROM word),
sid AS (
  SELECT *, coalesce(sum(boundary::INT) OVER (PARTITION BY id, par_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM cut),
span AS (
  SELECT id, par_no, sid, string_agg(t, '' ORDER BY k) AS s FROM sid GROUP BY id, par_no, sid),
trimmed AS (
  SELECT *, regexp_extract(s, '^[\\s\\x1c-\\x1f]*') AS lead, CASE WHEN regexp_matches(s, '^[\\s\\x1c-\\x1f]*$') THEN '' ELSE regexp_extract(s, '[\\s\\x1c-\\x1f]*$') END AS tail FROM span),
cored AS (
  SELECT *, substring(s, length(lead) + 1, length(s) - length(lead) - length(tail)) AS core FROM trimmed)"""

# Greedy packing as folds over structs of finished chunks and the open one.
_WORD_FOLD = """list_reduce([{'c': []::VARCHAR[], 'cur': '', 'f': true}] || [{'c': []::VARCHAR[], 'cur': w, 'f': false} FOR w IN string_split(cl_.cur, ' ')],
  lambda st_, wd_: CASE WHEN length(wd_.cur) > LIM
    THEN {'c': CASE WHEN st_.cur <> '' THEN st_.c || [st_.cur, ' '] WHEN NOT st_.f THEN st_.c || [' '] ELSE st_.c END || [substring(wd_.cur, i, LIM) FOR i IN range(1, length(wd_.cur) + 1, LIM)], 'cur': '', 'f': false}
    WHEN st_.cur <> '' AND length(st_.cur) + length(wd_.cur) + 1 > LIM THEN {'c': st_.c || [st_.cur, ' '], 'cur': wd_.cur, 'f': false}
    WHEN st_.cur <> '' THEN {'c': st_.c, 'cur': st_.cur || ' ' || wd_.cur, 'f': false}
    ELSE {'c': CASE WHEN st_.f THEN st_.c ELSE st_.c || [' '] END, 'cur': wd_.cur, 'f': false} END)"""
_FOLD = f"""list_reduce([{{'c': []::VARCHAR[], 'cur': '', 'f': true}}] || [{{'c': []::VARCHAR[], 'cur': x, 'f': false}} FOR x IN regexp_extract_all(core, '[^;,।]*[;,।]|[^;,।]+')],
  lambda ac_, cl_: CASE WHEN length(cl_.cur) > LIM THEN {{'c': ac_.c || [ac_.cur] || ({_WORD_FOLD}).c || [({_WORD_FOLD}).cur], 'cur': '', 'f': false}}
    WHEN ac_.cur <> '' AND length(ac_.cur) + length(cl_.cur) > LIM THEN {{'c': ac_.c || [ac_.cur], 'cur': cl_.cur, 'f': false}}
    ELSE {{'c': ac_.c, 'cur': ac_.cur || cl_.cur, 'f': false}} END)"""


def pieces(source: str, limit: int = LONGEST, suffix: str = "") -> str:
    """CTEs up to ``piece(id, pos, text, translatable)`` over a query giving (id, text).

    With a suffix all names end in it, so that a second pass can follow the first.
    """
    fold = _FOLD.replace("LIM", str(limit))
    sql = f"""source AS (@SOURCE@),{PAR},{_SPANS},
chunk AS (
  SELECT id, par_no, sid, lead, tail, CASE WHEN core = '' THEN []::VARCHAR[] WHEN length(core) <= {limit} THEN [core]
    ELSE list_filter(({fold}).c || [({fold}).cur], lambda z: z <> '') END AS parts FROM cored),
listed AS (
  SELECT id, par_no, sid, CASE WHEN lead = '' THEN [] ELSE [{{'text': lead, 'translatable': false}}] END
    || [{{'text': z, 'translatable': z <> ' '}} FOR z IN parts]
    || CASE WHEN tail = '' THEN [] ELSE [{{'text': tail, 'translatable': false}}] END AS ps FROM chunk
  UNION ALL SELECT id, par_no, 0, [{{'text': p, 'translatable': false}}] FROM par WHERE regexp_matches(p, '^[\\r\\n]')),
flat AS (
  SELECT id, par_no, sid, unnest(range(len(ps))) AS j, unnest(ps) AS x FROM listed),
piece AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY par_no, sid, j) - 1 AS pos, x.text AS text, x.translatable AS translatable FROM flat)"""
    if suffix:
        names = "|".join(re.findall(r"(\w+) AS \(", sql))
        sql = re.sub(rf"\b({names})(?= AS \()|(?<=FROM )({names})\b", lambda m: m[0] + suffix, sql)
    return sql.replace("@SOURCE@", source)
