"""DuckDB SQL for the queries that SQL can express.

There is none for the classifier (2), the page text (4), and for what needs
XXH64 (7, 10): these are tested against plain Python.
"""

from __future__ import annotations

from lineaframe.llm import license_scan, pii
from lineaframe.llm.queries import URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = license_scan.WORD


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
       FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

#: The patterns as SQL writes them; the spans found are the same, as only the ways to find them in linear time differ.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) <= 255))"),
    "card": (r"[0-9]([ -]?[0-9])+", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {luhn}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    "iban": (pii.IBAN.replace("\\x20", " "), "{mod97}"),
    "ssn": (pii.SSN, "NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')"),
}
_LUHN = """(list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''),
  lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 - CASE WHEN CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
_MOD97 = """(list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
  lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END, 0) = 1)"""


def _pii_spans() -> str:
    parts = []
    for n, (kind, (pattern, test)) in enumerate(_PII.items()):
        ok = test.format(luhn=_LUHN, mod97=_MOD97) if "{" in test and kind in ("card", "iban") else test
        score = f"{pii.SCORES[kind]} + CASE WHEN regexp_matches(replace(lower(substr(t, greatest(1, e - length(v) + 1 - {pii.REACH}), least(e - length(v), {pii.REACH}) + length(v) + {pii.REACH})), lower(v), ' '), '{pii.NEARBY[kind]}') THEN {pii.NEARBY_ADDS[kind]} ELSE 0 END"
        keep = f" AND round({score}, 2) >= {pii.ACCEPT}" if kind in pii.ADDED_KINDS else ""
        parts.append(
            f"""SELECT r, {n} AS k, '{kind}' AS kind, e - length(v) AS s, e FROM (
  SELECT r, t, m[i] AS v, CAST(list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) AS e
  FROM (SELECT r, t, m, p, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {ok}{keep}"""
        )
    return "\nUNION ALL\n".join(parts)


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_pii_spans()}),
listed AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in pii.BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""


def _rule_case(column: str) -> str:
    cases = []
    for r in sorted(URL_RULES, key=lambda r: -len(r.name)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        cases.append(f"WHEN {fits} THEN '{r.name if column == 'rule' else r.verdict}'")
    return f"CASE {' '.join(cases)} ELSE {'NULL' if column == 'rule' else chr(39) + 'allow' + chr(39)} END AS {column}"


OP5 = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
SELECT page_id, host, path, {_rule_case('rule')}, {_rule_case('verdict')} FROM p
"""


def _grams() -> str:
    rows = []
    for number, label, base, grams, length, at, *ws in license_scan.template_rows(license_scan.BASE + license_scan.NOTICES):
        text = " ".join(w for w in ws if w)
        rows.append(f"({number}, '{label}', {base}, {grams}, {length}, {at}, '{text}')")
    return ", ".join(rows)


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
t(template, label, base, grams, length, place, gram) AS (VALUES {_grams()}),
dw AS (SELECT r, i - 1 AS pos, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (VALUES (2), (3)) AS ks(k) WHERE len(w) >= k)),
hits AS (SELECT r, template, label, base, grams, length, place, pos, pos - place AS diagonal
  FROM dw JOIN t ON t.gram = dw.gram AND least(3, t.length) = dw.k),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN base THEN 0 ELSE {license_scan.SLACK} END THEN 0 ELSE 1 END AS apart
  FROM hits WINDOW w AS (PARTITION BY r, template ORDER BY diagonal, pos)),
islands AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT r, label, base, min(pos) AS s, max(pos) + least(3, length) AS e, round(count(DISTINCT place) / grams, 4) AS score
  FROM islands GROUP BY r, template, label, base, grams, length, island
  HAVING CASE WHEN base THEN count(DISTINCT place) = grams ELSE round(count(DISTINCT place) / grams, 4) >= {license_scan.COVERAGE}
    AND max(pos) + least(3, length) - min(pos) <= length * {license_scan.STRETCH} END),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
shared AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM g JOIN shared USING (h)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS apart FROM hit),
islands AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT doc_id, min(i) - 1 AS s, max(i) + 49 AS e FROM islands GROUP BY doc_id, island),
found AS (SELECT doc_id, sum(e - s) AS n, count(*) AS k, string_agg(s || ':' || e, ',' ORDER BY s) AS passages FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, CAST(coalesce(k, 0) AS BIGINT) AS n_passages,
  coalesce(passages, '') AS passages
FROM d LEFT JOIN found USING (doc_id)
"""

OP9 = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS source_size, [5.0, 2.0, 1.0][CAST((turn - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS clamp, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(weight * max(level) OVER (), clamp) AS target FROM l)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(least(2 * size, floor(size * CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END
    + CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op3_pii": OP3,
    "op5_url_filter": OP5,
    "op6_license": OP6,
    "op8_suffix_dedup": OP8,
    "op9_mixing": OP9,
}
