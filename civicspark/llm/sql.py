"""DuckDB SQL for the queries that SQL can express. It imports nothing from the operators."""

from __future__ import annotations

_A, _Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _base32(hexadecimal: str) -> str:
    letters = []
    for k in range(8):
        part = f"CAST('0x' || substr({hexadecimal}, {5 * k + 1}, 5) AS INTEGER)"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


def _strength(level: str) -> str:
    """A row with the strength of the prior over the groups of ``level``."""
    return f"""(
  SELECT CASE WHEN coalesce(n, 0) = 0 OR g < 2 OR k = 0 OR k = n OR room <= 0 OR rho <= 0 THEN 10000.0
              ELSE least(10000.0, greatest(1.0, 1 / rho - 1)) END AS strength
  FROM (SELECT *, CASE WHEN k > 0 AND k < n AND room > 0 THEN ((kk - k / n * (k / n) * n) / (k / n * (1 - k / n)) - (g - 1)) / room END AS rho
        FROM (SELECT *, n - nn / n - (g - 1) AS room
              FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k,
                           sum(CAST(k AS DOUBLE) * k / n) AS kk, sum(CAST(n AS DOUBLE) * n) AS nn
                    FROM {level} WHERE n > 0))))"""


OP2 = f"""
WITH known AS (SELECT doc_id, max(CAST(quality > 0 AS INTEGER)) AS good FROM labels GROUP BY doc_id),
named AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_A}, {_Z}), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, string_split(host, '.') AS labels
  FROM named LEFT JOIN known ON page_id = doc_id GROUP BY host),
cut AS (
  SELECT *, CASE WHEN len(labels) >= 3 AND length(labels[-1]) = 2
                      AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
                 THEN labels[-2] || '.' || labels[-1] ELSE labels[-1] END AS suffix FROM hosts),
placed AS (
  SELECT *, CASE WHEN len(labels) > len(string_split(suffix, '.'))
                 THEN labels[len(labels) - len(string_split(suffix, '.'))] || '.' || suffix ELSE host END AS domain FROM cut),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM placed GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
everything AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 1.0 END AS mean FROM placed),
of_suffix AS (
  SELECT suffix, (k + strength * mean) / (n + strength) AS mean FROM suffixes, everything, {_strength('suffixes')}),
of_domain AS (
  SELECT domain, (k + strength * mean) / (n + strength) AS mean
  FROM domains JOIN of_suffix USING (suffix), {_strength('domains')}),
of_host AS (
  SELECT host, k + strength * mean AS a, n - k + strength * (1 - mean) AS b
  FROM placed JOIN of_domain USING (domain), {_strength('placed')}),
bounds AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM of_host),
rules(rule_host, rule_path, said) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, said FROM named JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
longest AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM fitting GROUP BY host, path)
SELECT page_id, n.host, n.path, rule, coalesce(said, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN bounds b ON n.host = b.host LEFT JOIN longest l ON n.host = l.host AND n.path = l.path"""

OP5 = f"""
WITH given AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hex FROM given)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32('hex')} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""

_WORD = r"[^\x20\x09-\x0D]+"


def _line_dedup(source: str, min_words: int) -> str:
    """CTEs over ``source`` (doc_id, text); the last, ``doomed``, has the lines to delete.

    Every two places of equal lines are paired; pairs that follow one another are a run found twice.
    """
    return f"""
lines AS (
  SELECT doc_id AS doc, line, said, len(regexp_extract_all(said, '{_WORD}')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS said,
               unnest(range(len(string_split(text, chr(10))))) AS line FROM {source})
  WHERE regexp_matches(said, '{_WORD}')),
twice AS (
  SELECT b.doc, b.line, b.words, a.doc AS first_doc, b.place - a.place AS shift,
         b.place - row_number() OVER (PARTITION BY b.doc, a.doc, b.place - a.place ORDER BY b.place) AS run
  FROM lines a JOIN lines b ON a.said = b.said AND (a.doc < b.doc OR (a.doc = b.doc AND a.place < b.place))),
doomed AS (
  SELECT DISTINCT doc, line FROM (
    SELECT *, sum(words) OVER (PARTITION BY doc, first_doc, shift, run) AS reached FROM twice) WHERE reached >= {min_words})"""


_LEFT = """
  SELECT d.doc_id, string_agg(d.said, chr(10) ORDER BY d.line) FILTER (WHERE z.doc IS NULL) AS text, count(z.doc) AS n_removed
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS said,
               unnest(range(len(string_split(text, chr(10))))) AS line FROM {source}) d
  LEFT JOIN doomed z ON z.doc = d.doc_id AND z.line = d.line GROUP BY d.doc_id"""

OP9 = f"""
WITH {_line_dedup('documents', 20)},
cleaned AS ({_LEFT.format(source='documents')})
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

OP12 = f"""
WITH held AS (SELECT doc_id, {_TERMS} FROM documents),
totals AS (SELECT count(DISTINCT doc_id) AS n, count(*) AS total FROM held),
sizes AS (SELECT doc_id, 10 + (90 * count(*) * any_value(n)) // any_value(total) AS m FROM held, totals GROUP BY doc_id),
postings AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""

OP13 = r"""
WITH given AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM given)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2, "op5_warc": OP5, "op9_line_dedup": OP9, "op12_lexical_search": OP12, "op13_exact_dedup": OP13}
