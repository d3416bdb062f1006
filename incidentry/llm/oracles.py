"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import re

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = """
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
),
windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS run FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM split)
),
firsts AS (SELECT run, min(doc_id) AS earliest FROM windows GROUP BY run HAVING count(*) > 1),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (run) WHERE earliest < doc_id
),
gone AS (SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id),
kept AS (
    SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
           CASE WHEN places IS NULL THEN words
                ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda p: NOT list_contains(places, p[2])), lambda p: p[1]) END AS left_words
    FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept
"""

EXACT = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS normalised FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(normalised) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY normalised)
"""

# How pages name their canonical url or redirect, and the rules, longest first.
LINK_TAG, LINK_VALUE = r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>""", r"""(?is)\bhref\s*=\s*["'']?([^"''\s>]+)"""
META_TAG, META_VALUE = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>""", r"""(?is)\burl\s*=\s*["'']?([^"''\s>]+)"""
URL_RULES = [
    ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/", "block"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
    ("com", "/", "allow"),
]


def _rule(url: str, verdict: bool) -> str:
    arms = "".join(
        f" WHEN (host({url}) = '{host}' OR ends_with(host({url}), '.{host}')) AND starts_with(path({url}), '{path}') THEN '{said if verdict else host + path}'"
        for host, path, said in URL_RULES
    )
    return f"CASE{arms} END"


def _inlined(sql: str) -> str:
    """host(x), path(x) and node(x) written out."""
    small = f"translate(%s, '{CAPITALS}', '{SMALL}')"
    known = {
        "host": small % "coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '')",
        "path": "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')",
        "node": "CASE WHEN contains({0}, '://') THEN "
        + small % "regexp_extract(regexp_replace({0}, '(?s)#.*$', ''), '(?s)^(.*?://[^/?]*)', 1)"
        + " || regexp_replace(regexp_replace({0}, '(?s)#.*$', ''), '(?s)^.*?://[^/?]*', '') END",
    }
    for name, value in known.items():
        sql = re.sub(rf"\b{name}\((\w+)\)", lambda found: value.replace("{0}", found[1]), sql)
    return sql


URLS = _inlined(f"""
WITH RECURSIVE named AS (
    SELECT url, unnest([regexp_extract(regexp_extract(html, '{LINK_TAG}'), '{LINK_VALUE}', 1),
                        regexp_extract(regexp_extract(html, '{META_TAG}'), '{META_VALUE}', 1)]) AS raw
    FROM pages WHERE contains(url, '://')
),
links AS (SELECT url, replace(raw, '&amp;', '&') AS link FROM named WHERE raw <> ''),
ends AS (
    SELECT url, CASE WHEN contains(link, '://') THEN link
                     WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
                     WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link END AS target
    FROM links
),
ways AS (SELECT node(url) AS a, node(target) AS b FROM ends WHERE contains(target, '://')),
edges AS (SELECT a, b FROM ways UNION SELECT b, a FROM ways),
reach AS (SELECT a AS start, b AS reached FROM edges UNION SELECT start, b FROM reach JOIN edges ON reached = a),
said AS (
    SELECT start, bool_or({_rule('reached', True)} = 'allow') AS allowed, bool_or({_rule('reached', True)} = 'block') AS blocked
    FROM reach GROUP BY start
)
SELECT page_id, host(url) AS host, path(url) AS path, {_rule('url', False)} AS rule,
       coalesce({_rule('url', True)}, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN said ON start = node(url)
""")

# 20 bits of the digest, five hexadecimal digits, make four of the 32 characters
WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hash FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hash) AS first FROM hashed)
SELECT page_id,
       payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hash, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

ORACLES = {
    "op1_substrings": SUBSTRINGS,
    "op4_url_verdicts": URLS,
    "op5_exact_groups": EXACT,
    "op8_warc": WARC,
}
