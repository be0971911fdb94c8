"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

#: (kind, expression, group, its least number of characters): fixed values of the scan, then those of the kinds beyond them.
SECRETS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("bearer", r"[bB][eE][aA][rR][eE][rR]\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
    ("url_login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 3),
    ("hook", r"hooks\.[a-z]+\.com/services/([A-Za-z0-9/_-]+)", 1, 20),
)
WS = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> '')"


def _grams(size: int) -> str:
    """Shingles of the word list ws, as strings; the whole list if it is shorter."""
    return f"""CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' ')) END"""


NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(LOWER)} AS ws FROM documents),
g AS (SELECT doc_id, len(ws) AS n_words, list_distinct({_grams(4)}) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM g),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""

REPEATS = f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS x FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS rn FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE rn > 1),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT word.doc_id, word.i, word.x FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM kept GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""

LEAKS = f"""WITH w AS (SELECT doc_id, {_words(LOWER)} AS ws FROM documents), v AS (SELECT item_id, {_words(LOWER)} AS ws FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({_grams(5)})) AS x FROM w WHERE len(ws) >= 5),
i AS (SELECT item_id, list_distinct({_grams(5)}) AS s FROM v WHERE len(ws) >= 5),
u AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM i)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared FROM d JOIN u USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(h, {5 * b + 1}, 5)) AS BIGINT) // {32 ** (3 - c)} % 32, 1)" for b in range(8) for c in range(4)
)
WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""


def _secrets() -> str:
    parts = []
    for k, (kind, pattern, group, least) in enumerate(SECRETS):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {k} AS ord, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s,
 unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x))) AS size, {least} AS least
 FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}', {group}) AS g FROM d)"""
        )
    rows = " UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({rows}), k AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM f WHERE size >= least),
a AS (SELECT doc_id, count_if(ord = 0) AS n_assign, count_if(ord = 1) AS n_access, count_if(ord = 2) AS n_hex, string_agg(x, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(x, ',' ORDER BY s, ord) AS spans FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


SQL = {
    "op2_ngram_jaccard_join": NEAR,
    "op6_repeated_passages": REPEATS,
    "op7_warc": WARC,
    "op8_decontaminate": LEAKS,
    "op10_secret_scans": _secrets(),
}
