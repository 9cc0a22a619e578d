"""SQL next to the queries that SQL can express, written on its own."""

from __future__ import annotations

_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sets(text: str, pattern: str, size: int) -> str:
    """List of the distinct shingles of a text; fewer words are one."""
    return f"""
        SELECT *, CASE WHEN len(w) >= {size}
            THEN list_distinct([array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size} + 2)])
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS w FROM source)"""


OP1 = f"""
WITH RECURSIVE source AS (SELECT doc_id, {_ASCII.format("coalesce(text, '')")} AS t FROM documents),
sets AS MATERIALIZED ({_shingle_sets("t", r"[^\x20\x09-\x0D]+", 3)}),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP2 = f"""
WITH docs AS (
    SELECT * FROM (WITH source AS (SELECT doc_id, {_ASCII.format("coalesce(text, '')")} AS t FROM documents)
    {_shingle_sets("t", r"[0-9a-z\x{80}-\x{10FFFF}]+", 5)})),
items AS (
    SELECT * FROM (WITH source AS (SELECT item_id, {_ASCII.format("coalesce(text, '')")} AS t FROM benchmark)
    {_shingle_sets("t", r"[0-9a-z\x{80}-\x{10FFFF}]+", 5)}))
SELECT d.doc_id, i.item_id, i.n AS n_shingles, count(*)::INT AS n_shared
FROM (SELECT doc_id, unnest(s) AS g FROM docs) d
JOIN (SELECT item_id, len(s)::INT AS n, unnest(s) AS g FROM items) i USING (g)
GROUP BY d.doc_id, i.item_id, i.n HAVING count(*) >= 0.8 * i.n
"""

OP3 = r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sizes GROUP BY source),
capped AS (
    SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
-- sources fill up in the order of cap by weight; the first level that caps none of the rest holds
levels AS (
    SELECT *, coalesce(sum(cap) OVER ahead, 0) AS used, sum(w) OVER rest AS open,
        1.5 * sum(source_size) OVER () AS pool
    FROM capped
    WINDOW ahead AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           rest AS (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT arg_min((pool - used) / open, cap / w) FILTER ((pool - used) / open < cap / w) AS v FROM levels),
targets AS (SELECT rank, source, source_size, least(cap, w * v)::DOUBLE AS target FROM capped, level),
frame AS (SELECT greatest(1, ceil(sum(target) / 2097152))::BIGINT AS block, sum(target) AS pool FROM targets),
parts AS (
    SELECT t.*, sum(target) OVER (ORDER BY rank) / pool AS upto, coalesce(sum(target) OVER
        (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / pool AS since,
        rank = max(rank) OVER () AS last, (source_size + block - 1) // block AS blocks
    FROM targets t, frame WHERE target > 0),
slots AS (
    SELECT p.rank, p.blocks, row_number() OVER (PARTITION BY p.rank ORDER BY i) - 1 AS turn
    FROM (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS x
          FROM (SELECT unnest(range(ceil(pool / block)::BIGINT)) AS i FROM frame)) s
    JOIN parts p ON s.x >= p.since AND (s.x < p.upto OR p.last)),
times AS (
    SELECT rank, turn % blocks AS b, count(*) AS n FROM slots WHERE turn < 2 * blocks GROUP BY ALL),
streams AS (
    SELECT s.*, t.rank, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY t.rank
        ORDER BY ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE size > 0),
pieces AS (
    SELECT s.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS b FROM streams s, frame)
SELECT doc_id, size, source_size, target,
    coalesce(sum((least((b + 1) * block, start + size) - greatest(b * block, start)) * n), 0)::BIGINT AS taken, source
FROM pieces LEFT JOIN times USING (rank, b)
GROUP BY doc_id, size, source_size, target, source, rank, start
UNION ALL
SELECT doc_id, size, source_size, target, 0, s.source
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE size = 0
"""

OP5 = """
WITH crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS n)),
sized AS (
    SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
        CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295,
            list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) END AS text_crc32
    FROM documents, crc_table),
summed AS (
    SELECT *, sum(size) OVER () AS total, sum(size) OVER w - size AS before, row_number() OVER w AS place
    FROM sized
    WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""

OP6 = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS h FROM pages),
parts AS (
    SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '<[a-z/][^>]*\z', ''), '\s+', ' ', 'g'))), lambda x: x <> '') AS b
    FROM body),
texts AS (
    SELECT page_id, url,
        regexp_replace(replace(array_to_string(b, chr(10) || chr(10)), '&quot;', '"'), '&amp;?', '&', 'g') AS text
    FROM parts)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

OP9 = """
WITH full_pages AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS f FROM full_pages)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id < f THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < f THEN f END AS refers_to
FROM firsts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1,
        "op2_leaks": OP2,
        "op3_mix": OP3,
        "op5_shards": OP5,
        "op6_main_text": OP6,
        "op9_warc": OP9,
    }
