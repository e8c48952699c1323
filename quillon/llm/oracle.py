"""DuckDB SQL for the rows of the queries that SQL can express, straight from their definitions and without their methods."""

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
items AS (SELECT item_id, {_TERMS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
lengths AS (SELECT DISTINCT least(len(ws), 13) AS n FROM items WHERE len(ws) > 0),
phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[k : k + n - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS k FROM items WHERE len(ws) > 0)
),
windows AS (
  SELECT r, n, k, array_to_string(ws[k : k + n - 1], ' ') AS phrase FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM docs, lengths WHERE len(ws) >= n)
),
met AS (SELECT r, k, n, item_id FROM windows JOIN phrases USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM met) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS of FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY r
),
places AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM docs),
counts AS (SELECT w, count(*) AS c FROM places GROUP BY w),
terms AS (SELECT DISTINCT item_id, unnest(ws) AS w FROM items),
rare AS (SELECT item_id, arg_min(w, (coalesce(c, 0), w)) AS w, count(*) AS n_terms FROM terms LEFT JOIN counts USING (w) GROUP BY item_id),
close AS (
  SELECT r, item_id FROM (
    SELECT a.r, a.k, rare.item_id, any_value(n_terms) AS n_terms, count(DISTINCT b.w) AS there
    FROM rare JOIN places a ON a.w = rare.w JOIN terms t ON t.item_id = rare.item_id JOIN places b ON b.r = a.r AND b.w = t.w AND b.k BETWEEN a.k - 64 AND a.k + 64
    GROUP BY a.r, a.k, rare.item_id
  ) WHERE there = n_terms
),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM close GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(of, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r) LEFT JOIN near USING (r)
"""


def _ranks() -> str:
    """Ranks of the byte strings of 1, 2, 4 .. 256 and 400 bytes at each place; equal ranks are equal strings."""
    out, of = [], "bytes"
    for n, step in [(2 * n, n) for n in (1, 2, 4, 8, 16, 32, 64, 128)] + [(400, 144)]:
        out.append(f"pairs{n} AS (SELECT r, k, x, lead(x, {step}) OVER (PARTITION BY r ORDER BY k) AS y FROM {of})")
        out.append(f"ranks{n} AS (SELECT r, k, dense_rank() OVER (ORDER BY x, y) AS x FROM pairs{n} WHERE y IS NOT NULL)")
        of = f"ranks{n}"
    return ",\n".join(out)


OP6_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, regexp_extract_all(h, '..') AS bs FROM docs),
bytes AS (SELECT r, unnest(range(len(bs))) AS k, unnest(bs) AS x FROM parts),
{_ranks()},
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY x) AS c FROM ranks400) WHERE c > 1),
covered AS (
  SELECT r, k, x, coalesce(k - max(again.k) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 400, false) AS gone
  FROM bytes LEFT JOIN again USING (r, k)
),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY k), false) AS begins FROM covered),
results AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY k) FILTER (NOT gone) AS kept FROM runs GROUP BY r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN results USING (r)
"""

OP9_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT r, doc_id, array_to_string(ws[k : k + 2], ' ') AS s
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM docs WHERE len(ws) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (
  SELECT a.r AS ra, b.r AS rb, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.r, b.r
),
links AS (
  SELECT DISTINCT a, b FROM common JOIN sizes x ON x.r = ra JOIN sizes y ON y.r = rb WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT u AS doc_id, u AS low FROM edges UNION SELECT v, low FROM reach JOIN edges ON u = doc_id),
lows AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, docs.doc_id) AS component_id, coalesce(docs.doc_id = coalesce(low, docs.doc_id), true) AS kept
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN lows ON lows.doc_id = docs.doc_id
"""

OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
windows AS (SELECT r, doc_id, k, array_to_string(ws[k : k + 49], ' ') AS s FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM docs WHERE len(ws) > 49)),
later AS (SELECT r, k FROM (SELECT r, k, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE doc_id > least),
places AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM docs),
covered AS (
  SELECT r, k, w, coalesce(k - max(later.k) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 50, false) AS gone
  FROM places LEFT JOIN later USING (r, k)
),
results AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM covered GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN results USING (r)
"""

SQL = {"op4_benchmark_decontamination": OP4_SQL, "op6_suffix_array_dedup": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL}
