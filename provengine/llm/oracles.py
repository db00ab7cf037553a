"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x20\\x09-\\x0D]+"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE array_to_string(ws, ' ') END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.least, d.doc_id) AS component_id, coalesce(k.links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, count(*) AS links FROM link GROUP BY x) k ON k.x = d.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

_ESCAPED = "replace(replace(coalesce({0}, ''), '\\', '\\\\'), '<|', '<\\|')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || {_ESCAPED.format('role')} || '<|text|>' || {_ESCAPED.format('text')} || '<|end|>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_left,
       sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, row_number() OVER (ORDER BY cap / weight, rank) AS place FROM s1),
f AS (SELECT min(place) AS place, arg_min(open_left, place) AS open_left, arg_min(open_weight, place) AS open_weight FROM s2 WHERE open_left * weight <= cap * open_weight),
s3 AS (SELECT rank, source, source_size, CASE WHEN f.place IS NULL OR s2.place < f.place THEN CAST(cap AS DOUBLE) ELSE CAST(f.open_left AS DOUBLE) * weight / CAST(f.open_weight AS DOUBLE) END AS target,
       greatest(1, (min(source_size) FILTER (source_size > 0) OVER ()) // 1024) AS block, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s2, f),
s4 AS (SELECT *, (source_size + block - 1) // block AS own, greatest(block, (source_size + 4095) // 4096) AS wide FROM s3),
won AS (SELECT rank, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS won, total // block AS house FROM (SELECT *, unnest(range(0, 3 * own)) AS k FROM s4)),
seat AS (SELECT rank, k, min(r.shard) AS shard FROM won, range(0, 16) AS r(shard) WHERE won <= house * (r.shard + 1) // 16 GROUP BY rank, k),
q AS (SELECT s4.rank, r.shard, count(seat.k) AS quota FROM s4 CROSS JOIN range(0, 16) AS r(shard) LEFT JOIN seat ON seat.rank = s4.rank AND seat.shard = r.shard GROUP BY ALL),
s5 AS (SELECT s4.*, CAST(t.quota AS BIGINT) AS quota, t.shard_quotas FROM s4 JOIN (SELECT rank, sum(quota) AS quota, string_agg(CAST(quota AS VARCHAR), ',' ORDER BY shard) AS shard_quotas FROM q GROUP BY rank) t ON t.rank = s4.rank),
cut AS (SELECT rank, shard, high, lag(high, 1, 0) OVER (PARTITION BY rank ORDER BY shard) AS low FROM (
        SELECT q.rank, q.shard, CAST(least(block * sum(q.quota) OVER (PARTITION BY q.rank ORDER BY q.shard), 3 * source_size) AS BIGINT) AS high FROM q JOIN s4 ON s4.rank = q.rank)),
piece AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY md5('7' || chr(31) || coalesce(source, '') || chr(31) || b), b) - size AS BIGINT) AS line
          FROM (SELECT rank, source, source_size, wide, b, least(wide, source_size - b * wide) AS size FROM (SELECT *, unnest(range(0, (source_size + wide - 1) // wide)) AS b FROM s4))),
chosen AS (SELECT x.rank, b, b * wide + greatest(low - begins, 0) AS low, b * wide + least(high - begins, size) AS high
           FROM (SELECT *, line + r.time * source_size AS begins FROM piece, range(0, 3) AS r(time)) x JOIN cut ON cut.rank = x.rank AND low < begins + size AND high > begins),
p AS (SELECT d.doc_id, d.size, s5.*, CAST(sum(d.size) OVER (PARTITION BY s5.rank ORDER BY md5('7' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), '') || chr(31) || d.size), d.doc_id, d.size) - d.size AS BIGINT) AS pos
      FROM d JOIN s5 ON s5.source IS NOT DISTINCT FROM d.source),
spread AS (SELECT doc_id, rank, pos, size, unnest(range(pos // wide, (pos + size - 1) // wide + 1)) AS b FROM p WHERE size > 0),
t AS (SELECT doc_id, CAST(sum(greatest(0, least(pos + size, high) - greatest(pos, low))) AS BIGINT) AS taken FROM spread JOIN chosen ON chosen.rank = spread.rank AND chosen.b = spread.b GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, source, quota, shard_quotas, coalesce(taken, 0) AS taken FROM p LEFT JOIN t ON t.doc_id = p.doc_id
"""

_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_GAP}'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '{_GAP}'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
hit AS (SELECT spots.doc_id, spots.n, spots.i, win.item_id FROM spots JOIN win ON win.n = spots.n AND win.w = spots.w),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""
