"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from kgspark.llm import licenses

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_WS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, {_WORD}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW.format('text')}, {_WORD}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) AS it FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(it), 0) AS n_items, sha256(coalesce(array_to_string(it, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least_ AS (SELECT p, min(doc_id) AS first_id FROM win GROUP BY p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM win JOIN least_ USING (p) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

LINES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
tri AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
norm AS (SELECT doc_id, source, trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS x FROM (SELECT doc_id, source, unnest(l) AS x FROM d)),
long AS (SELECT doc_id, source, x, len(string_split(x, ' ')) AS n FROM norm WHERE x <> ''),
often AS (SELECT source, x FROM long GROUP BY ALL HAVING count(DISTINCT doc_id) > 100),
lost AS (SELECT doc_id, sum(n) AS n FROM long JOIN often ON long.x = often.x AND long.source IS NOT DISTINCT FROM often.source GROUP BY doc_id),
dup AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n FROM d),
a AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  dup.n AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_removed <= 0.5 * n_words AS kept, n_removed FROM f"""

_MD = "('0x' || md5({0})[1:8])::BIGINT"


def _apportion(source: str, group: str, weight: str, seats: str, order: str, out: str) -> str:
    """Sainte-Lague seats as in ``mixing.apportion``."""
    return f"""
{out}_b AS (SELECT *, CAST(sum({weight}) OVER g AS DOUBLE) AS w_, count(*) OVER g AS n_ FROM {source} WINDOW g AS (PARTITION BY {group})),
{out}_g AS (SELECT *, CASE WHEN {seats} * 2 <= n_ THEN 0 WHEN w_ > 0 THEN CAST(floor({weight} * greatest({seats} - n_ / 2, 0) / w_ + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS got_ FROM {out}_b),
{out}_l AS (SELECT *, {seats} - sum(got_) OVER (PARTITION BY {group}) AS left_ FROM {out}_g),
{out}_o AS (SELECT *, unnest(range(0, CAST(greatest(CASE WHEN w_ > 0 THEN least(left_, ceil(n_ * {weight} / w_) + 1) ELSE 0 END, 0) AS BIGINT) + 1)) AS k_ FROM {out}_l),
{out}_q AS (SELECT *, CASE WHEN k_ > 0 THEN CAST({weight} AS DOUBLE) / (2 * (got_ + k_ - 1) + 1) END AS q_ FROM {out}_o),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q_ DESC NULLS LAST, {order}, k_) AS r_ FROM {out}_q),
{out} AS (SELECT {{cols}}, any_value(got_) + CAST(sum(CASE WHEN k_ > 0 AND r_ <= left_ AND q_ > 0 THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM {out}_r GROUP BY {{cols}})"""


_SRC = _apportion("seated", "one", "target", "seats", "source IS NULL, source", "quotas").replace("{cols}", "source, source_size, target")
_SHD = _apportion("shards", "source", "shard_size", "blocks", "shard", "shares").replace("{cols}", "source, shard, shard_size")

MIX = f"""
WITH rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))) AS key FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM sizes),
levels AS (SELECT *, (whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
capped AS (SELECT *, cap <= level * weight AS capped FROM levels),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM capped WHERE NOT capped ORDER BY cap / weight, source IS NULL, source LIMIT 1) * weight END AS target FROM capped),
seated AS (SELECT *, 1 AS one, CAST(floor(sum(target) OVER () / 16) AS BIGINT) AS seats FROM targets),
{_SRC},
dealt AS (SELECT rows_.*, q.source_size, q.target, q.quota AS blocks, CAST(('0x' || key[1:8]) AS BIGINT) % greatest(CAST(ceil(q.source_size / 1000000) AS BIGINT), 1) AS shard FROM rows_ JOIN quotas q ON rows_.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, blocks, CAST(sum(size) AS BIGINT) AS shard_size FROM dealt GROUP BY ALL),
{_SHD},
limited AS (SELECT source AS s2, shard AS n2, shard_size, least(quota, CAST(floor(shard_size * 3 / 16) AS BIGINT)) AS quota,
  {_MD.format("concat_ws(':', '42', coalesce(source, ''), CAST(shard AS VARCHAR))")} % greatest(CAST(floor(shard_size / 16) AS BIGINT), 1) * 16 AS a FROM shares),
placed AS (SELECT doc_id, source, size, source_size, target, shard, sum(size) OVER (PARTITION BY source, shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM dealt),
z AS (SELECT placed.*, stop - size AS first, a, shard_size, CASE WHEN shard_size > 0 THEN CAST(floor(quota * 16 / shard_size) AS BIGINT) ELSE 0 END AS epochs, a + quota * 16 - CASE WHEN shard_size > 0 THEN CAST(floor(quota * 16 / shard_size) AS BIGINT) ELSE 0 END * shard_size AS z
  FROM placed JOIN limited ON source IS NOT DISTINCT FROM s2 AND shard = n2)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(stop, z, shard_size) - greatest(first, a), 0) + greatest(least(stop, z - shard_size) - first, 0) AS BIGINT) AS taken FROM z"""

SQL = {"op3_decontaminate": DECONTAMINATE, "op4_licenses": licenses.SQL, "op5_mix": MIX, "op6_substrings": SUBSTRINGS, "op10_lines": LINES}
