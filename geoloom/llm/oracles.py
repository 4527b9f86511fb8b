"""DuckDB SQL of the queries of this subpackage that SQL can say over whole tables."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The table of CRC-32 (reflected polynomial 0xEDB88320) for each byte."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def crc32(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes."""
    step = f"xor(a >> 8, list_extract(CAST({_crc_table()} AS UBIGINT[]), CAST(xor(a, b) & 255 AS INTEGER) + 1))"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS UBIGINT)), lambda a, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


OP8 = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, p, array_to_string(w[p:p + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) t(p) WHERE len(w) >= 35),
rep AS (SELECT rid, p FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS MATERIALIZED (SELECT DISTINCT rid, p + i AS q FROM rep, range(35) r(i)),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM word ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

OP10 = f"""WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST({crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS MATERIALIZED (SELECT *, CAST(sum(size) OVER (ORDER BY h, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(sum(size) OVER () AS DOUBLE) AS total FROM s),
g AS (SELECT min(upto - size) AS a, max(upto) AS b FROM p GROUP BY h, text_crc32),
c AS (SELECT total * k / 24 AS even, total / 24 AS share FROM (SELECT DISTINCT total FROM p), range(1, 24) r(k)),
m AS (SELECT even, share, CASE WHEN a IS NULL THEN even WHEN even - a <= b - even THEN a ELSE b END AS near FROM c LEFT JOIN g ON a < even AND even < b),
cuts AS MATERIALIZED (SELECT CASE WHEN abs(near - even) <= 0.1 * share THEN near ELSE even END AS cut FROM m),
q AS (SELECT *, (SELECT count(*) FROM cuts WHERE cut <= upto - size / 2.0) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_FEATURES = "SELECT rid, array_to_string(w[p:p + n - 1], ' ') AS f FROM {0}, range(1, 4) s(n), unnest(range(1, len(w) - n + 2)) t(p) WHERE len(w) >= n"

OP12 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT row_number() OVER () AS rid, {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT rid, f, count(*) AS c FROM ({_FEATURES.format("d")}) GROUP BY ALL), bf AS MATERIALIZED (SELECT f, count(*) AS c FROM ({_FEATURES.format("b")}) GROUP BY f),
h AS MATERIALIZED (SELECT f, CAST({crc32("f")} % 10000 AS BIGINT) AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
n AS (SELECT k, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) r(k) LEFT JOIN (SELECT k, sum(c) AS s FROM df JOIN h USING (f) GROUP BY k) USING (k) LEFT JOIN (SELECT k, sum(c) AS t FROM bf JOIN h USING (f) GROUP BY k) USING (k)),
g AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n),
w AS (SELECT rid, sum(c) AS n_features, sum(c * gain) AS weight FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY rid),
z AS (SELECT doc_id, len(w) >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS x FROM d LEFT JOIN w USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((x + 0.5) / 4294967296))) AS BIGINT) AS score FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS r, 5 * count(*) FILTER (fit) OVER () // 100 AS most FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM o"""


def _lloyd(rounds: int) -> str:
    """SQL of codebooks after some rounds: ``b<round>`` holds (p, e, x), part, entry and components."""
    out = []
    for k in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
        out.append(f"a{k} AS MATERIALIZED (SELECT a.rid, a.p, any_value(a.x) AS x, min((CAST({far} AS BIGINT) * 64 + b.e)) AS m FROM parts a JOIN b{k} b USING (p) GROUP BY a.rid, a.p)")
        if k < rounds:
            mean = f"SELECT p, m % 64 AS e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (SELECT p, m % 64 AS m, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, m % 64, i) GROUP BY p, m"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(c.x, b.x) AS x FROM b{k} b LEFT JOIN ({mean}) c USING (p, e))")
    return ",\n".join(out)


OP13 = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS x FROM v, range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e, x FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id, x) <= 64),
{_lloyd(2)},
c AS (SELECT rid, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY rid),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (rid), s"""

ORACLES = {"op8_super_kmer_dedup": OP8, "op10_prefix_shards": OP10, "op12_importance_resampling": OP12, "op13_cover_tree_codes": OP13}
