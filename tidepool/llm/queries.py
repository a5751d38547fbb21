"""The queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, extract, language, lexical, maxscore, merkle, mixing, quantise, secrets, sharding, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.report(_table(spark, sf_dir, "embeddings"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.identify(docs, language.learn(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.report(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_table(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_maxscore, op3_substrings, op4_language, op5_extract, op6_mixing, op7_chat, op8_secrets, op9_sharding, op10_decontaminate,
        op11_quantise, op12_lexical, op13_merkle,
    )
}


#: Levels in the SQL of op13: 16 million documents of a language, 512 languages.
LEAF_LEVELS, TOP_LEVELS = 8, 3


def _tree_sql(tree: str, source: str, key: str, order: str, steps: int) -> list[str]:
    """Tables {tree}0 to {tree}<steps>, the levels of trees by key k: r, the c nodes of the level, h,
    and x and y, the hashes of a node's run before and behind it."""
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY k, r // 8 ORDER BY r ROWS BETWEEN {}), '')".format
    around = f"{side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS x, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS y"
    lowest = f"SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS c FROM {source}"
    up = "SELECT k, r // 8 AS r, (any_value(c) + 7) // 8 AS c, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {} GROUP BY k, r // 8"
    return [f"{tree}{i} AS (SELECT *, {around} FROM ({up.format(f'{tree}{i - 1}') if i else lowest}))" for i in range(steps + 1)]


def _merkle_sql() -> str:
    levels = [("l", i) for i in range(LEAF_LEVELS)] + [("t", i) for i in range(TOP_LEVELS)]
    sides = ", ".join(f"{t}{i}.x AS x{n}, {t}{i}.y AS y{n}, {t}{i}.c > 1 AS up{n}" for n, (t, i) in enumerate(levels))
    joins = " ".join(f"JOIN {t}{i} ON {t}{i}.r = {'l0' if t == 'l' else 't0'}.r // {8**i}" + (f" AND {t}{i}.k = l0.k" if t == "l" else "") for t, i in levels if i)
    path = " || ".join(f"CASE WHEN up{n} THEN x{n} || y{n} ELSE '' END" for n in range(len(levels)))
    folds = [f"f{n + 1} AS (SELECT * EXCLUDE (shown), CASE WHEN up{n} THEN sha256(x{n} || shown || y{n}) ELSE shown END AS shown FROM f{n})" for n in range(len(levels))]
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')".format
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    low = "(CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)"
    tables = [
        "crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))",
        "d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM documents, crc)",
        f"h AS (SELECT doc_id, coalesce('+' || lang, '') AS own, {leaf('text')} AS h, {leaf(low)} AS shown FROM d)",
        *_tree_sql("l", "h", "own", "doc_id NULLS FIRST, h", LEAF_LEVELS),
        *_tree_sql("t", f"(SELECT k AS lang, h FROM l{LEAF_LEVELS})", "''", "lang", TOP_LEVELS),
        f"f0 AS (SELECT l0.doc_id, l0.h AS leaf, l0.shown, t0.h AS subroot, t{TOP_LEVELS}.h AS root, {sides} FROM l0 JOIN t0 ON t0.lang = l0.k {joins} CROSS JOIN t{TOP_LEVELS})",
        *folds,
    ]
    return "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, leaf, subroot, root, sha256({path}) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM f{len(levels)}"


ORACLE_SQL = {
    "op2_maxscore": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(x, lambda c: floor(256 * c)) AS v FROM e
      WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op7_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(role, '<~', '<~~'), '<|', '<~|')) + length(replace(replace(text, '<~', '<~~'), '<|', '<~|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op5_extract": r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1), '<[a-zA-Z/][^>]*$', '') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'),
    '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS x FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(x, lambda t: t <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c""",
    "op8_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT unnest([1, 2, 3, 4]) AS kind, unnest([{assign}, 'AKIA[A-Z0-9]{{16,}}', '[0-9a-f]{{24,}}', '[A-Za-z0-9+/_=-]{{20,}}']) AS pattern),
m AS (SELECT rid, kind, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM d, p WHERE regexp_matches(text, pattern)),
u AS (SELECT rid, kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT rid, kind, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u),
cand AS (SELECT row_number() OVER () AS cid, rid, hit, start, least(length(hit), 20) AS w,
           CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN 2.8 WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN 3.4 ELSE 3.6 END AS bound
         FROM s WHERE kind = 4 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '(?i)example|placeholder|xxxx') AND NOT regexp_matches(hit, '^[a-z]+([-_/=][a-z0-9]{{1,12}})+$')
           AND NOT regexp_matches(hit, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
           AND len(list_filter(range(1, length(hit) - 6), lambda i: substr(hit, i, 8) = repeat(substr(hit, i, 1), 8))) = 0),
win AS (SELECT cid, w, i, unnest(string_split(substr(hit, i, w), '')) AS ch FROM (SELECT cid, hit, w, unnest(range(1, length(hit) - w + 2)) AS i FROM cand)),
ent AS (SELECT cid, i, -sum(n / w * log2(n / w)) AS h FROM (SELECT cid, i, CAST(w AS DOUBLE) AS w, ch, CAST(count(*) AS DOUBLE) AS n FROM win GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
best AS (SELECT cid, max(h) AS h FROM ent GROUP BY 1),
f AS (SELECT rid, kind, start, start + length(hit) AS stop FROM s WHERE kind IN (2, 3) OR kind = 1 AND length(regexp_extract(hit, {assign}, 2)) >= 6
      UNION ALL SELECT rid, 4, start, start + length(hit) FROM cand JOIN best USING (cid) WHERE h >= bound - 1e-9),
t AS (SELECT rid, kind, start, ['assign', 'access', 'hex', 'entropy'][kind] || ':' || start || ':' || stop AS span FROM f),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 1) AS n_assign, count(*) FILTER (WHERE kind = 2) AS n_access, count(*) FILTER (WHERE kind = 3) AS n_hex,
        string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 4) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM t GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)""".format(assign="'" + secrets.ASSIGN.replace("'", "''") + "'"),
    "op9_sharding": """
WITH crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS n, doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes,
        CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS g FROM documents),
s AS (SELECT n, doc_id, size, h, g, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32,
        least(23, floor((sum(size) OVER (ORDER BY h, g, n) - size / 2.0::DOUBLE) * 24 / sum(size) OVER ())) AS shard FROM d, crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, g, n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op10_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dw AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hits AS (SELECT dw.rid, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)""",
    "op11_quantise": """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS (SELECT rid, vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM e
      WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b, b.vec_id FROM v a JOIN v b ON a.rid <> b.rid WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
n AS (SELECT a AS rid, count(*) AS n_links FROM p GROUP BY a),
r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.b GROUP BY r.a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component_id, e.vec_id), true) AS kept
FROM e LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)""",
    "op12_lexical": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
g AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM i) GROUP BY iid, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, g WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS (SELECT rid, doc_id, 100 - 75 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, g),
s AS (SELECT iid, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (rid) GROUP BY iid, rid),
k AS (SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (iid) WHERE rank <= 10""",
    "op13_merkle": _merkle_sql(),
}
