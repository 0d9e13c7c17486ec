"""The queries of the training-data operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.llm import chat, codes, decontaminate, materialise, minhash, packing, release, resample, sharding, token_counts, topk, url_rules, vectorfit
from quillmatch.llm.common import scratch, table


def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_resample(spark, sf_dir):
    return resample.select_documents(table(spark, sf_dir, "documents"), resample.good_labels(table(spark, sf_dir, "labels")))


def op3_training_order(spark, sf_dir):
    return materialise.materialise(table(spark, sf_dir, "documents"), scratch(spark, "shards"), key=20240229, length=2048, shard_sequences=8192)


def op4_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)


def op5_topk(spark, sf_dir):
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_preferences(spark, sf_dir):
    out = chat.format_preferences(chat.answer_swaps(chat.conversations(table(spark, sf_dir, "conversations"))))
    return out.withColumns({c: chat.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op7_pack(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), length=2048, end_id=1)


#: verdict, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def labelled_pages(pages, labels):
    """url, bad of the labelled pages. A page shows the document whose number stands in its path, after the language."""
    number = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]+/[a-z]+/(\d{1,18})", 1).try_cast("long")
    bad = labels.select(F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("url", number.alias("number")).join(bad, "number").select("url", "bad")


def op8_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels")), URL_RULES, min_support=0.002, min_confidence=0.6)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_confidence")


def op9_jump_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_token_counts(spark, sf_dir):
    return token_counts.count_document_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"))


def op11_release(spark, sf_dir):
    return release.replay(table(spark, sf_dir, "conversations")).drop("place")


def op12_vector_fit(spark, sf_dir):
    return vectorfit.pack_documents(table(spark, sf_dir, "documents"), vectorfit.Room(tokens=2048), end_id=0)


def op13_vector_codes(spark, sf_dir):
    return codes.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op4_decontaminate": OP4_SQL, "op5_topk": OP5_SQL, "op6_preferences": OP6_SQL, "op8_url_rules": OP8_SQL, "op9_jump_shards": OP9_SQL, "op11_release": OP11_SQL, "op13_vector_codes": OP13_SQL}


#: Every window of every item against every position of every document.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[p + 1 : p + least(13, len(ws))], ' ') AS w
  FROM (SELECT item, ws, unnest(range(0, greatest(len(ws) - 12, 1))) AS p FROM b WHERE len(ws) > 0)
), pl AS (
  SELECT doc_id, n, p, array_to_string(ws[p + 1 : p + n], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
), h AS (SELECT doc_id, p, pl.n, item FROM pl JOIN w ON pl.w = w.w AND pl.n = w.n
), pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

#: Every query against every row.
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

#: Turns numbered by a window, the first unequal number by a join, and running sums for the spans.
OP6_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), l AS (SELECT conv_id, max(k) AS k, arg_max(text, k) AS answer FROM m WHERE role = 'assistant' GROUP BY 1
), n AS (
  SELECT conv_id AS pair_id, 0 AS side, k, role, text FROM m
  UNION ALL
  SELECT m.conv_id, 1, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.k), role, CASE WHEN m.k = l.k THEN o.answer ELSE text END
  FROM m LEFT JOIN l ON l.conv_id = m.conv_id LEFT JOIN l o ON o.conv_id = xor(m.conv_id, 1)
  WHERE l.k IS NULL OR m.k <> l.k OR o.answer IS NOT NULL
), eq AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
), p AS (SELECT pair_id, CAST(coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS INTEGER) AS prompt_turns FROM eq GROUP BY 1
), r AS (
  SELECT n.*, prompt_turns, '<|im_start|>' || replace(replace(replace(role, chr(13), ' '), chr(10), ' '), '<|im_', '< |im_') || chr(10) AS head, replace(text, '<|im_', '< |im_') || '<|im_end|>' AS body FROM n JOIN p USING (pair_id)
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, side, k > prompt_turns ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r
)
SELECT pair_id, any_value(prompt_turns) AS prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k <= prompt_turns), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k > prompt_turns), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 1 AND k > prompt_turns), '') AS rejected,
  coalesce(string_agg(CAST(base + length(head) AS BIGINT) || ':' || length(body), ',' ORDER BY k) FILTER (side = 0 AND k > prompt_turns AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(base + length(head) AS BIGINT) || ':' || length(body), ',' ORDER BY k) FILTER (side = 1 AND k > prompt_turns AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id
"""

#: All pairs that share a shingle, and all that they reach.
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + least(4, len(ws))], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 3, 1))) AS p FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)
), r AS (SELECT doc_id AS id, doc_id AS of FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.of
), c AS (SELECT id, min(of) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

#: Every set of up to six items of every labelled page, counted; no rule is pruned, as a pruned one changes no maximum.
OP8_SQL = r"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS q FROM pages
), p AS (
  SELECT page_id, url, host, path, list_filter(list_distinct(list_concat(list_transform(string_split(host, '.'), lambda x: 'h=' || x),
    list_transform(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[/.\-_]+'), lambda x: 'p=' || x),
    list_transform(string_split(q, '&'), lambda x: 'q=' || regexp_extract(x, '^([^=]*)', 1)))), lambda x: NOT regexp_matches(x, '^.=\d*$')) AS ts FROM u
), l AS (
  SELECT row_number() OVER () AS r, ts, coalesce(quality = 0 OR toxic = 1, false) AS bad
  FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(url, '^[^:/?#]+://[^/?#]+/[a-z]+/(\d{1,18})', 1) AS BIGINT)
), n AS (SELECT count(*) AS total, count(*) FILTER (bad) AS bad, count(*) FILTER (bad) / count(*) AS base FROM l
), least AS (SELECT greatest(ceil(0.002::DOUBLE * total), floor(16 * base / (1 - base)) + 1) AS least FROM n WHERE base > 0 AND base < 1
), t AS (SELECT t, string_agg(r, ',' ORDER BY r) AS rows FROM (SELECT r, unnest(ts) AS t FROM l) GROUP BY t HAVING count(*) >= (SELECT least FROM least)
), c AS (SELECT t, min(t) OVER (PARTITION BY rows) AS item FROM t
), i AS (SELECT r, bad, list_sort(list_distinct(list(item))) AS items FROM (SELECT r, bad, unnest(ts) AS t FROM l) JOIN c USING (t) GROUP BY r, bad
), s AS (
  SELECT bad, list_transform(list_filter(range(len(items)), lambda x: (m >> x) & 1 = 1), lambda x: items[x + 1]) AS ante
  FROM (SELECT bad, items, unnest(range(1, CAST(1 AS BIGINT) << len(items))) AS m FROM i) WHERE bit_count(m) <= 6
), g AS (SELECT ante, count(*) AS pages, count(*) FILTER (bad) AS hits FROM s GROUP BY ante HAVING count(*) FILTER (bad) >= (SELECT least FROM least)
), f AS (SELECT ante, hits / pages AS p, pages::DOUBLE AS k FROM g
), rules AS (SELECT ante, p FROM f, n WHERE p >= 0.6 AND (p + 16 / (2 * k) - 4 * sqrt(p * (1 - p) / k + 16 / (4 * k * k))) / (1 + 16 / k) > base
), own AS (SELECT page_id, url, list(item) AS items FROM (SELECT DISTINCT page_id, url, unnest(ts) AS t FROM p) JOIN c USING (t) GROUP BY ALL
), m AS (SELECT page_id, url, max(p) AS p FROM own JOIN rules ON list_has_all(items, ante) GROUP BY ALL
), given(kind, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT page_id, url, arg_max(h || pre, length(h || pre)) AS rule, arg_max(kind, length(h || pre)) AS kind FROM p JOIN given ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY ALL
)
SELECT p.page_id, host, path, rule, coalesce(kind, CASE WHEN m.p IS NULL THEN 'allow' ELSE 'block' END) AS verdict, m.p AS mined_confidence
FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.url = p.url LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url
"""

#: The published hash in 128-bit numbers, a step at a time, and the checksum a byte at a time.
OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), r AS (
  SELECT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM d), (VALUES (8), (9)) s(n)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k, b, j FROM r WHERE j < n)
), s AS (SELECT doc_id, max(b) FILTER (n = 8) AS shard, max(b) FILTER (n = 9) AS grown_shard FROM r WHERE j >= n GROUP BY 1
), t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), c AS (
  SELECT doc_id, 1 + strlen(text) AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM d, t
)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(CAST(c.doc_id AS VARCHAR))[1:4])::INTEGER % 1024, c.doc_id, crc, size) - 1 AS slot
FROM c JOIN s ON s.doc_id = c.doc_id
"""

#: The digests a character at a time; all conversations step by step, each with the deliveries of its last four turns.
OP11_SQL = r"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), k AS (SELECT conv_id, turn, unnest(range(0, 9)) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), h AS (
  SELECT conv_id, turn, k, CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(k || ':' || conv_id || ':' || turn)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS BIGINT) AS h FROM k, tb
), d AS (
  SELECT conv_id, turn, list(h ORDER BY k) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM h GROUP BY conv_id, turn
), x AS (
  SELECT conv_id, turn, p, 7 * p AS arrival, CASE WHEN h[1] % 5 <= p THEN h[1] % 5 ELSE 0 END AS back,
    CASE WHEN h[2] % 101 < 50 THEN h[3] % 101 END AS repair, list_transform(range(1, 7), lambda a: h[a + 3] % 3 = 0) AS unlucky FROM d
), r AS (
  SELECT -1::BIGINT AS p, conv_id, NULL::BIGINT AS turn, []::BIGINT[] AS ends, NULL::VARCHAR AS status, NULL::BIGINT AS attempts, NULL::BIGINT AS first_at, NULL::BIGINT AS last_at FROM (SELECT DISTINCT conv_id FROM x)
  UNION ALL
  SELECT p, conv_id, turn, list_append(ends, CASE WHEN status = 'delivered' THEN last_at END), status, attempts, first_at, last_at FROM (
    SELECT p, conv_id, turn, ends, CASE WHEN blocked THEN 'blocked' WHEN won IS NULL THEN 'dead' ELSE 'delivered' END AS status, CASE WHEN blocked THEN 0 ELSE coalesce(won, 6) END AS attempts,
      CASE WHEN NOT blocked THEN start END AS first_at, CASE WHEN NOT blocked THEN start + 10 * ((1::BIGINT << (coalesce(won, 6) - 1)) - 1) END AS last_at
    FROM (
      SELECT *, list_min(list_filter(range(1, 7), lambda a: repair IS NULL OR NOT (start + 10 * ((1::BIGINT << (a - 1)) - 1) < arrival + repair OR unlucky[a]))) AS won FROM (
        SELECT x.p, x.conv_id, x.turn, r.ends, arrival, repair, unlucky, back > 0 AND r.ends[len(r.ends) - back + 1] IS NULL AS blocked, CASE WHEN back = 0 THEN arrival ELSE greatest(arrival, r.ends[len(r.ends) - back + 1]) END AS start
        FROM r JOIN x ON x.conv_id = r.conv_id AND x.p = r.p + 1)))
), c AS (
  SELECT conv_id, turn, min(CAST(xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295), 4294967295) AS BIGINT)) AS crc FROM conversations, tb GROUP BY ALL
), n AS (SELECT r.*, crc, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY r.conv_id, status = 'delivered' ORDER BY last_at, r.turn) END AS release_no FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT conv_id, turn, status, CAST(attempts AS INTEGER) AS attempts, first_at, last_at, release_no,
  CASE WHEN release_no IS NOT NULL THEN CAST(sum(release_no * crc) OVER (PARTITION BY conv_id, release_no IS NULL ORDER BY release_no) AS BIGINT) END AS state
FROM n
UNION ALL SELECT DISTINCT conv_id, turn, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE conv_id IS NULL OR turn IS NULL
"""

_ROUND = """
a{i} AS (SELECT vec_id, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS a FROM v JOIN b{i} USING (p) GROUP BY ALL"""
_MEAN = """
), m{i} AS (SELECT p, e, list(s ORDER BY k) AS y FROM (SELECT p, e, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) AS s FROM (SELECT p, a.e AS e, x, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY ALL) GROUP BY ALL
), b{j} AS (SELECT p, e, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} USING (p, e)
),"""

#: Every part against every entry, four rounds written out.
OP13_SQL = (
    """
WITH f AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, p, w[p * len(w) // 4 + 1 : (p + 1) * len(w) // 4] AS x FROM f, range(4) r(p)
), b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM v WHERE vec_id IN (SELECT vec_id FROM f ORDER BY vec_id LIMIT 256)
),"""
    + "".join(_ROUND.format(i=i) + _MEAN.format(i=i, j=i + 1) for i in range(4))
    + _ROUND.format(i=4)
    + """
), c AS (SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a4 GROUP BY ALL
), g AS (SELECT sha256(string_agg(z, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(y, ',') AS z FROM b4))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN f USING (vec_id), g
"""
)
