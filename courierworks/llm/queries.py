"""The queries of this subpackage: name -> (spark, folder) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courierworks.llm import conversations, dedup, filters, fingerprints, html, jaccard, licenses, packing, perplexity, pieces, quality, tokens, vectors
from courierworks.llm.common import documents, table
from courierworks.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
    return fn


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    return pieces.encode(documents(spark, sf_dir))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 100 bytes, and a digest of the rest."""
    return dedup.dedup_documents(documents(spark, sf_dir))


@query
def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as directly addressable codes and read back."""
    return tokens.write_and_read(documents(spark, sf_dir))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document."""
    return packing.pack_documents(documents(spark, sf_dir))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and of its edited text, with their likeness."""
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in every document."""
    return licenses.scan(documents(spark, sf_dir))


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document by the Jaccard similarity of its word shingles."""
    return jaccard.join_documents(documents(spark, sf_dir))


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out third."""
    return quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every 50th vector against all others."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with the totals of its subtree."""
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, per source."""
    return filters.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether its repeats and its perplexity keep it."""
    return perplexity.judge(documents(spark, sf_dir))


ORACLES["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op2_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY substr(hx, 2 * i + 1, 200) ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, hx, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)
), g AS (
  SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w WHERE nth > 1
), h AS (
  SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM h GROUP BY doc_id, span
), k AS (
  SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s
  UNION ALL SELECT d.doc_id, n, coalesce(max(z), 0) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, n
), t AS (
  SELECT k.doc_id, string_agg(substr(hx, 2 * p + 1, 2 * (a - p)), '' ORDER BY a, p) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id) USING (doc_id)
"""

ORACLES["op7_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), x AS (
  SELECT doc_id, unnest(sh) AS s FROM g
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT c.a, c.b, (len(p.sh) = common AND len(q.sh) = common) AS same FROM c JOIN g p ON p.doc_id = c.a JOIN g q ON q.doc_id = c.b
  WHERE 9 * common >= 4 * (len(p.sh) + len(q.sh))
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), n AS (
  SELECT l.a, count(*) AS links, count(DISTINCT CASE WHEN NOT same THEN list_sort(g.sh) END) AS texts FROM l JOIN g ON g.doc_id = l.b GROUP BY l.a
)
SELECT g.doc_id, min(root) AS class_id, coalesce(any_value(links), 0)::BIGINT AS n_links, coalesce(any_value(texts), 0)::BIGINT AS n_text_links, len(any_value(sh))::BIGINT AS n_shingles
FROM g JOIN r ON r.node = g.doc_id LEFT JOIN n ON n.a = g.doc_id GROUP BY g.doc_id
"""

# crc32 bit by bit: the reflected polynomial 0xEDB88320 is 3988292384
ORACLES["op11_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, text, tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS tok FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT),
    lambda crc, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)), 4294967295::BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM own)
), heads AS (
  SELECT ids.c, b.i, b.tok, b.text FROM ids JOIN own b ON b.c = ids.base AND b.i < ids.h
), taken AS (
  SELECT ids.c, ids.h, count(heads.c) AS n FROM ids LEFT JOIN heads ON heads.c = ids.c GROUP BY ids.c, ids.h
), turns AS (
  SELECT * FROM heads UNION ALL SELECT o.c, o.i - t.h + t.n, o.tok, o.text FROM own o JOIN taken t ON t.c = o.c AND o.i >= t.h
), lists AS (
  SELECT ids.c, coalesce(list(t.tok ORDER BY t.i) FILTER (t.c IS NOT NULL), []) AS toks, coalesce(list(length(t.text) ORDER BY t.i) FILTER (t.c IS NOT NULL), []) AS sizes
  FROM ids LEFT JOIN turns t ON t.c = ids.c GROUP BY ids.c
), path AS (
  SELECT c, d, array_to_string(toks[1:d], ',') AS key, array_to_string(toks[1:d - 1], ',') AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(toks) AS ended
  FROM (SELECT c, toks, sizes, unnest(range(0, len(toks) + 1)) AS d FROM lists)
), node AS (
  SELECT d, key, any_value(up) AS up, min(c) AS low, count(*) AS n, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends
  FROM path GROUP BY d, key
), kids AS (
  SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, key)
), total AS (
  SELECT path.d, path.key, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.size) AS saved FROM full_node u JOIN path ON path.c = u.low AND path.d <= u.d GROUP BY ALL
)
SELECT f.low AS conv_id, f.d AS depth, p.low AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN total USING (d, key) LEFT JOIN node p ON f.d > 0 AND p.d = f.d - 1 AND p.key = f.up
"""

ORACLES["op12_filter_audit"] = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part, (len(ws) < 50)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name
), o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.name, b.name, c.name, d.name, e.name])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, (1 << (ascii(filter_order[step]) - 65))::INTEGER AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda k: (1 << (ascii(filter_order[k]) - 65))::INTEGER)), 0)::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
