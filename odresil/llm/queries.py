"""The registered queries of the numbered operators, each over its whole table, and their DuckDB texts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, fixity, huffman, manifest, minmax, ngramlm, packing, ppm, pqcodes, quality, simhash, toxicity
from .base import fold, scratch_path, table


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' archive.

    The replica is the archive with planted damage, so that there is something to find: in pages whose id leaves 1
    divided by 97 the record's first body character is replaced, and pages whose id leaves 2 are lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    rotten = F.when(F.pmod("page_id", F.lit(97)) == 1, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    copy = fixity.warc_record(F.col("page_id"), F.col("url"), rotten)
    lost = F.coalesce(F.pmod("page_id", F.lit(97)) == 2, F.lit(False))
    rows = pages.select(
        F.col("page_id").alias("record_id"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record.cast("binary"), 256).alias("digest"),
        F.when(~lost, F.sha2(copy.cast("binary"), 256)).alias("copied"),
    )
    placed = fixity.laid_out(rows, ["record_id", "length", "digest", "copied"])
    mine = placed.select("record_id", "volume", "offset", "length", "digest")
    other = placed.where("copied is not null").select("record_id", "volume", "offset", "length", F.col("copied").alias("digest"))
    return fixity.audit(mine, other)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judged(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract.extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    huffman.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return huffman.read_tokens(spark, path, ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit_and_judge(docs, table(spark, sf_dir, "labels"), without=("text",))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = ppm.train(docs, ~held_out)
    return ppm.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) != 2)


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.link(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = pqcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(pqcodes.digest(books)).alias("codebooks_sha256"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, checked against a copy whose texts are lower-cased where 5 divides the crc32 of the id."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered, lowered)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_warc_fixity,
    op2_decontaminate,
    op3_extract_html,
    op4_huffman_tokens,
    op5_quality_rules,
    op6_language_id,
    op7_lm_score,
    op8_minmax_dedup,
    op9_toxicity,
    op10_pack,
    op11_vector_codes,
    op12_simhash_dedup,
    op13_merkle_manifest,
    pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}


def _codes_sql(rounds: int = pqcodes.ROUNDS) -> str:
    """The DuckDB text of operator 11: a pair of steps a round, assignment and new entries."""
    nearest = """
a{k} AS (SELECT r, part, least_of % 64 AS e, least_of // 64 AS far FROM (
  SELECT r, p.part, min((list_inner_product(p.w, p.w) - 2 * list_inner_product(p.w, b.w) + list_inner_product(b.w, b.w))::BIGINT * 64 + b.e) AS least_of
  FROM p JOIN b{k} b USING (part) GROUP BY r, p.part))"""
    entries = """
m{k} AS (SELECT part, e, list(m ORDER BY i) AS w FROM (
  SELECT part, e, i, floor(sum(x::BIGINT)::DOUBLE / count(*)) AS m
  FROM (SELECT a.part, a.e, unnest(p.w) AS x, unnest(range(len(p.w))) AS i FROM a{k} a JOIN p USING (r, part)) GROUP BY part, e, i) GROUP BY part, e),
b{n} AS (SELECT part, e, coalesce(m.w, b.w) AS w FROM b{k} b LEFT JOIN m{k} m USING (part, e))"""
    steps = [nearest.format(k=k) + ("," + entries.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1)]
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS w FROM v, range(16) t(part)),
b0 AS (SELECT part, r - 1 AS e, w FROM p WHERE r <= 64),{",".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), s"""


ORACLES = {
    "op1_warc_fixity": """
WITH r AS (
  SELECT page_id AS record_id, coalesce(html, '') AS body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:'
      || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages),
d AS (
  SELECT record_id, strlen(head || strlen(body)::VARCHAR || gap || body || gap)::BIGINT AS length,
    sha256(head || strlen(body)::VARCHAR || gap || body || gap) AS digest_a,
    CASE WHEN record_id % 97 = 2 THEN NULL
         WHEN record_id % 97 = 1 AND body <> '' THEN sha256(head || strlen('~' || body[2:])::VARCHAR || gap || '~' || body[2:] || gap)
         ELSE sha256(head || strlen(body)::VARCHAR || gap || body || gap) END AS digest_b
  FROM r),
p AS (
  SELECT *, (sum(length) OVER (ORDER BY record_id NULLS FIRST, digest_a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS place FROM d)
SELECT place // 1073741824 AS volume, place % 1073741824 AS "offset", record_id, length, digest_a, digest_b,
  CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'corrupt' END AS kind
FROM p WHERE digest_a IS DISTINCT FROM digest_b""",
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_minmax_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op11_vector_codes": _codes_sql(),
    "op13_merkle_manifest": r"""
WITH RECURSIVE f AS (SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
g AS (SELECT * REPLACE (coalesce(xor(crc, 4294967295::BIGINT) % 5 = 0, false) AS crc) FROM f),
h AS (SELECT doc_id, source, crc AS hurt, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM g),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hurt THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (
  SELECT 0 AS lvl, source, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS many FROM n
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (many + 15) // 16 FROM t WHERE many > 1 GROUP BY lvl, source, pos // 16, many),
q AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM t WHERE many = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS node, count(*) OVER () AS many FROM q
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (many + 15) // 16 FROM u WHERE many > 1 GROUP BY lvl, pos // 16, many),
ts AS (SELECT lvl, source, pos, many,
    coalesce(string_agg(node, '') OVER (PARTITION BY lvl, source, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY lvl, source, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t),
us AS (SELECT lvl, pos, many,
    coalesce(string_agg(node, '') OVER (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM u),
w AS (
  SELECT n.source, n.pos AS home, 0 AS lvl, n.pos, n.other AS node, '' AS proof FROM n
  UNION ALL
  SELECT w.source, home, w.lvl + 1, w.pos // 16, sha256(l || node || r), proof || l || r
  FROM w JOIN ts ON ts.source IS NOT DISTINCT FROM w.source AND ts.lvl = w.lvl AND ts.pos = w.pos AND ts.many > 1),
z AS (
  SELECT w.source, w.home, 0 AS lvl, q.pos, w.node, w.proof FROM w JOIN t ON t.source IS NOT DISTINCT FROM w.source AND t.lvl = w.lvl AND t.many = 1 JOIN q ON q.source IS NOT DISTINCT FROM w.source
  UNION ALL
  SELECT z.source, home, z.lvl + 1, z.pos // 16, sha256(l || node || r), proof || l || r FROM z JOIN us ON us.lvl = z.lvl AND us.pos = z.pos AND us.many > 1)
SELECT n.doc_id, n.leaf, q.subroot, u.node AS root, sha256(z.proof) AS proof_sha256, z.node AS folded_root, z.node = u.node AS verified
FROM n JOIN q ON q.source IS NOT DISTINCT FROM n.source JOIN u ON u.many = 1
JOIN z ON z.source IS NOT DISTINCT FROM n.source AND z.home = n.pos AND z.lvl = u.lvl""",
}
