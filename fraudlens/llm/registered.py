"""The registered queries of this package, one per operator, over whole tables.

``QUERIES`` maps a name to a callable of (spark, sf_dir); ``ORACLES`` holds
DuckDB SQL where SQL can express the result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm import (bpe, fingerprint, line_dedup, main_text, merkle, near_dedup, packing, pii, quality,
                           sharding, spelling, url_lists, warc)
from fraudlens.llm.common import load

QUERIES = {}
ORACLES = {}


def vocabulary(name: str) -> str:
    """A public tokenizer's file; installed alike on the driver and executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# ------------------------------------------------------ 1 MinHash near-dedup
@register("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(load(spark, sf_dir, "documents"), num=85, den=100, width=3)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


# ------------------------------------------------------------- 2 line dedup
@register("op2_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, i, l,
         translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
hit AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT lines.*, hit.k IS NOT NULL AND doc_id <> top AS gone FROM lines LEFT JOIN hit USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "line_report.n_lines", "line_report.n_dropped",
                      F.sha2(F.col("line_report.text").cast("binary"), 256).alias("kept_sha256"))


# --------------------------------------------------------------- 3 sharding
@register("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------- 4 quality rules
@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    out = quality.judge(docs, model)
    return out.select("doc_id", "quality.*")


# ---------------------------------------------------------------- 5 packing
@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                  token_pattern())


# -------------------------------------------------------- 6 byte-level BPE
@register("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                                 token_pattern(), with_ids=False).drop("ids")


# ----------------------------------------------------------- 7 fingerprints
@register("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.next_likeness(load(spark, sf_dir, "documents"))


# --------------------------------------------------------- 8 personal data
@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
                      F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      pii.listed(F.col("spans")).alias("spans"))


# ------------------------------------------------------------ 9 URL filters
def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day (0 to 364), as the tables have none."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365))
                        .cast("int").alias("fetch_day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries derived from the hosts, domains and URLs of ``pages``: by
    a hash of the key, a fifth of the hosts, a tenth of the domains and a
    fiftieth of the URLs are listed, and some are allowed and blocked again."""
    host = url_lists.host(F.col("url"))
    keys = (pages.select(F.lit("host").alias("scope"), host.alias("key"))
            .union(pages.select(F.lit("domain"), url_lists.domain(host)))
            .union(pages.select(F.lit("url"), F.col("url"))).distinct())
    v = F.conv(F.substring(F.md5(F.concat("scope", F.lit(":"), "key")), 1, 7), 16, 10).cast("int")
    share = F.when(F.col("scope") == "host", 5).when(F.col("scope") == "domain", 10).otherwise(50)
    listed = keys.withColumn("v", v).where(F.col("v") % share == 0)
    first, again = F.col("v") % 200, F.col("v") % 200 + 20 + F.col("v") % 50
    entry = lambda action, day: F.struct(action.alias("action"), day.alias("day"))
    dated = F.array(entry(F.lit("block"), first),
                    entry(F.when(F.col("v") % 3 == 0, F.lit("allow")), again),
                    entry(F.when(F.col("v") % 9 == 0, F.lit("block")), again + 60))
    return (listed.select("scope", "key", F.explode(dated).alias("e"))
            .select("scope", "key", "e.action", "e.day").where(F.col("action").isNotNull()))


@register("op9_url_filters", r"""
WITH p AS (
  SELECT page_id, url, CAST((page_id * 37) % 365 AS INTEGER) AS fetch_day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host
  FROM pages),
q AS (SELECT *, regexp_extract(host, '([^.]+\.)?([^.]+\.)?[^.]+$') AS domain FROM p),
keys AS (
  SELECT 'host' AS scope, host AS key FROM q UNION SELECT 'domain', domain FROM q
  UNION SELECT 'url', url FROM q),
v AS (SELECT *, CAST('0x' || substr(md5(scope || ':' || key), 1, 7) AS INTEGER) AS v FROM keys),
listed AS (
  SELECT * FROM v
  WHERE v % (CASE scope WHEN 'host' THEN 5 WHEN 'domain' THEN 10 ELSE 50 END) = 0),
entries AS (
  SELECT scope, key, 'block' AS action, v % 200 AS day FROM listed
  UNION ALL SELECT scope, key, 'allow', v % 200 + 20 + v % 50 FROM listed WHERE v % 3 = 0
  UNION ALL SELECT scope, key, 'block', v % 200 + 80 + v % 50 FROM listed WHERE v % 9 = 0),
active AS (
  SELECT q.page_id, q.fetch_day, e.scope, e.key, e.action, e.day,
         row_number() OVER (PARTITION BY q.page_id ORDER BY
           CASE e.scope WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, e.day DESC) AS r
  FROM q JOIN entries e
    ON e.key = CASE e.scope WHEN 'url' THEN q.url WHEN 'host' THEN q.host ELSE q.domain END
   AND e.day <= q.fetch_day)
SELECT q.page_id, q.fetch_day, coalesce(a.action = 'block', false) AS blocked,
       a.scope, a.key, CAST(a.day AS INTEGER) AS entry_day
FROM q LEFT JOIN active a ON a.page_id = q.page_id AND a.r = 1""")
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    out = url_lists.filter_captures(dated_captures(pages), dated_entries(pages))
    return out.select("page_id", "fetch_day", "url_decision.*")


# ------------------------------------------------------------------ 10 WARC
@register("op10_warc", r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM w""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(load(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ------------------------------------------------------- 11 HTML extraction
@register("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"),
                      F.char_length("main_text").cast("long").alias("n_chars"))


# ------------------------------------------------------ 12 Merkle manifest
def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}) || ':' || {column} END"


def _crc32(value: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      range(strlen({value})), lambda k: list_transform(range(8), lambda j:
        (('0x' || substr(hex({value}), 2 * k + 1, 2))::BIGINT >> j) & 1)))),
      lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))))"""


_TAMPERED = (f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 "
             "THEN replace(text, chr(10), '') ELSE text END")


@register("op12_merkle_manifest", f"""
WITH RECURSIVE t AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id_, CAST(n_chars AS VARCHAR) AS nc_, {_TAMPERED} AS text_,
         coalesce('=' || source, '') AS g
  FROM documents),
d AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i,
         sha256({" || ".join(_field(c) for c in ["id_", "source", "lang", "nc_", "text"])}) AS leaf,
         sha256({" || ".join(_field(c) for c in ["id_", "source", "lang", "nc_", "text_"])}) AS seen
  FROM t),
nodes AS (
  SELECT 0 AS lvl, g, i, leaf AS h FROM d
  UNION ALL
  SELECT lvl + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY lvl, g, i // 3),
subs AS (SELECT g, max(lvl) AS height, arg_max(h, lvl) AS subroot FROM nodes GROUP BY g),
tops AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY g) - 1 AS i, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY lvl, i // 3),
top AS (SELECT max(lvl) AS height, arg_max(h, lvl) AS root FROM tops),
steps AS (
  SELECT doc_id, s, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i < here), '') AS l,
         coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i > here), '') AS r
  FROM (SELECT d.doc_id, d.g, unnest(range(height)) AS s, d.i FROM d JOIN subs USING (g)) x,
       LATERAL (SELECT x.i // CAST(pow(3, x.s) AS BIGINT) AS here) a
  JOIN nodes n ON n.g = x.g AND n.lvl = x.s AND n.i // 3 = a.here // 3
  GROUP BY doc_id, s
  UNION ALL
  SELECT doc_id, base + s, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i < here), ''),
         coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i > here), '')
  FROM (SELECT d.doc_id, subs.height AS base, unnest(range(top.height)) AS s, tops.i
        FROM d JOIN subs USING (g) JOIN tops ON tops.lvl = 0 AND tops.h = subs.subroot, top) x,
       LATERAL (SELECT x.i // CAST(pow(3, x.s) AS BIGINT) AS here) a
  JOIN tops n ON n.lvl = x.s AND n.i // 3 = a.here // 3
  GROUP BY doc_id, base, s),
proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY s)) AS proof, count(*) AS n FROM steps GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0 AS s, seen AS h FROM d
  UNION ALL
  SELECT f.doc_id, f.s + 1, sha256(l || h || r) FROM folds f JOIN steps USING (doc_id, s)),
folded AS (SELECT doc_id, arg_max(h, s) AS folded_root FROM folds GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM d JOIN subs USING (g) JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id), top""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.when(key % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(load(spark, sf_dir, "documents"), {"text": bare})


# --------------------------------------------------- 13 spelling variants
@register("op13_spelling_variants", f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (
  SELECT r, n, {_crc32("v")} AS h
  FROM (SELECT r, n, CAST(doc_id AS VARCHAR) || ':' || r AS v FROM runs)),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0
                  THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2)
                  ELSE r END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
gaps AS (SELECT word, n, p, left(word, p) AS l, substr(word, p + 2) AS r FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b
    ON a.p = b.p AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.l || g.r
  UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.l || g.r),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form,
         CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS last_form, 0 AS k FROM forms
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.last_form WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last_form, k) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents").select("doc_id", "text"))
