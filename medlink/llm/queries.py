"""Registered queries of the operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.llm import ann, centroids, exact_dedup, merkle, mixing, ngram_join, packing, quality_mil, quality_rules, sharding, token_counts, toxicity, warc
from medlink.llm.common import shared_dir, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with sums from each length on: a row a length, empty for an empty table."""
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"))
    return token_counts.length_histogram(stored(token_counts.length_counts(lengths), "counts"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document; see ngram_join.near_copies for null, empty and repeated rows."""
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) and top_passage of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    return quality_mil.classify(docs, model, threshold=0.7)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base figures, base_failed, posterior and kept of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), store=lambda df: stored(df, "figures"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens: a row a piece with its place."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: Shares of the tokens of the mixed corpus, by language.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate, copies and misfit of every document, for the shares in TARGETS."""
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.labelled_languages(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix_documents(docs, labelled, TARGETS, lambda df: stored(df, "members"))
    shares = [F.col("posteriors")[i].alias(f"p_{name}") for i, name in enumerate(TARGETS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies", "misfit")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and spans of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model, threshold=0.3)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100: query_id, rank, vec_id, score."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 by its key, its slot there, and its shard with one more."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as written to WARC bundles and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(spark)
    index = stored(warc.write_bundles(warc.classify(table(spark, sf_dir, "pages")), f"{folder}/warc"), "index")
    records = warc.read_bundles(spark, f"{folder}/warc", index)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts up to white space: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


#: Clusters and rounds of op12.
CLUSTERS, ROUNDS = 40, 5


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the 64-component vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=ROUNDS, dims=64, scale=256, seed=2)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = merkle.manifest(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_ann": op8_ann,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_centroids": op12_centroids,
    "op13_merkle": op13_merkle,
}

_CRC_TABLE = """steps AS (
  SELECT range AS byte, range AS crc, 0 AS step FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM steps WHERE step < 8),
crc_table AS (SELECT list(crc ORDER BY byte) AS t FROM steps WHERE step = 8)"""


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's rounds written out, one pair of tables a round."""
    ctes = [
        """kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS}))""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i})
  GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place)::BIGINT[] AS c
    FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place)
    GROUP BY cluster) m ON m.cluster = o.cluster)""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, a.cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_DOC_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
  lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"""


def _levels_sql(name: str, leaves: str) -> str:
    """All nodes over leaves (tree, place, n, h): (tree, level, place, n, h)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, place, n, h FROM {leaves}
  UNION ALL
  SELECT a.tree, a.level + 1, a.place // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM {name} a LEFT JOIN {name} b ON b.tree = a.tree AND b.place = a.place + 1 WHERE a.place % 2 = 0 AND a.n > 1)"""


def _steps_sql(name: str, leaves: str, nodes: str) -> str:
    """Siblings of each leaf, level by level: their side and digest, or - where there is none."""
    return f"""{name} AS (
  SELECT d.tree, d.place, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.place < o.place THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY o.level) AS steps
  FROM {leaves} d JOIN {nodes} o ON o.tree = d.tree AND o.place = d.place >> o.level AND o.n > 1
  LEFT JOIN {nodes} s ON s.tree = o.tree AND s.level = o.level AND s.place = xor(o.place, 1)
  GROUP BY d.tree, d.place)"""


_MD5 = "('0x' || substr(md5(d.doc_id || '#' || s.shard), 1, 15))::BIGINT"
#: CRC-32 by its definition: the table of the reflected polynomial, then one step a byte.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(coalesce(text, ''))) + 1),
  lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))"""

ORACLES: dict[str, str] = {
    "op2_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) * 5 >= 4 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM reach GROUP BY doc_id""",
    "op9_sharding": f"""
WITH RECURSIVE {_CRC_TABLE},
scores AS (SELECT d.doc_id, s.shard, {_MD5} AS score FROM documents d, (SELECT range AS shard FROM range(25)) s),
best AS (
  SELECT doc_id, arg_max(shard, (score, shard)) FILTER (shard < 24) AS shard, arg_max(shard, (score, shard)) AS grown_shard
  FROM scores GROUP BY doc_id)
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, xor({_CRC}, 4294967295) AS text_crc32,
  'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM documents JOIN best USING (doc_id), crc_table""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN response_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response_id <> page_id THEN response_id END AS refers_to FROM r""",
    "op11_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS keep_id, count(*) OVER (PARTITION BY whole) AS group_size,
  row_number() OVER (PARTITION BY whole ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(whole) AS text_sha256 FROM t""",
    "op12_centroids": _lloyd_sql(ROUNDS),
    "op13_merkle": f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, coalesce('l' || lang, '') AS tree, {_leaf_sql("n_chars")} AS h,
    CASE WHEN {_DOC_CRC} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_levels_sql("nodes", "leaves")},
subroots AS (
  SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_levels_sql("tops", "subroots")},
{_steps_sql("low", "leaves", "nodes")},
{_steps_sql("high", "subroots", "tops")},
paths AS (
  SELECT d.*, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM leaves d JOIN subroots s ON s.name = d.tree LEFT JOIN low ON low.tree = d.tree AND low.place = d.place
  LEFT JOIN high ON high.tree = s.tree AND high.place = s.place),
folded AS (
  SELECT *, CASE WHEN changed IS NULL THEN root ELSE list_reduce(list_prepend(changed, steps), lambda a, s: CASE
    WHEN s = '-' THEN sha256(a) WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) END AS folded_root FROM paths)
SELECT doc_id, h AS leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded""",
}
