"""Registered queries ``opN_<name>`` of the numbered operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import merkle, packing, periodic_runs, pii, quality, sharding, warc
from tidewheel.llm.bpe import encoded
from tidewheel.llm.fingerprints import fingerprints
from tidewheel.llm.line_templates import without_recurring_lines
from tidewheel.llm.lsh_forest import near_duplicates
from tidewheel.llm.ngram_join import similarity_join
from tidewheel.llm.permutation_index import nearest

Run = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents: base spans, and those that the boosted trees add."""
    return pii.find_pii(table(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents at a Jaccard similarity of 0.9 on three-word shingles."""
    return similarity_join(table(spark, folder, "documents"), size=3, least=Fraction(9, 10))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents and the bytes that they decode to."""
    return encoded(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return nearest(table(spark, folder, "embeddings"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of all documents, of their edited texts and how near they are."""
    return fingerprints(table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document by its number."""
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.lookup_table(spark))


def op9_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without lines of recurring templates, however short."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_recurring_lines(docs, min_tokens=1)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return warc.archived(table(spark, folder, "pages"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of periodic words of all documents, every tenth of which is made periodic first."""
    docs = periodic_runs.with_repetition(table(spark, folder, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op12_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents at a Jaccard similarity of 0.85 on three-word shingles, and the one document of each that stays."""
    return near_duplicates(table(spark, folder, "documents"), size=3, least=Fraction(17, 20))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents in their manifest, some of them tampered with."""
    return merkle.verified_rows(table(spark, folder, "documents"))


QUERIES: dict[str, Run] = {run.__name__: run for run in (
    op1_pii, op2_ngram_join, op3_packing, op4_quality, op5_bpe, op6_permutation_index,
    op7_fingerprints, op8_sharding, op9_line_templates, op10_warc, op11_periodic_runs, op12_lsh_forest, op13_merkle)}

#: The table is filled by a recursion over its slots, whose state is the table so far.
SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT row_number() OVER (ORDER BY name) - 1 AS i, name FROM (SELECT unnest({list(sharding.SHARDS)!r}) AS name)),
orders AS (
  SELECT i, list((('0x' || substr(md5(name), 1, 8))::BIGINT % {sharding.SLOTS}
    + j * (('0x' || substr(md5(name), 9, 8))::BIGINT % {sharding.SLOTS - 1} + 1)) % {sharding.SLOTS} ORDER BY j) AS slots
  FROM shards, range({sharding.SLOTS}) t(j) GROUP BY i),
fill(t, owner) AS (
  SELECT 0::BIGINT, [-1::BIGINT for x in range({sharding.SLOTS})]
  UNION ALL
  SELECT t + 1, list_concat(list_concat(owner[1:free], [i]), owner[free + 2:])
  FROM (SELECT t, owner, i, list_filter(slots, lambda s: owner[s + 1] = -1)[1] AS free
        FROM fill JOIN orders ON i = t % {len(sharding.SHARDS)} WHERE t < {sharding.SLOTS})),
lookup AS (
  SELECT s.slot, name FROM (SELECT unnest(owner) AS i, generate_subscripts(owner, 1) - 1 AS slot
                            FROM fill WHERE t = {sharding.SLOTS}) s JOIN shards USING (i))
SELECT doc_id, slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
JOIN lookup USING (slot)
"""

#: Payloads by digest, as no archive is needed to tell what a page's record must be.
WARC_SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
own AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
               min(page_id) OVER (PARTITION BY body) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.LEAST} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.LEAST} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM own
"""

#: CRC-32 of the decimal digits of ``doc_id``, as the database has no function for it.
CRC_SQL = """crc_table AS (
  SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, x: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) ORDER BY c) AS t
  FROM range(256) r(c)),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, [ord(s)::BIGINT for s in string_split(doc_id::VARCHAR, '')]),
                                 lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""


def _cell(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _row_hash(text: str) -> str:
    return "sha256(" + " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Every level of the trees is kept here, level by level upward.
MERKLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS id
  FROM (SELECT doc_id, lang, {_row_hash('text')} AS leaf,
               CASE WHEN crc % 3 = 0 THEN {_row_hash("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS edited
        FROM documents LEFT JOIN crcs USING (doc_id))),
nodes(lang, k, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, k, i // 8, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
tops(k, i, h, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY k, i // 8, n),
runs AS (SELECT lang, k, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT k, i // 8 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
places AS (
  SELECT id, k, hs, (l.i // (8 ** k)::BIGINT) % 8 AS p
  FROM leaves l JOIN runs r ON r.lang IS NOT DISTINCT FROM l.lang AND r.run = l.i // (8 ** (k + 1))::BIGINT
  UNION ALL
  SELECT id, 1000 + k, hs, (s.place // (8 ** k)::BIGINT) % 8
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top_runs r ON r.run = s.place // (8 ** (k + 1))::BIGINT),
steps AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS k, array_to_string(hs[1:p], '') AS a, array_to_string(hs[p + 2:], '') AS b
  FROM places),
folds(id, k, h) AS (
  SELECT id, 0::BIGINT, coalesce(edited, leaf) FROM leaves
  UNION ALL
  SELECT f.id, f.k + 1, sha256(a || h || b) FROM folds f JOIN steps s ON s.id = f.id AND s.k = f.k),
folded AS (SELECT id, arg_max(h, k) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN folded USING (id) LEFT JOIN proofs USING (id),
     (SELECT h AS root FROM tops WHERE n = 1)
"""

def components_sql(least: Fraction) -> str:
    """All columns of the joins, by counting the common three-word shingles of all sets that share one."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM words),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
one_way AS (
  SELECT a, b, x.n = common AND y.n = common AS same FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {least.denominator} * common >= {least.numerator} * (x.n + y.n - common)),
links AS (SELECT a, b, same FROM one_way UNION ALL SELECT b, a, same FROM one_way),
classes AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS class_id FROM documents LEFT JOIN links ON a = doc_id AND same GROUP BY doc_id),
degrees AS (SELECT a AS doc_id, count(DISTINCT class_id) AS n_links FROM links JOIN classes ON b = doc_id WHERE NOT same GROUP BY a),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, class_id, coalesce(n_links, 0)::BIGINT AS n_links,
       least(doc_id, coalesce(first, doc_id)) AS component_id
FROM documents JOIN classes USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN degrees USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a) USING (doc_id)"""


NEAR_SQL = f"""SELECT *, doc_id = component_id AS kept FROM ({components_sql(Fraction(17, 20))})"""

ORACLES: dict[str, str] = {"op8_sharding": SHARDING_SQL, "op10_warc": WARC_SQL, "op2_ngram_join": components_sql(Fraction(9, 10)),
                           "op12_lsh_forest": NEAR_SQL, "op13_merkle": MERKLE_SQL}
