"""One query per corpus operator, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    bag_search,
    bbit_minhash,
    codeword_language,
    compression_bands,
    digest_index,
    gear_chunks,
    jump_shards,
    packaged_warc,
    personal_data,
    residual_packing,
    rotated_middle,
    suffix_buckets,
    trie_bpe,
)
from panelcast.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Text of a public tokenizer file, by name or path; read by the driver alone."""
    import public_tokenizers

    return Path(name if "/" in name else public_tokenizers.path(name)).read_text("utf-8")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_compression_bands")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality(documents(spark, sf_dir))


@query("op2_char_tagger")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(documents(spark, sf_dir))


@query(
    "op3_suffix_buckets",
    """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS k FROM (
        SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM b WHERE len(h) >= 400)),
    dup AS (SELECT doc_id, i FROM w SEMI JOIN (
        SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
    runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
        SELECT doc_id, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 200)::INT
               AS fresh FROM dup)),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM runs GROUP BY doc_id, run),
    cuts AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
    gone AS (
        SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS tail,
               string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept,
               string_agg(a::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY a) AS spans
        FROM cuts JOIN b USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
           coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans,
           sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(tail, 0) + 1)::BIGINT))) AS kept_sha256
    FROM b LEFT JOIN gone USING (doc_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.remove_repeats(documents(spark, sf_dir))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_bbit_minhash",
    rf"""WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
            list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s
        FROM words WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x
            JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
        JOIN sizes p1 ON p1.doc_id = a JOIN sizes p2 ON p2.doc_id = b
        WHERE 100 * p.n >= 80 * (p1.n + p2.n - p.n)),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(documents(spark, sf_dir))


@query("op5_residual_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack_documents(
        documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")
    )


@query("op6_codeword_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeword_language.identify(documents(spark, sf_dir))


@query(
    "op7_digest_index",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_dedup(documents(spark, sf_dir), digest_index.new_index(spark))


@query("op8_gear_chunks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_chunks(documents(spark, sf_dir))


# CRC-32 from its table, made by the rule of its polynomial, and the jumps of 64-bit keys.
OP9_SQL = r"""WITH RECURSIVE
    bits AS (
      SELECT i, i::UINTEGER AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
      UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1
      FROM bits WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    sums AS (
      SELECT doc_id, xor(list_reduce(
          list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UINTEGER),
          lambda acc, b: xor(t[(xor(acc, b) & 255) + 1], acc >> 8), 4294967295::UINTEGER),
        4294967295::UINTEGER)::BIGINT AS crc
      FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table),
    jumps AS (
      SELECT doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j,
        (doc_id::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key
      FROM documents, (VALUES (24), (25)) v(n)
      UNION ALL
      SELECT doc_id, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT, k
      FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k
            FROM jumps WHERE j < n)),
    landed AS (SELECT doc_id, n, max(b) AS shard FROM jumps WHERE j >= n GROUP BY ALL)
    SELECT d.doc_id, strlen(coalesce(text, '')) + 8 AS size, crc AS text_crc32, 'key' AS law,
      a.shard::INT AS shard, row_number() OVER (PARTITION BY a.shard ORDER BY d.doc_id) - 1 AS slot,
      g.shard::INT AS grown_shard
    FROM documents d JOIN sums USING (doc_id) JOIN landed a ON a.doc_id = d.doc_id AND a.n = 24
    JOIN landed g ON g.doc_id = d.doc_id AND g.n = 25"""


@query("op9_jump_shards", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.assign_shards(documents(spark, sf_dir), 24)


@query("op10_trie_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query(
    "op11_rotated_middle",
    """WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, h[1] % (length(coalesce(text, '')) + 1) AS c1,
               h[2] % (length(coalesce(text, '')) + 1) AS c2, h[3] % 100 AS p3, h[4] % 100 AS p4
        FROM (SELECT *, list_transform([1, 9, 17, 25],
                  lambda i: ('0x' || substr(sha256('1:' || doc_id), i, 8))::UBIGINT::BIGINT) AS h FROM documents)),
    formed AS (
        SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR p3 >= 90 THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cut),
    parts AS (
        SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rotated_middle.restored(rotated_middle.fill_in_middle(documents(spark, sf_dir)))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_bag_search",
    f"""WITH words AS (SELECT doc_id, unnest({TERMS}) AS t FROM documents),
    lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
    norms AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM lengths, whole),
    wanted AS (
        SELECT item_id, t, count(*) AS repeats
        FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
    tfs AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM wanted) GROUP BY ALL),
    weights AS (
        SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM tfs, whole GROUP BY t, docs),
    scores AS (
        SELECT item_id, doc_id,
               sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM tfs JOIN weights USING (t) JOIN norms USING (doc_id) JOIN wanted USING (t)
        GROUP BY ALL HAVING sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) > 0)
    SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scores
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
    QUALIFY row_number() OVER best <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return bag_search.search(documents(spark, sf_dir), items)


@query(
    "op13_packaged_warc",
    """SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha1(p) AS payload_digest,
        CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN again THEN last END AS refers_to
    FROM (SELECT *, strlen(p) >= 1000 AND page_id <> last AS again FROM (
        SELECT page_id, coalesce(html, '') AS p,
               max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = packaged_warc.write_archives(pages)
    return packaged_warc.read_archives(archives).drop("target_uri")
