"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode as decode_bytes
from .bpe import encode as encode_bytes
from .common import fresh_path, table
from .content_sort import mark_copies
from .filter_audit import audit, failed
from .html_text import extract
from .langid import fit, predict
from .packing import Tokenizer, pack
from .pieces import encode
from .simhash import near_groups
from .substring import kept_words
from .urlfilter import Rule, judge
from .vafile import scaled, top_k
from .warc import read_archives, write_archives
from .whitening import fit_whitening, whiten
from .whitening import scaled as whole_numbers


#: Public tokenizer file that packing uses.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in training sequences, with a digest of the ids there."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer=Tokenizer(BYTE_BPE))
    return packed.withColumn("ids_hash", F.xxhash64("ids")).drop("ids")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


#: Public model file that the segmentation query uses.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The N best of every text, each decoded again in the task that found it."""
    return encode(table(spark, sf_dir, "documents"), PIECES_MODEL, n=4, ids=False, decoded=True).drop("ids")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kept_words(table(spark, sf_dir, "documents"), words=20)
    return done.select(F.col("_doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    records = read_archives(archives, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Rules of the URL query.
URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r.key, r.action) for r in URL_RULES], "key string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules, sorted({len(r.path) for r in URL_RULES})).drop("url")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    profiles = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    return whiten(vectors, fit_whitening(vectors, k=4), k=4)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


#: Public tokenizer file of the encoding query.
BYTE_BPE_MERGES = "/opt/tokenizers/byte_bpe_50k.json"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text they stand for, as digests."""
    encoded = encode_bytes(table(spark, sf_dir, "documents"), BYTE_BPE_MERGES, packed=True)
    digests = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_bytes(digests, BYTE_BPE_MERGES).withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_topk": op2_exact_topk,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
    "op5_html_text": op5_html_text,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe": op13_bpe,
}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op2_exact_topk": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op6_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d
        ), windows AS (
            SELECT doc_id, k, string_agg(word, ' ') OVER o AS s, count(*) OVER o AS n
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), again AS (
            SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS nth FROM windows WHERE n = 20)
            WHERE nth > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM again
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_warc": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), l AS (
            SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
                   CAST(len(w) < 200 AS INTEGER)
                   + CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) * 2
                   + CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER) * 4
                   + CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) * 8
                   + CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INTEGER) * 16 AS bits
            FROM d LEFT JOIN l USING (doc_id)
        ), c AS (
            SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL
        ), letters(x) AS (
            VALUES ('A'), ('B'), ('C'), ('D'), ('E')
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT o, CAST(s AS INTEGER) AS step, 1 << (ascii(o[s]) - 65) AS bit,
                   coalesce(list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65))), 0)::BIGINT AS before
            FROM orders, range(1, 6) r(s)
        ), counted AS (
            SELECT part, o AS filter_order, step, bit,
                   sum(CASE WHEN bits & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
            FROM c, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
        FROM counted
    """,
    "op8_url_filter": r"""
        WITH rules(h, p, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), rest AS (
            SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                                 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
            FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM rest
        ), fit AS (
            SELECT page_id, host, path, rules.h || rules.p AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rules.h || rules.p) DESC NULLS LAST, length(rules.h) DESC) AS rn
            FROM parts LEFT JOIN rules
              ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE rn = 1
    """,
}
