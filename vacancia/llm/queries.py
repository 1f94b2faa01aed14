"""One registered query for each operator of this package, with its SQL twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, exact_dedup, lm_scoring, mixing, quality, repeats, sharding, simhash, spelling, token_counts, token_files, warc, whitening
from vacancia.llm.common import configured, table
from vacancia.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = configured(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP1 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k"""


@query("op1_warc", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)"""


@query("op2_exact_dedup", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each run: a run's figures then never rest on what an earlier one stored.
    cache = scratch_path(spark, "token-cache")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(CAST(doc_id AS VARCHAR) || 'mix') AS ord FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM s),
     c AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM w),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
           FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f AS (SELECT *, cap <= level * w AS is_full FROM l),
     t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (max(CASE WHEN NOT is_full THEN level END) OVER ()) * w END AS target FROM f),
     q AS (SELECT d.doc_id, d.size, d.ord, t.source_size, t.target,
                  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     k AS (SELECT *, (source_size * turn + upto) / target AS time FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
     m AS (SELECT doc_id, size, sum(size) OVER (ORDER BY time, ord, turn, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM k),
     x AS (SELECT doc_id, sum(size) AS taken FROM m WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN x USING (doc_id)"""


@query("op5_mixing", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-files"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM bi),
     di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
     dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
     m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
     p AS (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m),
     h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM p GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op7_decontamination", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
     o AS (SELECT doc_id, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS v, w[i] AS w FROM i),
     c2 AS (SELECT v, w, count(*) AS c FROM o GROUP BY v, w),
     cv AS (SELECT v, count(*) AS n FROM (SELECT '' AS v FROM d WHERE len(w) > 0 UNION ALL SELECT w FROM o) GROUP BY v),
     s AS (SELECT c2.v, c2.w, ln(CASE WHEN c2.c >= 2 THEN c2.c::DOUBLE / a.n ELSE 0.4::DOUBLE * b.n / (SELECT count(*) FROM o)::DOUBLE END) AS s
           FROM c2 JOIN cv a ON a.v = c2.v JOIN cv b ON b.v = c2.w),
     t AS (SELECT o.doc_id, count(*) AS n, sum(s.s) AS s FROM o JOIN s ON o.v = s.v AND o.w = s.w GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(t.s, 0), 4) AS log_score, round(t.s / t.n, 4) AS mean_log_score
FROM d LEFT JOIN t USING (doc_id)"""


@query("op9_lm_scoring", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP11 = r"""
WITH RECURSIVE
     t0 AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM (SELECT unnest(range(256)) AS b)),
     d AS (SELECT CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) || ':' AS id,
                  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
     r AS (SELECT id, w, count(*) AS n, hex(encode(id || w)) AS h FROM d GROUP BY id, w),
     tk AS (SELECT 0 AS k, b, c FROM t0 UNION ALL
            SELECT k + 1, tk.b, xor(tk.c >> 8, t0.c) FROM tk JOIN t0 ON t0.b = tk.c & 255 WHERE k < (SELECT max(len(h)) // 2 FROM r)),
     z AS (SELECT 0 AS k, 4294967295 AS c UNION ALL
           SELECT k + 1, xor(z.c >> 8, t0.c) FROM z JOIN t0 ON t0.b = z.c & 255 WHERE k < (SELECT max(len(h)) // 2 FROM r)),
     y AS (SELECT id, w, len(h) // 2 AS m, unnest(range(len(h) // 2)) AS i, h FROM r),
     x AS (SELECT y.id, y.w, any_value(y.m) AS m, bit_xor(tk.c) AS c FROM y JOIN tk ON tk.k = y.m - 1 - y.i AND tk.b = CAST('0x' || substr(y.h, 2 * y.i + 1, 2) AS BIGINT) GROUP BY y.id, y.w),
     s AS (SELECT r.w, r.n, xor(xor(x.c, z.c), 4294967295) AS crc FROM r JOIN x USING (id, w) JOIN z ON z.k = x.m),
     u AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, CAST(crc % len(w) AS BIGINT)) || substr(w, CAST(crc % len(w) AS BIGINT) + 2) ELSE w END AS word, n FROM s),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM u WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     p AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS del FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
     e AS (SELECT a.word, b.word AS other, b.n AS m FROM p a JOIN p b ON a.del = b.del AND a.i = b.i AND a.word <> b.word
           UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = p.del
           UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = p.del),
     f AS (SELECT word, count(*) AS n_near, min({'m': -m, 'o': other}) AS best FROM e GROUP BY word),
     g AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN -f.best.m >= 2 * v.n THEN f.best.o END AS form, CASE WHEN -f.best.m >= 2 * v.n THEN -f.best.m END AS form_n
           FROM v LEFT JOIN f USING (word)),
     l AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM g UNION ALL
           SELECT l.word, g.form, true FROM l JOIN g ON g.word = l.root WHERE l.more AND g.form IS NOT NULL),
     q AS (SELECT l.word, l.root FROM l JOIN g ON g.word = l.root WHERE g.form IS NULL)
SELECT g.word, g.form, q.root, g.n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n FROM g JOIN q USING (word)"""


@query("op11_spelling_groups", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_sharding")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return sharding.shard_documents(table(spark, sf_dir, "documents"), rows)
