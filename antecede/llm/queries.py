"""One query per operator, with the parameters of a production run, and check SQL where it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antecede.llm import (
    decontaminate, exact_dedup, importance, language, lexical_search, line_dedup, minhash, mixing, quality, secret_scan, suffix_dedup, toxicity, warc,
)
from antecede.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, folder, "documents"))


@query("op5_exact_dedup", """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op1_minhash", """
WITH tokens AS (
    SELECT doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS t
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]]
        ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS s
    FROM tokens
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
    SELECT a.doc_id AS u, b.doc_id AS v
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
    WITH RECURSIVE r(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM r JOIN links l ON r.v = l.u)
    SELECT u, min(v) AS v FROM r GROUP BY u
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.v, d.doc_id)) AS component_id,
    least(d.doc_id, coalesce(r.v, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.u = d.doc_id
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=2)


@query("op7_line_dedup", r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
    FROM documents WHERE text IS NOT NULL
), h AS (
    SELECT doc_id, place, line, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS hash,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 AS long,
        count(*) OVER (PARTITION BY line) > 1 AS known
    FROM l
), u AS (
    SELECT *, coalesce(known <> lead(known) OVER w OR long OR lead(long) OVER w, true) AS run_ends
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), v AS (SELECT *, coalesce(lag(run_ends) OVER (PARTITION BY doc_id ORDER BY place), true) AS run_starts FROM u),
x AS (
    SELECT *, run_ends OR (CASE WHEN run_starts THEN 0 ELSE lag(hash) OVER w % 1000003 END * 31 + hash % 1000003) % 8 = 0 AS cut
    FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), e AS (
    SELECT *, run_ends OR (cut AND NOT run_starts AND NOT coalesce(lead(cut) OVER (PARTITION BY doc_id ORDER BY place), false)) AS ends FROM x
), n AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
    FROM e
), c AS (
    SELECT doc_id, part, min(place) AS start, count(*) AS size, string_agg(line, chr(10) ORDER BY place) AS bytes
    FROM n GROUP BY doc_id, part HAVING bool_and(known) AND (count(*) > 1 OR bool_or(long))
), g AS (
    SELECT doc_id, part, size, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) > 1 AS gone FROM c
), r AS (SELECT doc_id, part, size FROM g WHERE gone),
t AS (
    SELECT n.doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE r.part IS NULL), '') AS text, count(*) AS n_lines,
        count(r.part) AS removed_lines, count(DISTINCT r.part) AS removed_chunks
    FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND n.part = r.part GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_chunks, 0) AS removed_chunks,
    coalesce(removed_lines, 0) AS removed_lines, t.text
FROM documents d LEFT JOIN t USING (doc_id)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents")).drop("row")


@query("op3_decontaminate")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.convert(table(spark, folder, "pages"))


@query("op11_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
w AS (
    SELECT doc_id, unnest(range(n_bytes - 99)) AS p, unnest(list_transform(range(n_bytes - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS k
    FROM d WHERE n_bytes >= 100
), g AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS place FROM w) WHERE place > 1
), b AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS opens FROM g),
r AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS z FROM r GROUP BY doc_id, run),
k AS (
    SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM s
), t AS (
    SELECT k.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept
    FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.substring_dedup(table(spark, folder, "documents")))


@query("op12_lexical_search", r"""
WITH t AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
f AS (SELECT term, floor(1000 * ln((2 * c.N + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.N),
i AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n.n * c.N) // c.L)))))::BIGINT AS score
    FROM i JOIN p USING (term) JOIN f USING (term) JOIN n USING (doc_id), c GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_importance", r"""
WITH RECURSIVE bits(b, c, step) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
texts AS (
    SELECT row_number() OVER () AS row, true AS own, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), false, NULL, text FROM benchmark
), words AS (
    SELECT row, own, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts
), runs AS (
    SELECT row, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
    FROM words
), counted AS (SELECT row, own, f, count(*) AS n FROM runs GROUP BY ALL),
kinds AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counted), crc
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::BIGINT AS t
    FROM counted JOIN kinds USING (f) GROUP BY bucket
), sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN kinds USING (f) JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
    SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (row) WHERE own
), drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20),
quota AS (SELECT 5 * count(*) // 100 AS k FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored LEFT JOIN drawn USING (row), quota
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
