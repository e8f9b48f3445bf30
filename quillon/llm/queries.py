"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, bpe, configuration, encoding, hamming, langid, licenses, simhash, substring, urlfilter
from .common import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every hundredth vector."""
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(ann.usable("embedding")).select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    queries = codes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "code")
    return hamming.search(codes, queries, k=10).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


#: Day 0 of the list and of the captures in op2.
FIRST_DAY = "2024-01-01"


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list, as it was on the page's fetch day.

    The tables hold neither days nor a list, so both follow from them: a page is fetched page_id mod 365 days
    after the first day; and a third of the hosts, and of the domains above them, are listed on a day that
    their MD5 gives, of which half are removed 30 to 93 days later and listed again 40 days after that.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(365)).cast("int")).alias("fetched"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("domain")).where(r"domain rlike '\\.[^.]+\\.'").distinct()
    code = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("int")
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(code, F.lit(200)))
    stop = F.date_add(start, 30 + F.pmod(code, F.lit(64)))
    listed = domains.where(F.pmod(code, F.lit(3)) == 0)
    again = listed.where(F.pmod(code, F.lit(2)) == 0)
    entries = listed.select("domain", start.alias("day"), F.lit(True).alias("listed")).union(again.select("domain", stop, F.lit(False))).union(again.select("domain", F.date_add(stop, 40), F.lit(True)))
    return urlfilter.flag(pages, entries).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "is_listed", "matched_domain", F.col("listed_from").cast("string").alias("listed_from"), F.col("listed_to").cast("string").alias("listed_to"))


def op3_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configuration.pack(_documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"), most=2048, end=0)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(_documents(spark, sf_dir), bpe.vocabulary("byte_bpe_50k.json"))


def held_out() -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.learn(docs, ~held_out())
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir), threshold=0.8).withColumn("score", F.round("score", 6))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir), shingle=3, distance=2, seed=42)


def op8_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), window=20)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_bestfit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed sequence, its matrices as checksums."""
    packed = bestfit.pack(_documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"), most=2048, end=0)
    return packed.select("shard", "sequence", "n_tokens", F.size("docs").alias("n_segments"), F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "docs", "pieces")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_url_lists": op2_url_lists,
    "op3_config_packing": op3_config_packing,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_simhash": op7_simhash,
    "op8_collision_ann": op8_collision_ann,
    "op9_substring": op9_substring,
    "op10_bestfit_matrix": op10_bestfit_matrix,
}

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, " ".join(licenses.normalise(t))) for i, (n, t) in enumerate(licenses.TEMPLATES))

ORACLES: dict[str, str] = {
    "op1_hamming_topk": rf"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
        q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
        d AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
              FROM q JOIN v ON q.vec_id <> v.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10""",
    "op2_url_lists": rf"""
        WITH p AS (SELECT page_id, CAST(DATE '{FIRST_DAY}' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched,
                nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '^www\.', ''), '') AS host FROM pages),
        h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
        dom AS (SELECT DISTINCT domain FROM (SELECT host AS domain FROM h UNION ALL SELECT regexp_replace(host, '^[^.]+\.', '') FROM h) WHERE regexp_matches(domain, '\.[^.]+\.')),
        c AS (SELECT domain, CAST(concat('0x', substr(md5(domain), 1, 6)) AS INTEGER) AS code FROM dom),
        l AS (SELECT domain, code, CAST(DATE '{FIRST_DAY}' + code % 200 AS DATE) AS s, CAST(DATE '{FIRST_DAY}' + code % 200 + 30 + code % 64 AS DATE) AS e FROM c WHERE code % 3 = 0),
        i AS (SELECT domain, s AS f, CASE WHEN code % 2 = 0 THEN e END AS t FROM l UNION ALL SELECT domain, CAST(e + 40 AS DATE), NULL FROM l WHERE code % 2 = 0),
        m AS (SELECT p.page_id, i.domain, i.f, i.t, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.domain) DESC, i.domain, i.f) AS n
              FROM p JOIN i ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND i.f <= p.fetched AND (i.t IS NULL OR p.fetched < i.t))
        SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, m.domain IS NOT NULL AS is_listed, m.domain AS matched_domain, CAST(m.f AS VARCHAR) AS listed_from, CAST(m.t AS VARCHAR) AS listed_to
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1""",
    "op6_license_scan": rf"""
        WITH t(tid, license, body) AS (VALUES {_TEMPLATES}),
        tw AS (SELECT tid, license, string_split(body, ' ') AS w FROM t),
        tg AS (SELECT tid, g, count(*) AS n FROM (SELECT tid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw) GROUP BY ALL),
        ts AS (SELECT tid, license, len(w) - 1 AS size FROM tw),
        k AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT uid, s, w[s] || ' ' || w[s + 1] AS g FROM (SELECT uid, w, unnest(range(1, len(w))) AS s FROM k WHERE len(w) > 1)),
        h AS (SELECT p.uid, tg.tid, p.s, p.g, tg.n FROM p JOIN tg USING (g)),
        u AS (SELECT h.uid, h.tid, h.s, least(ts.size, len(k.w) - h.s) AS a, ts.size AS b FROM h JOIN ts USING (tid) JOIN k USING (uid)),
        c AS (SELECT u.uid, u.tid, u.s, u.a, u.b, h.g, least(count(*), min(h.n)) AS common FROM u JOIN h ON u.uid = h.uid AND u.tid = h.tid AND h.s >= u.s AND h.s < u.s + u.a GROUP BY ALL),
        d AS (SELECT c.uid, c.tid, c.s, c.a + 1 AS words, ts.license, 2.0::DOUBLE * sum(c.common) / (c.a + c.b) AS dice FROM c JOIN ts USING (tid) GROUP BY c.uid, c.tid, c.s, c.a, c.b, ts.license),
        f AS (SELECT *, row_number() OVER (ORDER BY dice DESC, words DESC, license, s, tid) AS place FROM d WHERE dice >= 0.8),
        best AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.uid = f.uid AND o.s < f.s + f.words AND f.s < o.s + o.words AND o.place < f.place))
        SELECT k.doc_id, best.license, count(*) AS units, round(max(best.dice), 6) AS score FROM best JOIN k USING (uid) GROUP BY k.uid, k.doc_id, best.license""",
    "op9_substring": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (SELECT doc_id, s, list_slice(words, s, s + 19) AS body FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS n FROM g),
        gone AS (SELECT DISTINCT doc_id, s + i AS spot FROM r, range(0, 20) x(i) WHERE n > 1),
        e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM w),
        k AS (SELECT e.doc_id, count(gone.spot) AS n_removed, string_agg(CASE WHEN gone.spot IS NULL THEN word END, ' ' ORDER BY e.spot) AS kept FROM e LEFT JOIN gone USING (doc_id, spot) GROUP BY e.doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)""",
}
