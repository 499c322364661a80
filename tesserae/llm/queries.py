"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE`` has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontaminate, jaccard, langid, mainhtml, maxscore, packing, periodicity, quality, simhash, substring, warc, whitening
from tesserae.session import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def fold(parts: int, key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % parts


@query
def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(fold(3) != 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold(5) != 0).filter("lang is not null"))
    return langid.predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op8_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    lexicon = bpe.compile_lexicon(docs, vocabulary)
    return bpe.encode(docs, vocabulary, lexicon, output="digest")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = packing.sequences(docs, stored(packing.pack(docs), "packed"))
    return made.select("bin_id", "bin_length", F.col("keys").alias("doc_ids"), "lengths", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("tokens_sha256"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


ORACLE["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""


@query
def op6_main_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantised(F.col("embedding")).alias("vec"))
    queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return maxscore.top_k(vectors, queries, k=5)


ORACLE["op2_maxscore"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = simhash.compare_edited(table(spark, sf_dir, "documents"))
    counted = simhash.near_counts(compared, F.col("doc_id") % 20 == 0)
    return counted.select(
        "doc_id", "n_chars", "edited_sha256",
        simhash.hexadecimal(F.col("hi"), F.col("lo")).alias("fingerprint"), simhash.hexadecimal(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint"),
        "near_edited", "near_next", "n_near",
    )


@query
def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


ORACLE["op4_jaccard_components"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 90 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reach)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query
def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(table(spark, sf_dir, "documents"))[1]


ORACLE["op4_jaccard_links"] = ORACLE["op4_jaccard_components"].partition("r AS (")[0].replace("WITH RECURSIVE", "WITH").rstrip().rstrip(",") + r""",
h AS (SELECT doc_id, md5(array_to_string(list_sort(list(g)), chr(1))) AS h FROM s GROUP BY doc_id),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM h),
k AS (SELECT u AS doc_id, count(*) AS k FROM l GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(e.class_id, w.doc_id) AS class_id, coalesce(k.k, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_kept.n_words", "_kept.n_removed", F.sha2(F.col("_kept.text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op7_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit, items = F.col("_found.n_hit"), F.col("_found.items")
    listed = F.sha2(F.array_join(items, ",").cast("binary"), 256)
    return found.select("doc_id", "_found.n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), listed.alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE["op13_decontamination"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
p AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
h AS (SELECT r, i, k, item_id FROM g JOIN p USING (k, g)),
c AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS w FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # One document in ten repeats a stretch of its words to its end.
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    n = F.size("ws").cast("long")
    a = F.col("g") % n
    p = (F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1).cast("int")
    planned = split.withColumn("a", F.when(n > 0, a).cast("int")).withColumn("p", F.when(F.col("a").isNotNull(), p))
    rest = (n - F.col("a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    repeated = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), again), " ")
    found = periodicity.periodic_runs(planned.select("doc_id", F.when(F.col("p").isNotNull(), repeated).otherwise(F.col("text")).alias("text")), keep=["doc_id"])
    runs = F.col("_periodic.runs")
    # The greatest exact length / period; of two the one that starts first, then that of the shorter period.
    ratio = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda s, r: F.when(ratio(r, s) > 0, r).otherwise(s))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), F.col("_periodic.text").alias("kept"))
    return found.select(
        "doc_id", "n_runs", *(F.col("best")[c].alias(c) for c in ("start", "length", "period")), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLE["op12_periodic_runs"] = r"""
WITH z AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || [ascii(x)::UBIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, k: xor(e >> 1, 3988292384::UBIGINT * (e & 1)))))::BIGINT AS h
    FROM documents),
y AS (SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS changed, (h // 10) % greatest(len(ws), 1) AS a FROM z),
x AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS q FROM y),
d AS (SELECT r, doc_id, n, CASE WHEN changed THEN [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END] FOR i IN range(n)] ELSE ws END AS ws FROM x),
w AS (SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS v FROM d),
g AS (SELECT r, unnest([array_to_string(ws[i:i + 15], ' ') FOR i IN range(1, len(ws) - 14)]) AS g FROM d WHERE n >= 24),
m AS (SELECT DISTINCT r FROM (SELECT r FROM g GROUP BY r, g HAVING count(*) > 1)),
k AS (SELECT * FROM w SEMI JOIN m USING (r)),
e AS (SELECT a.r, b.i - a.i AS p, a.i FROM k a JOIN k b ON a.r = b.r AND a.v = b.v AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
l AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM e),
o AS (SELECT r, p, min(i) AS s, count(*) + p AS z FROM l GROUP BY r, p, g HAVING count(*) + p >= greatest(24, 3 * p)),
u AS (SELECT r, s, z, min(p) AS p FROM o GROUP BY r, s, z),
t AS (
    SELECT r, count(*) AS n_runs, string_agg(s || ',' || z || ',' || p || chr(10), '' ORDER BY s, p) AS lines,
        first({'s': s, 'z': z, 'p': p} ORDER BY z / p DESC, s, p) AS best FROM u GROUP BY r),
c AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + p, s + z)) AS i FROM u) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.z::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.z // best.p)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[i + 1] FOR i IN range(n) IF NOT list_contains(gone, i)] END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN c USING (r)
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select(F.col("key").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
