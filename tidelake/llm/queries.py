"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import align, ann, decontaminate, lm, minhash, mixing, quality, repeats, simhash, spelling, token_files, tokens, urls
from tidelake.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


@register("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register(
    "op2_benchmark_decontamination",
    r"""
    WITH lower AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower),
    b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT item, q, size, array_to_string(w[q + 1 : q + size], ' ') AS k FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS q FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT r, p, size, array_to_string(w[p + 1 : p + size], ' ') AS k FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT r, p, size, item, q FROM dw JOIN bw USING (size, k)),
    hits AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + size)) AS x FROM m) GROUP BY r),
    items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
    chains AS (SELECT r, item, min(p) AS p, min(q) AS q, count(DISTINCT p) + size - 1 AS words FROM (SELECT DISTINCT r, item, p, q, size, p - dense_rank() OVER (PARTITION BY r, item, size, p - q ORDER BY p) AS island FROM m) GROUP BY r, item, size, p - q, island),
    best AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, p, item, q) = 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.told, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated,
        best.words::BIGINT AS longest_words, best.p::BIGINT AS longest_doc_at, best.item AS longest_item_id, best.q::BIGINT AS longest_item_at
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
    """.strip(),
)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("__longest.words").alias("longest_words"),
        F.col("__longest.doc_at").alias("longest_doc_at"),
        F.col("__longest.item").alias("longest_item_id"),
        F.col("__longest.item_at").alias("longest_item_at"),
    )


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@register(
    "op5_url_filters",
    r"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
        ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
    urls AS (SELECT DISTINCT host, path FROM parts),
    best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
    SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
    """,
)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge(pages, urls.rules(spark, URL_RULES), "allow", ("host", "path", "rule", "verdict"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@register(
    "op6_mixing_to_target_weights",
    r"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15) AS hash FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM totals),
    levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
    goals AS (SELECT source, source_size, least(cap, coalesce(first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS)
        OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, cap)) AS target FROM levels),
    rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM goals),
    placed AS (SELECT s.*, source_size, target, whole, target - whole * source_size AS part,
        sum(size) OVER (PARTITION BY s.source ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY s.source, hash) AS own
        FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, source_size, target,
        (size * (whole + CASE WHEN part > 0 AND upto - own / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
    """,
)
def op6_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], most=3)
    return found.select("doc_id", "size", "source_size", "target", "taken")


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tables/{uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end=1)
    return token_files.read(spark, path)


@register("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), ("content_score", "metadata_score", "score"))
    return found.select("doc_id", "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("accepted"))


@register("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


@register(
    "op3_repeated_passages",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    parts AS (SELECT r, n, c, substr(h, 800 * c + 1, 1598) AS part FROM (SELECT r, h, len(h) // 2 AS n, unnest(range(0, (len(h) // 2 - 400) // 400 + 1)) AS c FROM d WHERE len(h) >= 800)),
    w AS (SELECT r, 400 * c + o AS p, md5(substr(part, 2 * o + 1, 800)) AS k FROM (SELECT r, c, part, unnest(range(0, least(400, n - 399 - 400 * c))) AS o FROM parts)),
    hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    numbered AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit),
    spans AS (SELECT r, min(p) AS a, max(p) + 400 AS e FROM numbered GROUP BY r, g),
    cuts AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS left_at FROM spans),
    told AS (SELECT r, sum(e - a) AS n, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * left_at + 1, 2 * (a - left_at)), '' ORDER BY a) AS kept FROM cuts JOIN d USING (r) GROUP BY r)
    SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN told USING (r)
    """,
)
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=400)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))


@register(
    "op11_minhash_near_dedup",
    r"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
    shared AS (SELECT a.r AS u, b.r AS v, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
    links AS MATERIALIZED (SELECT u, v FROM shared JOIN sizes x ON x.r = u JOIN sizes y ON y.r = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
    edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach(r, c) AS (SELECT r, r FROM sizes UNION SELECT edges.v, reach.c FROM reach JOIN edges ON edges.u = reach.r),
    ids AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.c GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
        coalesce(doc_id = CASE WHEN n IS NULL THEN doc_id ELSE component_id END, false) AS kept
    FROM d LEFT JOIN sizes USING (r) LEFT JOIN ids USING (r)
    """,
)
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, share=0.85)


@register("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@register(
    "op13_spelling_variants",
    r"""
    WITH RECURSIVE table_of AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS name, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    distinct_runs AS MATERIALIZED (SELECT name, run, count(*) AS n, hex(encode(name || ':' || run)) AS h FROM runs WHERE length(run) >= 7 GROUP BY name, run),
    coded AS (SELECT run, n, list_transform(range(0, len(h) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::UBIGINT) AS bytes FROM distinct_runs),
    hashed AS (SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]))) AS crc FROM coded, table_of),
    given AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM given WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    holes AS MATERIALIZED (SELECT word, n, length(word) AS size, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
    pairs AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.size = b.size AND a.p = b.p AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
    near AS (SELECT word, count(*) AS n_near, arg_max(other, (n, -rank)) AS form, max(n) AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY encode(other)) AS rank FROM pairs) GROUP BY word),
    forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN near USING (word)),
    chains(word, root, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word) USING (word)
    """,
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=31, least=7, times=2, ratio=10)
