"""Queries over the document tables, one for each operator, and their SQL.

Each query runs its operator with production parameters over its whole table
and derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare, spread
from . import bpe, embed_dedup, exact_dedup, mixing, periodic_runs, pii, quality, simhash, source_audit, suffix_dedup, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), k AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM n
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM k
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    counts.append(F.size("spans").cast("long").alias("n_spans"))
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


_PII_FINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", pii.IBAN),
    ("ssn", pii.SSN),
    ("secret", pii.SECRET),
)
OP2_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(f"SELECT n, t, {k} AS ord, '{kind}' AS kind, regexp_extract_all(t, '(?s)(.*?)({p})', 1) AS gaps, regexp_extract_all(t, '(?s)(.*?)({p})', 2) AS hits FROM d" for k, (kind, p) in enumerate(_PII_FINDS))
    + r"""
), s AS (
  SELECT n, t, ord, kind, hits[i] AS v, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM f)
), p AS (
  SELECT n, t, ord, kind, v, a::BIGINT AS a, (a + length(v))::BIGINT AS b, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v, ' ', '') AS plain FROM s
), q AS (
  SELECT *, lower((CASE WHEN a > 40 THEN substr(t, a - 39, 40) ELSE substr(t, 1, a) END) || ' ' || substr(t, b + 1, 40)) AS near,
         (CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END) || substr(t, b + 1, 1) AS beside,
         substr(plain, 5) || substr(plain, 1, 4) AS moved
  FROM p
), c AS (
  SELECT *, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN substr(digits, length(digits) - i, 1)::INT
      WHEN substr(digits, length(digits) - i, 1)::INT > 4 THEN 2 * substr(digits, length(digits) - i, 1)::INT - 9 ELSE 2 * substr(digits, length(digits) - i, 1)::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN NOT regexp_matches(beside, '[A-Za-z0-9]') AND list_reduce(list_concat([0], list_transform(range(1, length(moved) + 1), lambda i:
      CASE WHEN substr(moved, i, 1) <= '9' THEN ascii(substr(moved, i, 1)) - 48 ELSE ascii(substr(moved, i, 1)) - 55 END)), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
      AND 0.7 + CASE WHEN regexp_matches(near, 'RAISE_IBAN') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(near, 'LOWER_IBAN') THEN 0.3 ELSE 0 END >= 0.5
    WHEN 'ssn' THEN NOT regexp_matches(beside, '[0-9-]')
      AND 0.3 + CASE WHEN regexp_matches(near, 'RAISE_SSN') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(near, 'LOWER_SSN') THEN 0.3 ELSE 0 END >= 0.5
    ELSE length(digits) >= 5 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 AND len(list_distinct(string_split(v, ''))) >= 10
      AND 0.3 + CASE WHEN regexp_matches(near, 'RAISE_SECRET') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(near, 'LOWER_SECRET') THEN 0.3 ELSE 0 END >= 0.5 END AS ok
  FROM q
), g AS (
  SELECT n, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 4) AS base,
         count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn, count(*) FILTER (kind = 'secret') AS n_secret, count(*) AS n_spans
  FROM c WHERE ok GROUP BY n
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_secret, 0) AS n_secret, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""
)
for _kind in pii.EXTRA_KINDS:
    OP2_SQL = OP2_SQL.replace(f"RAISE_{_kind.upper()}", pii.RAISING[_kind]).replace(f"LOWER_{_kind.upper()}", pii.LOWERING[_kind])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embed_dedup.link_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a
), c AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


#: The made-up fetch day of a page: the tables have none.
FETCHED = "date_add(date'2024-01-01', cast(page_id % 366 as int))"


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_captures(pages, url_filter.entries(spark), fetched=F.expr(FETCHED)).withColumn("fetched", F.col("fetched").cast("string"))


OP5_SQL = (
    r"""
WITH e(kind, pattern, category, day, active) AS (VALUES
"""
    + ",\n".join(f"  ('{k}', '{p}', '{c}', DATE '{d}', {a})" for k, p, c, d, a in url_filter.ENTRIES)
    + r"""
), i AS (
  SELECT kind, pattern, category, day AS since, active, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS until FROM e
), p AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path,
         (DATE '2024-01-01' + (page_id % 366)::INT) AS fetched
  FROM pages
), h AS (
  SELECT p.page_id, i.category FROM p JOIN i ON i.active AND i.since <= p.fetched AND (i.until IS NULL OR p.fetched < i.until) AND (
    (i.kind = 'host' AND (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)))
    OR (i.kind = 'prefix' AND p.host <> '' AND (p.host || p.path = i.pattern OR starts_with(p.host || p.path, i.pattern || '/')))
    OR (i.kind = 'word' AND list_contains(string_split_regex(p.path, '[^a-z0-9]+'), i.pattern)))
), g AS (
  SELECT page_id, count(*) AS n_hits, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM h GROUP BY page_id
)
SELECT p.page_id, p.url, p.host, p.fetched::VARCHAR AS fetched, coalesce(g.n_hits, 0)::BIGINT AS n_hits, coalesce(g.categories, '') AS categories, g.n_hits IS NOT NULL AS blocked
FROM p LEFT JOIN g USING (page_id)
"""
)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, *tokenizer(), ids=False)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(docs, size_col="size").select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (ARRAY[3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[(nth % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER r AS place,
         (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
           / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)
), f AS (
  SELECT min(place) AS place FROM l WHERE level * weight <= cap
), t AS (
  SELECT source, source_size,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN cap ELSE (SELECT level FROM l, f WHERE l.place = f.place) * weight END AS target
  FROM l, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text")
    return token_counts.length_histogram(token_counts.token_lengths(docs, *tokenizer()))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs)


#: Bytes as pairs of hexadecimal digits.  Windows are cut out of parts of 1000 starts, as cutting from a whole text takes time with its length.
OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents
), p AS (
  SELECT n, n_bytes, unnest(range(0, greatest(n_bytes - 399, 0), 1000)) AS z FROM d
), q AS (
  SELECT p.n, p.z, substr(d.x, 2 * p.z + 1, 2798) AS part, least(1000, p.n_bytes - 399 - p.z) AS k FROM p JOIN d ON d.n = p.n
), i AS (
  SELECT n, z, part, unnest(range(0, k)) AS i FROM q
), w AS (
  SELECT n, z + i AS s, md5_number(substr(part, 2 * i + 1, 800)) AS h FROM i
), r AS (
  SELECT n, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), l AS (
  SELECT n, s, coalesce(s > lag(s) OVER (PARTITION BY n ORDER BY s) + 400, true) AS new FROM r
), e AS (
  SELECT n, s, sum(new::INT) OVER (PARTITION BY n ORDER BY s) AS run FROM l
), g AS (
  SELECT n, run, min(s) AS a, max(s) + 400 AS b FROM e GROUP BY n, run
), o AS (
  SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS since FROM g
), k AS (
  SELECT o.n, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(substr(d.x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM o JOIN d ON d.n = o.n GROUP BY o.n
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.n = d.n
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "source", "text")
    return source_audit.divergence(docs, least=3, most=200)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total,
         coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang), 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN vocabulary USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
         1 + (1000000000::HUGEINT * (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) + 1)) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


#: The words of op13: what its contract plants in every tenth text by the identifier's CRC-32.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    parts = docs.withColumns({"h": h, "g": F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 10")}).withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(_WORDS)))
    parts = parts.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])))")
    found = periodic_runs.periodic_runs(parts.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: Runs as islands of equal five-word windows a fixed distance apart: a run has five matching words or more.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))::BIGINT AS h
  FROM documents
), m AS (
  SELECT id, doc_id, w, h, h // 10 AS g, len(w)::BIGINT AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), x AS (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w
  FROM m
), t AS (
  SELECT id, n, unnest(range(0, n)) AS i, unnest(w) AS v FROM x
), f AS (
  SELECT id, n, i, md5_number(concat_ws(' ', v, lead(v, 1) OVER p, lead(v, 2) OVER p, lead(v, 3) OVER p, lead(v, 4) OVER p)) AS k FROM t WINDOW p AS (PARTITION BY id ORDER BY i)
), e AS (
  SELECT a.id, a.i, b.i - a.i AS q FROM f a JOIN f b ON a.id = b.id AND a.k = b.k AND b.i > a.i AND 4 * (b.i - a.i) <= a.n WHERE a.i + 5 <= a.n AND b.i + 5 <= b.n
), o AS (
  SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e
), s AS (
  SELECT id, q, min(i) AS start, count(*) + 4 + q AS length FROM o GROUP BY id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), r AS (
  SELECT id, start, length, min(q) AS period FROM s GROUP BY id, start, length
), gone AS (
  SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r
), c AS (
  SELECT t.id, string_agg(v, ' ' ORDER BY i) AS collapsed FROM t ANTI JOIN gone USING (id, i) GROUP BY t.id
), b AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'start': start, 'length': length, 'period': period}, {'l': -length, 's': start, 'p': period}) AS best
  FROM r GROUP BY id
)
SELECT x.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, b.best.start::BIGINT AS start, b.best.length::BIGINT AS length, b.best.period::BIGINT AS period,
       (1000 * b.best.length // b.best.period)::BIGINT AS exponent_milli, sha256(coalesce(b.lines, '')) AS runs_sha256, sha256(coalesce(c.collapsed, '')) AS collapsed_sha256
FROM x LEFT JOIN b USING (id) LEFT JOIN c USING (id)
"""


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_pii, op3_simhash, op4_embedding_links, op5_url_filter, op6_quality, op7_byte_bpe, op8_mix_sources, op9_token_counts, op10_suffix_dedup, op11_toxicity, op12_source_audit, op13_periodic_runs)
}

SQL = {"op1_exact_dedup": OP1_SQL, "op2_pii": OP2_SQL, "op4_embedding_links": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_mix_sources": OP8_SQL, "op10_suffix_dedup": OP10_SQL, "op12_source_audit": OP12_SQL, "op13_periodic_runs": OP13_SQL}
