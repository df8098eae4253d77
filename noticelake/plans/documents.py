"""Queries of the document operators."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions.text import hint_language, normalize_quote
from noticelake.operators import documents as D
from noticelake.operators import evidence as E
from noticelake.plans.registry import register, table


def _stop_table() -> str | None:
    """Spark's stop-word lists as SQL values, read from its own jar, so that no session is needed; None where that jar isn't at hand."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jars = sorted(glob.glob(f"{home}/jars/spark-mllib_*.jar") or glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/spark-mllib_*.jar"))
    if not jars:
        return None
    with zipfile.ZipFile(jars[0]) as jar:
        lists = {k: {w for w in jar.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode().split() if w.isalpha()} for k, name in D.LANGUAGES.items()}
    return "(VALUES " + ", ".join(f"('{k}', {i}, '{w}')" for i, (k, ws) in enumerate(lists.items()) for w in sorted(ws)) + ") AS s(language, rank, token)"


_STOP = _stop_table()


@register(
    "j01_f15_detect_language",
    _STOP and f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents), n AS (SELECT doc_id, count(*) AS total FROM t GROUP BY 1),
    h AS (SELECT doc_id, language, rank, count(*) AS hits FROM t JOIN {_STOP} USING (token) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rank) AS turn FROM h)
    SELECT d.doc_id, CASE WHEN total >= 20 AND hits / total >= 0.04 THEN language END AS language, CASE WHEN total >= 20 AND hits / total >= 0.04 THEN round(hits / total, 4) END AS confidence
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND turn = 1""",
)
def j01(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_language(table(spark, d, "documents"), D.stopwords())


@register(
    "j01_section_languages",
    _STOP and f"""WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS section, unnest(string_split(text, chr(10))) AS text FROM documents), t AS (SELECT doc_id, section, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM p),
    n AS (SELECT doc_id, section, count(*) AS total FROM t GROUP BY 1, 2), h AS (SELECT doc_id, section, language, rank, count(*) AS hits FROM t JOIN {_STOP} USING (token) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY hits DESC, rank) AS turn FROM h)
    SELECT doc_id, section, language, round(hits / total, 4) AS confidence FROM n JOIN b USING (doc_id, section) WHERE turn = 1 AND total >= 20 AND hits / total >= 0.04""",
)
def j01_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).withColumn("section", F.col("k") + 1)
    return D.detect_language(sections, D.stopwords(), ("doc_id", "section")).where("language IS NOT NULL")


_HITS = lambda ws: " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in ws)


@register("f16_hint_language", f"WITH d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents), h AS (SELECT *, {_HITS([' le ', ' la ', ' les ', ' des ', ' pour ', ' avec '])} AS fr, {_HITS([' o ', ' os ', ' para ', ' com ', ' uma ', ' não '])} AS pt FROM d) SELECT doc_id, CASE WHEN fr > pt AND fr >= 2 THEN 'fr' WHEN pt > fr AND pt >= 2 THEN 'pt' WHEN regexp_matches(t, '[éèêàçù]') THEN 'fr' ELSE 'en' END AS language FROM h")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hint_language(F.col("text")).alias("language"))


@register("f19_normalize_quote", r"SELECT doc_id, sha256(trim(regexp_replace(translate(text, '‘’‚‛“”„‟‐‑‒–—―' || chr(160) || chr(10) || chr(13) || chr(9), repeat(chr(39), 4) || repeat(chr(34), 4) || '------    '), ' +', ' ', 'g'))) AS quote FROM documents")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(normalize_quote(F.col("text")), 256).alias("quote"))


@register("a10_bundle_languages", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages, array_to_string(list_filter(list_sort(list_distinct(list(lang))), lambda x: x <> 'en'), ',') AS translate_from FROM documents GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise("")))
    docs = table(spark, d, "documents").select("source", tag.alias("tag")).unionByName(table(spark, d, "documents").select("source", F.col("lang").alias("tag")))
    out = D.bundle_languages(docs, "source", "tag")
    return out.select("source", F.array_join("languages", ",").alias("languages"), F.array_join("translate_from", ",").alias("translate_from"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum")), table(spark, d, "labels").dropDuplicates(["doc_id"])
    status = F.when(F.col("quality") == 0, "failed").when(F.col("quality").isNull(), "skipped").otherwise("extracted")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", "checksum", status.alias("status"), F.when(F.col("doc_id") % 50 == 0, "acquisition_failed").otherwise("unsupported").alias("reason"))


_OUT = "o AS (SELECT doc_id, source, sha256(text) AS checksum, CASE WHEN quality = 0 THEN 'failed' WHEN quality IS NULL THEN 'skipped' ELSE 'extracted' END AS status, CASE WHEN doc_id % 50 = 0 THEN 'acquisition_failed' ELSE 'unsupported' END AS reason FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"


@register("a09_bundle_completeness", f"WITH {_OUT} SELECT source, count_if(status = 'extracted') AS extracted, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped, bool_or(status = 'failed' OR status = 'skipped' AND reason = 'acquisition_failed') AS incomplete FROM o GROUP BY 1")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return D.bundle_completeness(outcomes(spark, d), "source")


@register("j17_reuse_duplicates", f"WITH {_OUT} SELECT doc_id, min(CASE WHEN status = 'extracted' THEN doc_id END) OVER (PARTITION BY source, checksum) AS master FROM o")
def j17(spark: SparkSession, d: str) -> DataFrame:
    return D.reuse_duplicates(outcomes(spark, d), "source").select("doc_id", "master")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"


@register(
    "j04_retrieve_evidence",
    f"""WITH RECURSIVE l AS (SELECT item_id AS req_id, unnest({_WORDS.format("text")}) AS token FROM benchmark), d AS (SELECT doc_id AS section_id, split_part(text, chr(10), 1) AS heading, substr(text, strpos(text, chr(10)) + 1) AS body, 'kind ' || source || ' in language ' || lang AS metadata FROM documents WHERE text IS NOT NULL),
    r AS (SELECT section_id, length(heading) + length(body) AS size, unnest({_WORDS.format("heading || ' ' || body || ' ' || metadata")}) AS token FROM d),
    s AS (SELECT req_id, section_id, any_value(size) AS size, count(*) AS score, string_agg('keyword:' || token, ',' ORDER BY token) AS signals FROM l JOIN r USING (token) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, CAST(section_id AS VARCHAR)) AS turn FROM s WHERE size <= 12000),
    f AS (SELECT req_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS section_id, CAST(NULL AS BIGINT) AS score, CAST(NULL AS VARCHAR) AS signals, false AS taken FROM (SELECT DISTINCT req_id FROM o)
      UNION ALL SELECT o.req_id, o.turn, CASE WHEN f.used + o.size <= 12000 AND f.n < 8 THEN f.used + o.size ELSE f.used END, CASE WHEN f.used + o.size <= 12000 AND f.n < 8 THEN f.n + 1 ELSE f.n END, o.section_id, o.score, o.signals, f.used + o.size <= 12000 AND f.n < 8 FROM f JOIN o ON o.req_id = f.req_id AND o.turn = f.turn + 1 AND f.n < 8)
    SELECT req_id, section_id, score, n - 1 AS position, signals FROM f WHERE taken""",
)
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections: the first line as heading, the rest as text, source and language as metadata."""
    reqs = table(spark, d, "benchmark").select(F.col("item_id").alias("req_id"), "text")
    heading = F.split_part("text", F.lit("\n"), F.lit(1))
    body = F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))
    metadata = F.concat(F.lit("kind "), F.col("source"), F.lit(" in language "), F.col("lang"))
    sections = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("section_id"), heading.alias("heading"), body.alias("text"), metadata.alias("metadata"))
    return E.retrieve_evidence(reqs, sections).withColumn("signals", F.array_join("signals", ","))


@register("j04_kb_sections", "SELECT p_partkey AS kb_id, 0 AS position, NULL AS heading, p_name AS text FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1 - (p_partkey % 2), 'Scope', p_type FROM part UNION ALL SELECT p_partkey, 2 - (p_partkey % 2), p_brand, 'size' || chr(10) || p_size FROM part")
def j04_sections(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit("\n"))).otherwise(""), F.lit("# Scope\n"), F.col("p_type"), F.lit("\n## "), F.col("p_brand"), F.lit("\nsize\n"), F.col("p_size").cast("string"))
    out = D.kb_sections(table(spark, d, "part").select(F.col("p_partkey").alias("kb_id"), content.alias("content")))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("kb_id").orderBy("position")) - 1)


_CHUNKS = "c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS location, unnest(string_split(text, chr(10))) AS text FROM documents)"


_NORM = "trim(regexp_replace(translate({}, chr(160) || chr(10) || chr(13) || chr(9), '    '), ' +', ' ', 'g'))"
_PIECE = "trim(split_part(quote, ' ... ', {}))"


@register(
    "j05_verify_quotes",
    f"""WITH {_CHUNKS}, n AS (SELECT *, {_NORM.format("text")} AS norm FROM c),
    p AS (SELECT *, coalesce(sum(CASE WHEN norm <> '' THEN length(norm) + 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY location ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS begins FROM n),
    w AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY location) FILTER (norm <> '') AS whole, count(*) AS lines, max(CASE WHEN location = 1 THEN text END) AS a, max(CASE WHEN location = 2 THEN text END) AS b, arg_max(text, location) AS z FROM p GROUP BY 1),
    q AS (SELECT doc_id AS cite_id, CASE doc_id % 10 WHEN 9 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE doc_id % 10 WHEN 2 THEN ['line:2'] WHEN 5 THEN ['line:1', 'line:2'] WHEN 7 THEN ['page:99'] ELSE ['line:1'] END AS cited,
      CASE doc_id % 10 WHEN 1 THEN replace(substr(a, 1, 40), ' ', '  ') WHEN 3 THEN substr(a, 1, 20) || 'zzzqqq' WHEN 4 THEN substr(a, 1, 24) || ' ... ' || right(z, 24) WHEN 5 THEN coalesce(b, 'no second line') WHEN 6 THEN right(a, 12) || ' ' || substr(b, 1, 12) WHEN 8 THEN '' ELSE substr(a, 1, 40) END AS quote FROM w),
    j AS (SELECT q.cite_id, q.doc_id, q.quote, coalesce({_NORM.format("q.quote")}, '') AS nq, coalesce(w.whole, '') AS whole, w.doc_id IS NULL AS missing FROM q LEFT JOIN w ON w.doc_id = q.doc_id),
    m AS (SELECT cite_id, count(p.doc_id) AS cited, min(CASE WHEN contains(p.text, q.quote) THEN p.location END) AS exact, min(CASE WHEN contains(p.norm, {_NORM.format("q.quote")}) THEN p.location END) AS near FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND list_contains(q.cited, 'line:' || p.location) GROUP BY 1),
    f AS (SELECT j.*, m.* EXCLUDE (cite_id), CASE WHEN nq <> '' THEN strpos(whole, nq) ELSE 0 END AS spot, list_filter([{_PIECE.format(1)}, {_PIECE.format(2)}], lambda x: length(x) > 15) AS pieces FROM j JOIN m USING (cite_id)),
    g AS (SELECT *, CASE WHEN len(pieces) > 0 THEN strpos(whole, {_NORM.format("pieces[1]")}) ELSE 0 END AS one, CASE WHEN len(pieces) > 1 THEN strpos(substr(whole, strpos(whole, {_NORM.format("pieces[1]")}) + length({_NORM.format("pieces[1]")})), {_NORM.format("pieces[2]")}) ELSE 1 END AS two FROM f),
    h AS (SELECT *, CASE WHEN missing THEN 'document_missing' WHEN cited = 0 THEN 'location_unknown' WHEN coalesce(quote, '') = '' THEN 'empty_quote' WHEN exact IS NOT NULL THEN 'exact' WHEN nq <> '' AND near IS NOT NULL THEN 'normalized' WHEN spot > 0 THEN 'document' WHEN one > 0 AND two > 0 THEN 'fragments' ELSE 'quote_not_found' END AS level FROM g)
    SELECT cite_id, level, CASE level WHEN 'exact' THEN 'line:' || exact WHEN 'normalized' THEN 'line:' || near WHEN 'document' THEN (SELECT 'line:' || max(location) FROM p WHERE p.doc_id = h.doc_id AND norm <> '' AND begins <= spot) WHEN 'fragments' THEN (SELECT 'line:' || max(location) FROM p WHERE p.doc_id = h.doc_id AND norm <> '' AND begins <= one) END AS found_at FROM h""",
)
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks; citations right, spaced, of another line, invented, with an ellipsis, with two locations, across lines, with unknown locations, empty, and of unknown documents."""
    docs = table(spark, d, "documents").where("text is not null")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("doc_id", F.concat(F.lit("line:"), (F.col("k") + 1).cast("string")).alias("location"), "text")
    k, lines = (F.col("doc_id") % 10).cast("int"), F.split("text", "\n")
    a, b, z = F.get("lines", 0), F.get("lines", 1), F.element_at("lines", -1)
    start, end = lambda c, n: F.substring(c, 1, n), lambda c, n: F.right(c, F.lit(n))
    quote = (
        F.when(k == 1, F.replace(start(a, 40), F.lit(" "), F.lit("  "))).when(k == 3, F.concat(start(a, 20), F.lit("zzzqqq"))).when(k == 4, F.concat(start(a, 24), F.lit(" ... "), end(z, 24)))
        .when(k == 5, F.coalesce(b, F.lit("no second line"))).when(k == 6, F.concat(end(a, 12), F.lit(" "), start(b, 12))).when(k == 8, "").otherwise(start(a, 40))
    )
    cited = F.when(k == 2, "line:2").when(k == 5, "line:1, line:2").when(k == 7, "page:99").otherwise("line:1")
    cites = docs.withColumn("lines", lines).select(F.col("doc_id").alias("cite_id"), F.when(k == 9, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), cited.alias("location"), quote.alias("quote"))
    return E.verify_quotes(cites, chunks, lambda c: normalize_quote(c, nfkc=True))


@register(
    "j11_plan_delivery",
    """WITH RECURSIVE p(provider_id, priority, max_file, max_files, max_message) AS (VALUES (1, 1, 20000, 10, 60000), (2, 2, 50000, 30, 150000), (3, 3, 5000, 100, 200000)),
    a AS (SELECT source AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, n_chars AS size FROM documents), t AS (SELECT id, count(*) AS total FROM a GROUP BY 1),
    f AS (SELECT id, provider_id, priority, max_file, max_files, max_message, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b FROM t, p
      UNION ALL SELECT f.id, provider_id, priority, max_file, max_files, max_message, a.pos, CASE WHEN size <= max_file AND n < max_files AND b + 4 * CAST(ceil(size / 3) AS BIGINT) <= max_message THEN n + 1 ELSE n END,
        CASE WHEN size <= max_file AND n < max_files AND b + 4 * CAST(ceil(size / 3) AS BIGINT) <= max_message THEN b + 4 * CAST(ceil(size / 3) AS BIGINT) ELSE b END FROM f JOIN a ON a.id = f.id AND a.pos = f.pos + 1),
    e AS (SELECT f.*, total, n = total AS whole FROM f JOIN t ON t.id = f.id AND pos = total),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY whole DESC, CASE WHEN whole THEN priority END, n DESC, b, priority) AS turn FROM e)
    SELECT id AS notification_id, provider_id, n AS attached, total - n AS linked FROM r WHERE turn = 1""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    attachments = table(spark, d, "documents").select(F.col("source").alias("notification_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    providers = spark.createDataFrame([(1, 1, 20000, 10, 60000), (2, 2, 50000, 30, 150000), (3, 3, 5000, 100, 200000)], "provider_id int, priority int, max_file long, max_files int, max_message long")
    return D.plan_delivery(attachments, providers)


@register(
    "w08_greedy_fit",
    """WITH RECURSIVE a AS (SELECT source AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, n_chars AS size FROM documents),
    f AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used FROM a
      UNION ALL SELECT f.id, a.pos, CASE WHEN used + size <= 20000 AND n < 12 THEN n + 1 ELSE n END, CASE WHEN used + size <= 20000 AND n < 12 THEN used + size ELSE used END FROM f JOIN a ON a.id = f.id AND a.pos = f.pos + 1)
    SELECT id AS source, max(n) AS n, max(used) AS used FROM f GROUP BY 1""",
)
def w08(spark: SparkSession, d: str) -> DataFrame:
    docs = D.first_by_size(table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("size")), ["source"], [F.col("doc_id")], "size", 20_000, 12)
    items = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size"))).alias("items"))
    taken = items.select("source", D.greedy_fit(F.col("items"), 20_000, 12).alias("taken"))
    return taken.select("source", F.size("taken").cast("long").alias("n"), F.aggregate("taken", F.lit(0).cast("long"), lambda acc, x: acc + x["size"]).alias("used"))


@register(
    "t01_split_segments",
    """WITH RECURSIVE d AS (SELECT doc_id, location, text FROM (SELECT doc_id, 'all' AS location, text FROM documents UNION ALL SELECT doc_id, 'line:1', split_part(text, chr(10), 1) FROM documents) WHERE text <> ''),
    s AS (SELECT doc_id, location, CAST(-1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS next FROM d
      UNION ALL SELECT doc_id, location, part + 1, next, next + CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN cut = 0 THEN 1000 ELSE 1001 - cut END
      FROM (SELECT *, substr(text, next + 1) AS rest, coalesce(list_min(list_filter([strpos(back, ' '), strpos(back, chr(10))], lambda x: x > 0)), 0) AS cut FROM (SELECT s.*, d.text, reverse(substr(d.text, next + 501, 500)) AS back FROM s JOIN d USING (doc_id, location) WHERE next < length(d.text))))
    SELECT doc_id, location, part, start, next - start AS n, sha256(substr(text, start + 1, next - start)) AS text FROM s JOIN d USING (doc_id, location) WHERE part >= 0""",
)
def t01(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.lit("all").alias("location"), "text").unionByName(docs.select("doc_id", F.lit("line:1").alias("location"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")))
    parts = E.split_chunks(chunks, 1000)
    return parts.select("doc_id", "location", F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text"))


@register("t04_flatten_sections", f"WITH {_CHUNKS} SELECT doc_id, 'section:' || location AS location, length(text) AS n_chars FROM c WHERE trim(text) <> '' UNION ALL SELECT doc_id, 'document', length(text) FROM documents WHERE trim(replace(text, chr(10), '')) = ''")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return D.flatten_sections(table(spark, d, "documents")).select("doc_id", "location", F.length("text").cast("long").alias("n_chars"))


@register(
    "t04_flatten_bundle",
    """WITH p AS (SELECT * FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey AS doc_id, 'page:1' AS location, p_name AS text FROM p UNION ALL SELECT p_partkey, 'page:2', p_type FROM p
    UNION ALL SELECT p_partkey, 'table:1', 'brand | size' || chr(10) || p_brand || ' | ' || p_size FROM p UNION ALL SELECT p_partkey, 'section:Scope', p_type FROM p UNION ALL SELECT p_partkey, 'document', p_name FROM part WHERE p_partkey % 5 = 0""",
)
def t04_bundle(spark: SparkSession, d: str) -> DataFrame:
    some, text = F.col("p_partkey") % 5 != 0, lambda c: F.col(c).cast("string")
    pages = F.when(some, F.array("p_name", "p_type"))
    tables = F.when(some, F.array(F.struct(F.lit("Prices").alias("section"), F.array(F.array(F.lit("brand"), F.lit("size")), F.array(text("p_brand"), text("p_size"))).alias("rows"))))
    section = lambda h, t, is_table: F.struct(F.lit(h).alias("heading"), t.alias("text"), F.lit(is_table).alias("is_table"))
    sections = F.when(some, F.array(section("Scope", F.col("p_type"), False), section("Prices", F.lit("brand size"), True)))
    return D.flatten_bundle(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), pages.alias("pages"), tables.alias("tables"), sections.alias("sections"), F.col("p_name").alias("text")))


@register("u03_version_diff", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT line, count_if(doc_id % 2 = 1) - count_if(doc_id % 2 = 0) AS n FROM l GROUP BY 1) SELECT sha256(line) AS line, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, abs(n) AS times FROM n WHERE n <> 0")
def u03(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return D.version_diff(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1")).withColumn("line", F.sha2("line", 256))


@register("u04_common_vocabulary", "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM documents) SELECT item_id, len(list_intersect(b.t, d.t)) AS common, array_to_string(list_transform(list_sort(list_intersect(b.t, d.t)), lambda x: 'keyword:' || x), ',') AS signals FROM b JOIN d ON doc_id = item_id")
def u04(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return D.common_vocabulary(table(spark, d, "benchmark").select("item_id", "text"), sections, "item_id").withColumn("signals", F.array_join("signals", ","))


@register("u05_new_versions", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def u05(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", "text")
    return D.new_versions(v.where("doc_id % 2 = 1"), v.where("doc_id % 2 = 0"), "text").select("doc_id")
