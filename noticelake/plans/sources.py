"""Queries of the landed sources."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.plans.documents import _OUT, outcomes
from noticelake.plans.registry import register, shared_dir, table
from noticelake.sources import landed as L
from noticelake.sources.registry import read_sources

_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '[\\t-\\r \\x{{85}}\\x{{A0}}]+', ' ', 'g'))"
_BASE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


@register("s01_html_listings", f"""WITH c AS (SELECT page_id, {_BASE} AS o, html, page_id % 4 AS k FROM pages WHERE page_id % 11 <> 0)
    SELECT page_id, CAST(page_id * 3 AS VARCHAR) AS external_id, o || '/notices/n' || page_id * 3 || '/list' AS link, {_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title, CAST(1700000000 + page_id AS BIGINT) AS published,
      CASE k WHEN 0 THEN 1790254800 WHEN 1 THEN 1767225600 + 86400 * (page_id % 30 + 1) END AS deadline, CASE k WHEN 1 THEN (page_id % 30 + 1) || ' days left' WHEN 2 THEN 'Closing soon' END AS deadline_raw, CASE WHEN page_id % 2 = 0 THEN 'REF/' || page_id END AS reference, CAST(NULL AS VARCHAR) AS error_code FROM c
    UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parser_mismatch' FROM pages WHERE page_id % 11 = 0""")
def s01(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    number = (k * 3).cast("string")
    due = F.when(k % 4 == 0, "Deadline: 24 September 2026 at 1.00 pm GMT").when(k % 4 == 1, F.concat((k % 30 + 1).cast("string"), F.lit(" days left"))).when(k % 4 == 2, "Closing soon").otherwise("no date")
    link = F.when(k % 11 == 0, '<a href="/about">about</a>').otherwise(F.concat(F.lit('<a href="../notices/./n'), number, F.lit('/list">see</a>')))
    card = F.concat(F.lit("<article>"), link, F.lit("<i>"), F.date_format(F.timestamp_seconds(1700000000 + k), "yyyy-MM-dd HH:mm:ss"), F.lit("</i><b>"), due, F.lit("</b><u>"), F.when(k % 2 == 0, F.concat(F.lit("REF/"), text)).otherwise(""), F.lit("</u>"), F.regexp_extract("html", "(<h1>[^<]*</h1>)", 1), F.lit("</article>"))
    url = F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/all/x"))
    p = table(spark, d, "pages").select("page_id", url.alias("url"), F.concat(F.lit("<html>"), card).alias("html"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    out = L.read_html_listings(p, L.Listing(r"<article>[\s\S]*?</article>", r'href="([^"]*/n([0-9]+)/list)"', "<h1>([^<]*)</h1>", "<i>([^<]*)</i>", "<u>([^<]*)</u>", True))
    return out.select("page_id", "external_id", "link", "title", F.unix_timestamp("published").alias("published"), F.unix_timestamp("deadline").alias("deadline"), "deadline_raw", "reference", "error_code")


@register("s02_feed_listings", "SELECT page_id AS feed_id, k AS position, CASE WHEN k = 0 THEN 'g' || page_id WHEN k = 1 THEN 'n' || page_id || 'x' ELSE 'https://f.org/plain' END AS external_id, CASE k WHEN 0 THEN url WHEN 1 THEN 'https://f.org/n' || page_id || 'x' ELSE 'https://f.org/plain' END AS link, CAST(CASE WHEN k < 2 THEN 1700000000 + page_id END AS BIGINT) AS published FROM pages, range(3) AS r(k) WHERE k <= page_id % 3")
def s02(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "pages"), F.col("page_id")
    number, stamp = k.cast("string"), F.timestamp_seconds(1700000000 + k)
    mail = lambda ts, zone: F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(zone))
    rss = F.when(k % 4 == 0, mail(stamp, " GMT")).when(k % 4 == 2, mail(stamp - F.expr("INTERVAL 5 HOURS"), " EST")).otherwise(F.concat(F.date_format(stamp, "d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    items = lambda tag, when, first: F.concat(first, F.when(k % 3 >= 1, F.concat(F.lit(f"<{tag}><guid>other</guid><link>https://f.org/n"), number, F.lit(f"x</link><{when}>"), rss if when == "pubDate" else iso, F.lit(f"</{when}></{tag}>"))).otherwise(""), F.when(k % 3 >= 2, f"<{tag}><link>https://f.org/plain</link><date>soon</date></{tag}>").otherwise(""))
    xml = F.when(k % 2 == 0, F.concat(F.lit("<?xml version='1.0'?><rss><channel>"), items("item", "pubDate", F.concat(F.lit("<item><guid>g"), number, F.lit("</guid><link>"), link, F.lit("</link><pubDate>"), rss, F.lit("</pubDate></item>"))), F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<a:feed>"), items("a:entry", "modified", F.concat(F.lit("<a:entry><a:id>g"), number, F.lit('</a:id><a:link href="'), F.col("url"), F.lit('"/><a:updated>'), iso, F.lit("</a:updated></a:entry>"))), F.lit("</a:feed>")))
    return L.read_feed_listings(p.select(k.alias("feed_id"), xml.alias("xml")), pattern="https://f.org/(n[0-9]+x)").select("feed_id", "position", "external_id", "link", F.unix_timestamp("published").alias("published"))


@register("s03_json_listings", "SELECT o_custkey AS payload_id, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS deadline FROM orders")
def s03(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    item = F.struct(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderkey").cast("string")).alias("id"), F.struct(F.col("o_orderkey").alias("ref")).alias("meta"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(stamp, F.lit("Z"))).otherwise(stamp).alias("due"))
    payloads = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("payload_id")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("json"))
    out = L.read_json_listings(payloads, "$.data.items", {"external_id": ["$.id", "$.meta.ref"], "title": ["$.name"], "deadline": ["$.due"]})
    return out.select("payload_id", "external_id", "title", F.unix_timestamp("deadline").alias("deadline"))


@register("s04_json_details", """SELECT p_partkey AS payload_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS entity, p_type AS scope, CASE WHEN p_partkey % 2 = 0 THEN 'R' || p_partkey ELSE 'R' || p_partkey || ',S' || p_size END AS refs, 'h' || p_size || ',q' || p_size AS hints,
    'https://x.org/f' || p_partkey || '.pdf|f' || p_partkey || '.pdf|application/pdf|' || p_size * 10 || ',https://x.org/d/g?id=' || p_partkey || '|' || p_brand || '|application/zip|' || 2048 AS attachments FROM part""")
def s04(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    buyer = F.when(k % 3 == 0, F.concat(F.lit('"buyer": {"name": " "}, "title": "'), F.col("p_name"), F.lit('"'))).otherwise(F.concat(F.lit('"buyer": {"name": "'), F.col("p_brand"), F.lit('"}')))
    refs = F.when(k % 2 == 0, F.concat(F.lit('"R'), text("p_partkey"), F.lit('"'))).otherwise(F.concat(F.lit('["R'), text("p_partkey"), F.lit('", "S'), text("p_size"), F.lit('"]')))
    files = F.concat(F.lit('[{"href": "/f'), text("p_partkey"), F.lit('.pdf", "bytes": '), (F.col("p_size") * 10).cast("string"), F.lit('}, {"label": "no link"}, {"href": "g?id='), text("p_partkey"), F.lit('", "label": "'), F.col("p_brand"), F.lit('", "type": "application/zip; x=1", "bytes": "2 KB"}]'))
    doc = F.concat(F.lit("{"), buyer, F.lit(', "scope": {"text": "'), F.col("p_type"), F.lit('"}, "refs": '), refs, F.lit(', "hints": ["h'), text("p_size"), F.lit('", {"text": "q'), text("p_size"), F.lit('"}], "files": '), files, F.lit("}"))
    paths = L.Details(["$.buyer.name", "$.title"], ["$.summary", "$.scope.text"], "$.refs", "$.hints", "$.text", "$.files", "$.href", "$.label", "$.type", "$.bytes")
    out = L.read_json_details(table(spark, d, "part").select(k.alias("payload_id"), F.lit("https://x.org/d/e").alias("url"), doc.alias("json")), paths)
    file = F.transform("attachments", lambda x: F.concat_ws("|", x["link"], x["name"], x["mime"], x["size"].cast("string")))
    return out.select("payload_id", "entity", "scope", F.array_join("references", ",").alias("refs"), F.array_join("hints", ",").alias("hints"), F.array_join(file, ",").alias("attachments"))


@register("s07_page_links", f"""WITH a AS (SELECT page_id, {_BASE} AS o, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages), b AS (SELECT * FROM a WHERE NOT regexp_matches(href, '[^\\x00-\\x7F]')), n AS (SELECT DISTINCT page_id, {_BASE} AS o FROM pages)
    SELECT page_id, o || href AS link, substr(href, 2) AS name, false AS is_document, false AS is_zip FROM b WHERE href <> '/the'
    UNION ALL SELECT page_id, o || '/d/f' || page_id || '.PDF?x=1', 'f' || page_id || '.PDF', true, false FROM n UNION ALL SELECT page_id, o || '/download/' || page_id, 'All files.zip', true, true FROM n UNION ALL SELECT page_id, o || '/d/y.html', 'y.html', false, false FROM n""")
def s07(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    more = F.concat(F.lit('<a class="x" href="f'), number, F.lit('.PDF?x=1">file</a><a href="/download/'), number, F.lit('"> All  <b>files.zip</b></a><a rel="nofollow next" href="/p2">more</a><a href="y.html"></a>'))
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/d/x")).alias("url"), F.concat("html", more).alias("html"))
    out = L.extract_page_links(p, excluded=["^/the$"], markers=["/download/"])
    return out.select("page_id", "link", "name", "is_document", "is_zip")


@register("s08_label_values", "SELECT p_partkey AS page_id, 'entity' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'reference', 'R' || p_partkey FROM part")
def s08(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<p><strong>Procuring Entity:</strong> "), F.col("p_brand"), F.lit("</p><p><strong>Référence : </strong><b>R"), F.col("p_partkey").cast("string"), F.lit("</b></p><strong>Other:</strong> x"))
    return L.extract_label_values(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")), {"entity": ["procuring entity"], "reference": ["référence", "reference"]}).drop("position")


@register("s12_reusable", f"WITH {_OUT}, w AS (SELECT source AS notice_id, checksum, doc_id FROM o), a AS (SELECT source, checksum FROM o WHERE status = 'extracted' AND doc_id % 2 = 0) SELECT doc_id FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source = w.notice_id AND a.checksum = w.checksum)")
def s12(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d).withColumnRenamed("source", "notice_id")
    artifacts = o.select("notice_id", "checksum", "status", F.lit("p1").alias("processor_version"), F.when(F.col("doc_id") % 2 == 0, "c1").otherwise("c0").alias("config_version"))
    return L.reusable(o.select("notice_id", "checksum", "doc_id"), artifacts, "p1", "c1").select("doc_id")


@register("s13_bundles", """SELECT doc_id // 8 AS notice_id, sha256('[' || string_agg('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}', ',' ORDER BY doc_id) || ']') AS bundle FROM documents GROUP BY 1""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("notice_id", F.floor(F.col("doc_id") / 8))
    return L.bundles(docs, "notice_id", "doc_id", "n_chars").withColumn("bundle", F.sha2("bundle", 256))


@register("s09_scan_documents", "SELECT p_brand AS brand, 'txt' AS kind, CAST(sum(length(p_name) + 1) AS BIGINT) AS size FROM part GROUP BY 1")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """The parts' names written as a text file per brand and writer, and read again as landed files."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    table(spark, d, "part").select("p_brand", "p_name").repartition("p_brand").write.partitionBy("p_brand").text(folder)
    files = L.scan_documents(spark, folder).withColumn("brand", F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)/", 1)))
    return files.groupBy("brand", "kind").agg(F.sum("size").alias("size"))


@register("s10_expand_archives", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id // 4 || '!/in.zip!/d' || doc_id || '.txt' ELSE 'a' || doc_id // 4 || '!/d' || doc_id || '.txt' END AS member, sha256(text) AS checksum, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS depth, CAST(NULL AS VARCHAR) AS reject_reason FROM documents UNION ALL SELECT DISTINCT 'a' || doc_id // 4 || '!/../up', NULL, 1, 'unsafe_member' FROM documents")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Every four documents packed into an archive, some of them in one inside, and unpacked again."""

    def zipped(members: list[tuple[str, bytes]]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    def packed(ids: list[int], texts: list[str]) -> bytes:
        files = [(i, f"d{i}.txt", t.encode()) for i, t in zip(ids, texts)]
        inner = [(name, body) for i, name, body in files if i % 3 == 0]
        return zipped([(name, body) for i, name, body in files if i % 3] + ([("in.zip", zipped(inner))] if inner else []) + [("../up", b"x")])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 100):
                part = frame.iloc[at : at + 100]
                yield pd.DataFrame({"path": [f"a{ids[0] // 4}" for ids in part["ids"]], "content": [packed(ids, texts) for ids, texts in zip(part["ids"], part["texts"])]})

    docs = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 4).alias("archive")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs"))
    archives = docs.select(F.col("docs.doc_id").alias("ids"), F.col("docs.text").alias("texts")).mapInPandas(pack, "path string, content binary")
    return L.expand_archives(archives).select("member", F.sha2("content", 256).alias("checksum"), "depth", "reject_reason")


_MIXED = (
    (0, " Paginated_HTML_list", '{"card": "<li>[\\\\s\\\\S]*?</li>", "link": "href=\\"([^\\"]*/n([0-9]+))\\"", "title": "<b>([^<]*)</b>"}'),
    (1, "rss_atom", '{"pattern": "/n([0-9]+)"}'),
    (2, "json_api", '{"items": "$.data", "fields": {"external_id": ["$.id"], "title": ["$.name"], "link": ["$.url"], "deadline": ["$.due"]}}'),
    (3, "filtered_html", '{"card": "<li>[\\\\s\\\\S]*?</li>", "link": "href=\\"([^\\"]*/n([0-9]+))\\"", "title": "<b>([^<]*)</b>", "facets": ["works", "goods"]}'),
    (4, "carrier_pigeon", "{}"), (5, "json_api", "[1"),
)


@register("s00_mixed_sources", """WITH p AS (SELECT page_id, page_id % 7 AS s, page_id // 7 AS n, CASE WHEN page_id % 14 < 7 THEN 'goods' ELSE 'works' END AS facet FROM pages), k AS (SELECT *, n // 2 * 2 AS id FROM p WHERE s = 3)
    SELECT s AS source_id, page_id AS payload_id, CAST(n AS VARCHAR) AS external_id, CASE s WHEN 2 THEN '/n' || n ELSE 'https://x.org/n' || n END AS link, CASE s WHEN 1 THEN 'feed ' WHEN 2 THEN 'json ' ELSE 'html ' END || n AS title, CAST(CASE s WHEN 1 THEN 1790254800 END AS BIGINT) AS published, CAST(CASE s WHEN 2 THEN 1790254800 END AS BIGINT) AS deadline, NULL AS error_code FROM p WHERE s < 3
    UNION ALL SELECT 3, arg_min(page_id, (CASE facet WHEN 'works' THEN 0 ELSE 1 END, page_id)), CAST(id AS VARCHAR), 'https://x.org/n' || id, 'html ' || id, NULL, NULL, NULL FROM k GROUP BY id
    UNION ALL SELECT s, page_id, NULL, NULL, NULL, NULL, NULL, CASE s WHEN 4 THEN 'unknown_source_type' WHEN 5 THEN 'invalid_settings' ELSE 'source_not_configured' END FROM p WHERE s > 3""")
def s00(spark: SparkSession, d: str) -> DataFrame:
    """Sources of four types, one of no known type, one with broken settings and one that isn't configured, read in one plan."""
    k, source = F.col("page_id"), F.col("page_id") % 7
    n = F.floor(k / 7).cast("long")
    number = F.when(source == 3, F.floor(n / 2) * 2).otherwise(n).cast("string")
    html = F.concat(F.lit('<ul><li><a href="/n'), number, F.lit('">see</a><b>html '), number, F.lit("</b></li></ul>"))
    feed = F.concat(F.lit("<rss><item><link>https://x.org/n"), number, F.lit("</link><title>feed "), number, F.lit("</title><pubDate>Thu, 24 Sep 2026 08:00 EST</pubDate></item></rss>"))
    doc = F.concat(F.lit('{"data":[{"id":'), number, F.lit(',"name":"json '), number, F.lit('","url":"/n'), number, F.lit('","due":"2026-09-24T13:00:00Z"}]}'))
    content = F.when(source == 1, feed).when(source == 2, doc).otherwise(html)
    payloads = table(spark, d, "pages").select(source.alias("source_id"), k.alias("payload_id"), F.lit("https://x.org/all").alias("url"), content.alias("content"), F.lit(None).cast("timestamp").alias("fetched_at"), F.when(k % 14 < 7, "goods").otherwise("works").alias("facet"))
    config = spark.createDataFrame(list(_MIXED), "source_id long, source_type string, settings string")
    out = read_sources(payloads, config, shared_dir(spark))
    return out.select("source_id", "payload_id", "external_id", "link", "title", F.unix_timestamp("published").alias("published"), F.unix_timestamp("deadline").alias("deadline"), "error_code")
