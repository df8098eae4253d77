"""Queries of the scalar functions over whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as T
from noticelake.functions import time as C
from noticelake.functions import urls as U
from noticelake.functions.json import dig, dig_all
from noticelake.plans.registry import register, table

_WHITE = r"[\t-\r \x{85}\x{A0}]+"
_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g'))"


@register("f01_clean_text", f"SELECT doc_id, length({_CLEAN}) AS n_clean, sha256({_CLEAN}) AS clean_sha256 FROM documents")
def f01(spark: SparkSession, d: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("n_clean"), F.sha2(c, 256).alias("clean_sha256"))


_PARTS = r"""
parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages),
canon AS (SELECT page_id, url, s, h, CASE WHEN p = '' THEN '/' ELSE p END AS p, array_to_string(list_transform(list_filter(q, lambda x: lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS k FROM parts),
urls AS (SELECT page_id, url, s || '://' || h || p || CASE WHEN k = '' THEN '' ELSE '?' || k END AS canonical, trim(h || p || CASE WHEN k = '' THEN '' ELSE '?' || k END, '/?') AS external_id FROM canon)"""


@register("f04_f05_canonical_url", f"WITH {_PARTS} SELECT page_id, canonical, external_id FROM urls")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"), U.derive_external_id(F.col("url")).alias("external_id"))


@register(
    "f03_apply_query_params",
    r"""WITH q AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('page', 'ref', 'open', 'tag')) AS q FROM pages)
    SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_concat(q, ['page=7', 'open=true', 'tag=a', 'tag=b']), '&') || regexp_extract(url, '(#.*)$', 1) AS url FROM q""",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.apply_query_params(F.col("url"), {"page": "7", "ref": None, "open": True, "tag": ["a", "b"]}).alias("url"))


@register(
    "f06_parse_timestamp",
    "SELECT event_id, CAST(epoch(date_trunc(CASE WHEN event_id % 9 = 6 THEN 'minute' ELSE 'second' END, ts)) AS BIGINT) AS seconds FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 11 = 0",
)
def f06(spark: SparkSession, d: str) -> DataFrame:
    """ISO with and without a zone, epochs, and mail dates with an offset, GMT, EST, without seconds, weekday or zone; every eleventh can't be read."""
    s = F.date_trunc("second", "ts").cast("timestamp")
    mail = lambda ts, form, zone: F.concat(F.date_format(ts, form), F.lit(zone))
    texts = (
        F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(s, "yyyy-MM-dd HH:mm:ss"), F.unix_timestamp(s).cast("string"), (F.unix_timestamp(s) * 1000).cast("string"), mail(s, "EEE, d MMM yyyy HH:mm:ss", " +0000"),
        mail(s, "EEE, dd MMM yyyy HH:mm:ss", " GMT"), mail(s, "EEE, dd MMM yyyy HH:mm", " UT"), mail(s - F.expr("INTERVAL 5 HOURS"), "d MMM yy HH:mm:ss", " EST"), mail(s, "d MMM yyyy HH:mm:ss", ""),
    )
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("on "), texts[5])).otherwise(F.get(F.array(*texts), (F.col("event_id") % 9).cast("int")))
    return table(spark, d, "events").withColumn("text", text).select("event_id", F.unix_timestamp(C.parse_timestamp(F.col("text"))).alias("seconds"))


@register("f07_dig_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dig(F.col("props"), "k", "bigint").alias("k"))


@register(
    "f07_dig_all",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '' END AS names FROM events",
)
def f07_all(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    doc = F.when(k % 4 == 0, '{"x": {"names": ["a", "b"]}}').when(k % 4 == 1, F.concat(F.lit('{"x": {"names": '), k.cast("string"), F.lit("}}"))).when(k % 4 == 2, '{"x": {"names": []}}').otherwise('{"x": {}}')
    return table(spark, d, "events").select("event_id", F.array_join(dig_all(doc, "x.names"), ",").alias("names"))


_NOW = "TIMESTAMP '1998-06-15 12:00:00'"


@register(
    "f12_f13_business_days",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate < {_NOW} THEN -1 ELSE len(list_filter(range(1, date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) + 1), lambda k: isodow(DATE '1998-06-15' + CAST(k AS INTEGER)) < 6)) END AS days,
    o_orderstatus = 'F' AND o_orderdate >= {_NOW} AND len(list_filter(range(1, date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) + 1), lambda k: isodow(DATE '1998-06-15' + CAST(k AS INTEGER)) < 6)) <= 5 AS urgent FROM orders""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-06-15 12:00:00").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("UNRESOLVED")
    return table(spark, d, "orders").select("o_orderkey", C.business_days_until(now, F.col("o_orderdate")).cast("long").alias("days"), C.is_urgent(F.col("o_orderdate"), status, now).alias("urgent"))


@register("f09_parse_absolute_deadline", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate) + INTERVAL 13 HOUR - CASE o_orderkey % 4 WHEN 2 THEN INTERVAL 60 MINUTE ELSE INTERVAL 0 MINUTE END) AS BIGINT) AS deadline FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def f09(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    names = lambda start: F.array(*[F.lit(m) for m, n in list(C.MONTHS.items())[start : start + 12]])
    month = lambda start: F.get(names(start), F.month("o_orderdate") - 1)
    day, year, k = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("End Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 13:00:00 UTC")))
        .when(k == 1, F.concat(F.lit("Deadline: "), day, F.lit(" "), month(0), F.lit(" "), year, F.lit(" at 1.00 pm GMT")))
        .when(k == 2, F.concat(F.lit("Date limite: le "), day, F.lit(" "), month(12), F.lit(" "), year, F.lit(" à 13 h 00 WAT")))
        .otherwise(F.concat(F.lit("Prazo: "), day, F.lit(" de "), month(24), F.lit(" de "), year, F.lit(" às 13:00")))
    )
    return o.withColumn("text", text).select("o_orderkey", F.unix_timestamp(C.parse_absolute_deadline(F.col("text"))).alias("deadline"))


@register(
    "f02_absolute_url",
    """WITH b AS (SELECT page_id, 'https://h' || page_id % 7 || '.org' AS o, page_id % 9 AS k FROM pages)
    SELECT page_id, o || CASE k WHEN 0 THEN '/a/c' WHEN 1 THEN '/a/b/d?p=2' WHEN 2 THEN '/x/y.pdf' WHEN 3 THEN '/a/b/z?q#f' WHEN 4 THEN '/a/b/d?old=1#end' WHEN 5 THEN '/c' WHEN 6 THEN '/e/' WHEN 7 THEN '/a/b/n/m' ELSE '/a/b/' END AS link FROM b""",
)
def f02(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 9
    base = F.concat(F.lit("HTTPS://H"), (F.col("page_id") % 7).cast("string"), F.lit(".org/a/b/d?old=1#top"))
    href = F.get(F.array(*map(F.lit, ("../c", "?p=2", "/x/./w/../y.pdf", "z?q#f", "#end", "../../../c", "/e/f/..", "n//m", "."))), k.cast("int"))
    return table(spark, d, "pages").select("page_id", U.absolute_url(base, href).alias("link"))


@register(
    "f10_parse_relative_deadline",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, (l_orderkey * 7 + l_linenumber) % 8 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(epoch(l_shipdate) AS BIGINT) + CASE k WHEN 0 THEN 86400 * l_linenumber WHEN 1 THEN 3600 * l_linenumber WHEN 2 THEN 7200 WHEN 3 THEN 86400 * 12 END AS deadline,
      CASE k WHEN 0 THEN l_linenumber || ' days left' WHEN 1 THEN l_linenumber || ' Hours remaining' WHEN 2 THEN '2 hrs left' WHEN 3 THEN '12 business days to go' WHEN 6 THEN 'Closing  soon' END AS raw FROM t""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("l_linenumber").cast("string"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 8).cast("int")
    texts = (F.concat(F.lit("("), n, F.lit(" days left)")), F.concat(n, F.lit(" Hours remaining")), F.lit("4000 days left, 2 hrs left"), F.lit("about 12 business days to go"), F.lit("2.5 days left"), F.lit("delivery in 5 days"), F.lit("Closing  soon"), F.lit("12345 hours left"))
    x = C.relative_deadline(F.get(F.array(*texts), k), F.col("l_shipdate"))
    return table(spark, d, "lineitem").withColumn("x", x).select("l_orderkey", "l_linenumber", "l_partkey", F.unix_timestamp("x.deadline").alias("deadline"), "x.raw")


@register("f17_normalize_language", "SELECT doc_id, lower(lang) AS language FROM documents")
def f17(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise("_YY"))
    return table(spark, d, "documents").select("doc_id", T.normalize_language(tag).alias("language"))


_ASCII = "length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g'))"


@register(
    "f18_estimate_tokens",
    f"""SELECT conv_id, turn, greatest(CAST(ceil(length(coalesce(text, '')) / 3) AS BIGINT), length(coalesce(text, '')) - {_ASCII} + CAST(ceil({_ASCII} / 3) AS BIGINT)) AS tokens,
    len(regexp_extract_all(coalesce(text, ''), '[^\\t-\\r ]+')) AS words FROM conversations""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


@register("f20_fold_accents", "SELECT doc_id, sha256(lower(strip_accents(text))) AS folded FROM documents")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold_accents(F.col("text")), 256).alias("folded"))


@register("f21_advertised_size", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars * 1024 WHEN 1 THEN n_chars * 1048576 + 524288 END AS size FROM documents")
def f21(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(n, F.lit(" Ko)"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("size "), n, F.lit(",5 MB"))).otherwise("unknown size")
    return table(spark, d, "documents").select("doc_id", T.advertised_size(text).alias("size"))


@register(
    "f23_storage_name",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') || '.pdf' WHEN 1 THEN '_con.txt' ELSE 'a_b_' END AS name, CASE p_partkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM part",
)
def f23(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("../x\\"), F.replace("p_name", F.lit(" "), F.lit("*")), F.lit(".pdf"))).when(k == 1, "con.txt").otherwise("dir/a?b|...")
    name = U.storage_name(raw)
    return table(spark, d, "part").select("p_partkey", name.alias("name"), U.guess_mime(name).alias("mime"))


@register("f24_checksum", """SELECT doc_id, sha256(text) AS checksum, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') AS fingerprint FROM documents""")
def f24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.checksum(F.col("text")).alias("checksum"), T.content_fingerprint({"n_chars": F.col("n_chars"), "lang": F.col("lang")}).alias("fingerprint"))


@register("f23_f22_storage_key", "SELECT p_partkey, 'tenders/' || p_partkey || '/attachments/' || sha256(p_name) || '/' || replace(p_name, ' ', '_') || '.pdf' AS key, 'application/pdf' AS mime FROM part")
def f23_key(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("dir/"), F.replace("p_name", F.lit(" "), F.lit("?")), F.lit(".pdf. "))
    return table(spark, d, "part").select("p_partkey", U.storage_key(F.col("p_partkey"), F.sha2("p_name", 256), name).alias("key"), U.bare_media_type(F.lit(" Application/PDF ; charset=x")).alias("mime"))


_SECRETS = ("api_key", "apikey", "password", "passwd", "secret", "token", "authorization", "auth", "credential", "credentials", "private_key", "access_token", "refresh_token")


@register(
    "f26_redact_fields",
    f"""WITH n AS (SELECT *, {list(_SECRETS)}[event_id % 13 + 1] AS name FROM events), k AS (SELECT *, CASE event_id % 4 WHEN 0 THEN name WHEN 1 THEN 'old_' || name WHEN 2 THEN upper(name) || '_2' ELSE replace('my-' || name, '_', '-') END AS key FROM n)
    SELECT event_id, '{{"a":{{"' || key || '":"[REDACTED]","user":"u' || user_id || '","list":[{{"' || key || '":"[REDACTED]"}},"' || key || '"]}},"tokens_used":' || event_id || ',"' || key || '":"[REDACTED]","x_' || name || '_y":' || user_id || ', "' || key || '" : "[REDACTED]", "end": [1, {{"deep":[{{"' || key || '":"[REDACTED]"}}]}}]}}' AS fields FROM k""",
)
def f26_fields(spark: SparkSession, d: str) -> DataFrame:
    """All names of secrets, with prefixes, suffixes, capitals and hyphens, over texts with quotes and brackets, numbers, arrays and objects within each other."""
    name = F.get(F.array(*map(F.lit, _SECRETS)), (F.col("event_id") % 13).cast("int"))
    k = F.col("event_id") % 4
    key = F.when(k == 0, name).when(k == 1, F.concat(F.lit("old_"), name)).when(k == 2, F.concat(F.upper(name), F.lit("_2"))).otherwise(F.replace(F.concat(F.lit("my-"), name), F.lit("_"), F.lit("-")))
    form = '{{"a":{{"%s":"k\\"1}}","user":"u%d","list":[{{"%s":12}},"%s"]}},"tokens_used":%d,"%s":["a1",{{"v":[1,"]"]}},"b2"],"x_%s_y":%d, "%s" : \n{{"p":{{"q":[]}}}}, "end": [1, {{"deep":[{{"%s":null}}]}}]}}'.replace("{{", "{").replace("}}", "}")
    doc = F.format_string(form, key, F.col("user_id"), key, key, F.col("event_id"), key, name, F.col("user_id"), key, key)
    return table(spark, d, "events").select("event_id", F.regexp_replace(T.redact_fields(doc), r" : \n", " : ").alias("fields"))


@register(
    "f27_transport",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 200 + CAST(floor(value) AS INTEGER) % 400 END AS status, ['dns', 'read_timeout', 'weird'][event_id % 7 % 3 + 1] AS code FROM events),
    c AS (SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 429 THEN 'rate_limited' WHEN status IN (408, 425) OR status >= 500 THEN 'retryable' WHEN status BETWEEN 400 AND 499 THEN 'permanent' WHEN status IS NOT NULL THEN 'other' WHEN code = 'dns' THEN 'unsent' WHEN code = 'read_timeout' THEN 'ambiguous' ELSE 'other' END AS class FROM e)
    SELECT event_id, class, class IN ('rate_limited', 'retryable', 'unsent', 'ambiguous') AS retryable, class = 'ambiguous' AS possible_duplicate FROM c""",
)
def f27_transport(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 != 0, 200 + F.floor("value").cast("int") % 400)
    code = F.get(F.array(F.lit("dns"), F.lit("read_timeout"), F.lit("weird")), (F.col("event_id") % 7 % 3).cast("int"))
    return table(spark, d, "events").withColumn("x", C.retry_policy(status, code)).select("event_id", "x.*")


@register(
    "f25_redact_url",
    r"""WITH q AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS head, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), '&') AS q FROM pages)
    SELECT page_id, replace(head, '://', '://***@') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM q""",
)
def f25(spark: SparkSession, d: str) -> DataFrame:
    planted = F.concat(F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), "://", "://user:pw@"), F.lit("?token=abc"), F.regexp_replace(F.regexp_extract("url", r"^[^?#]*(\?[^#]*)", 1), r"^\?", "&"), F.lit("#frag"))
    return table(spark, d, "pages").select("page_id", U.redact_url(planted).alias("url"))


@register(
    "f26_redact_text",
    rf"""SELECT doc_id, sha256(regexp_replace(text, '(?i)\b({"|".join(k.replace("_", "[-_]") for k in sorted(_SECRETS, reverse=True))})([ ]*[=:][ ]*)("[^"]*"|''[^'']*''|[^ \t\n\r]+)', '\1\2[REDACTED]', 'g')) AS redacted FROM documents""",
)
def f26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact_text(F.col("text")), 256).alias("redacted"))


@register(
    "f27_f28_retry_policy",
    """WITH e AS (SELECT event_id, 200 + CAST(floor(value) AS INTEGER) % 400 AS status, CAST(event_id % 12 + 1 AS INTEGER) AS attempt FROM events)
    SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 429 THEN 'rate_limited' WHEN status IN (408, 425) OR status >= 500 THEN 'retryable' WHEN status BETWEEN 400 AND 499 THEN 'permanent' ELSE 'other' END AS class,
    least(30.0, pow(2.0, attempt - 1)) AS delay, CASE WHEN attempt <= 1 THEN 0 ELSE CAST(least(3600, 30 * pow(2, least(attempt - 2, 10))) AS INTEGER) END AS outbox_delay FROM e""",
)
def f27(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (200 + F.floor("value").cast("int") % 400).alias("status"), (F.col("event_id") % 12 + 1).cast("int").alias("attempt"))
    return e.select("event_id", C.http_class(F.col("status")).alias("class"), C.backoff_seconds(F.col("attempt")).alias("delay"), C.outbox_backoff(F.col("attempt")).alias("outbox_delay"))


@register(
    "f29_f30_validation",
    "SELECT c_custkey, c_custkey % 3 = 0 AS valid, c_custkey % 8 IN (0, 1, 2, 3) AS placeholder FROM customer",
)
def f29(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    local = F.replace("c_name", F.lit("#"), F.lit("."))
    mail = F.when(k % 3 == 0, F.concat(local, F.lit("@mail.example.com"))).when(k % 3 == 1, F.concat(local, F.lit("@example"))).otherwise(F.concat(local, F.lit("@a@example.com")))
    marks = (F.lit(" N/A "), F.lit("<one sentence>"), F.lit("..."), F.lit("\t--"), F.lit("unknown"), F.lit("na"), F.col("c_name"), F.lit("< a"))
    return table(spark, d, "customer").select("c_custkey", T.is_valid_email(mail).alias("valid"), T.is_placeholder(F.get(F.array(*marks), (k % 8).cast("int"))).alias("placeholder"))


@register("f08_same_values", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS text, o_orderkey % 4 <> 0 AS instant FROM orders")
def f08(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    other = F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit("-"), F.lit("- ")), F.when(k % 3 == 0, "x").otherwise("\n"))
    iso = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 4 == 0, "+01:00").when(k % 4 == 1, "Z").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", T.same_text(F.replace("o_orderpriority", F.lit("-"), F.lit("-  ")), other).alias("text"), T.same_instant(F.date_trunc("second", t), C.parse_timestamp(iso)).alias("instant"))


@register("f31_encoded_bytes", "SELECT doc_id, CAST(4 * ceil(n_chars / 3) AS BIGINT) AS encoded FROM documents")
def f31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.encoded_bytes(F.col("n_chars")).alias("encoded"))
