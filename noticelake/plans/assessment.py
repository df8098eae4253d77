"""Queries of deadlines, citations and verdict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import estimate_tokens
from noticelake.operators import assessment as A
from noticelake.plans.changes import _DIFF, diff
from noticelake.plans.registry import register, table


@register("j03_resolve_deadlines", """WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS a, o_orderkey % 3 = 0 AS ra FROM orders), dt AS (SELECT o_orderkey AS k, o_orderdate + to_seconds(CASE o_orderkey % 4 WHEN 0 THEN 900 WHEN 1 THEN 901 ELSE 0 END) AS b FROM orders WHERE o_orderkey % 5 <> 0),
    d AS (SELECT l_orderkey AS k, arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag = 'A') AS c, bool_or(l_returnflag = 'R') AS u, bool_or(l_returnflag = 'N') AS z FROM lineitem GROUP BY 1), j AS (SELECT coalesce(l.k, dt.k, d.k) AS notice_id, a, b, c, u, z FROM l FULL JOIN dt ON l.k = dt.k FULL JOIN d ON d.k = coalesce(l.k, dt.k)),
    s AS (SELECT *, CASE WHEN coalesce(abs(epoch(a) - epoch(b)) > 900, false) THEN 'conflicting' WHEN a IS NOT NULL THEN 'listing' WHEN b IS NOT NULL THEN 'detail' WHEN c IS NOT NULL THEN 'document' ELSE 'unresolved' END AS source FROM j)
    SELECT notice_id, CASE WHEN source <> 'conflicting' THEN CAST(epoch(coalesce(a, b, c)) AS BIGINT) END AS deadline, source, CASE source WHEN 'conflicting' THEN 'CONFLICTING' WHEN 'unresolved' THEN CASE WHEN u THEN 'UNPARSEABLE' WHEN z THEN 'NO_TIMEZONE' ELSE 'MISSING' END END AS reason, CAST(epoch(a) AS BIGINT) AS listing, CAST(epoch(b) AS BIGINT) AS detail FROM s""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    k, flag = F.col("o_orderkey"), F.col("l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    listing = o.select(k.alias("notice_id"), F.when(k % 3 != 0, F.col("t")).alias("deadline"), F.when(k % 3 == 0, "MISSING").alias("reason"))
    detail = o.where(k % 5 != 0).select(k.alias("notice_id"), (F.timestamp_seconds(F.unix_timestamp("t") + F.when(k % 4 == 0, 900).when(k % 4 == 1, 901).otherwise(0))).alias("deadline"))
    docs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("doc_order"), F.when(flag == "A", F.col("l_shipdate").cast("timestamp")).alias("deadline"), F.when(flag == "R", "UNPARSEABLE").when(flag == "N", "NO_TIMEZONE").alias("reason"))
    return A.resolve_deadlines(listing, detail, docs).withColumns({c: F.unix_timestamp(c) for c in ("deadline", "listing", "detail")})


def cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("item_id")
    cites = table(spark, d, "benchmark").select(k.alias("cite_id"), F.when(k % 7 == 0, "Nowhere").otherwise(F.concat(F.lit(" ## SECTION "), (k % 10).cast("string"))).alias("section"), F.when(k % 2 == 0, "part one").otherwise("PART ONE").alias("quote"))
    sections = table(spark, d, "nation").where("n_nationkey < 8").select(F.concat(F.lit("Section "), F.col("n_nationkey").cast("string")).alias("heading"), F.concat(F.lit("this is part one of "), F.col("n_name")).alias("content"))
    return cites, sections


@register("j06_kb_citations", "SELECT item_id AS cite_id, 'Section ' || (item_id % 10) AS heading, item_id % 2 = 0 AS verbatim FROM benchmark WHERE item_id % 7 <> 0 AND item_id % 10 < 8")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_kb_citations(*cited(spark, d)).select("cite_id", "heading", "verbatim")


@register("j06_unsupported", "SELECT item_id AS cite_id, CASE WHEN item_id % 3 = 0 THEN 'not_met' WHEN item_id % 7 = 0 OR item_id % 10 >= 8 THEN 'unverified' ELSE 'met' END AS status FROM benchmark")
def j06_unsupported(spark: SparkSession, d: str) -> DataFrame:
    assessments = table(spark, d, "benchmark").select(F.col("item_id").alias("cite_id"), F.when(F.col("item_id") % 3 == 0, "not_met").otherwise("met").alias("status"))
    return A.unsupported(assessments, A.verify_kb_citations(*cited(spark, d)), "cite_id")


@register("j07_bind_assessments", """WITH r AS (SELECT l_orderkey AS notice_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey FROM lineitem), a AS (SELECT notice_id, pos, CASE WHEN pos % 2 = 0 THEN 'other' ELSE 'part ' || l_partkey END AS k FROM r WHERE NOT (notice_id % 3 = 0 AND pos = 1)),
    t AS (SELECT notice_id, 'part ' || l_partkey AS k, min(pos) AS by_text FROM r GROUP BY ALL), n AS (SELECT notice_id, count(*) AS nr FROM r GROUP BY 1), m AS (SELECT notice_id, count(*) AS na FROM a GROUP BY 1)
    SELECT a.notice_id, a.pos, coalesce(by_text, CASE WHEN na = nr THEN a.pos END) AS req_no FROM a LEFT JOIN t USING (notice_id, k) JOIN n USING (notice_id) JOIN m USING (notice_id)""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").selectExpr("l_orderkey AS notice_id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos", "concat('Part ', l_partkey) AS text")
    a = r.where("NOT (notice_id % 3 = 0 AND pos = 1)").withColumn("text", F.when(F.col("pos") % 2 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("text"))))
    return A.bind_assessments(a, r)


@register("j08_requirement_coverage", """WITH x AS (SELECT l_orderkey AS n, l_partkey AS r, l_linenumber AS k FROM lineitem), e AS (SELECT DISTINCT n, r FROM x WHERE k <> 4), l AS (SELECT n, r FROM x WHERE k <> 2), a AS (SELECT n, r FROM x WHERE k <> 3),
    v AS (SELECT DISTINCT n, r, k % 3 AS ref FROM x WHERE k <> 4), g AS (SELECT DISTINCT n, r, k % 3 AS ref FROM x WHERE k <> 3 AND k <> 5)
    SELECT n AS notice_id, r AS requirement, 'not_listed' AS problem FROM e WHERE (n, r) NOT IN (SELECT (n, r) FROM l) UNION ALL SELECT DISTINCT n, r, 'listed_not_established' FROM l WHERE (n, r) NOT IN (SELECT (n, r) FROM e)
    UNION ALL SELECT n, r, 'not_assessed' FROM e WHERE (n, r) NOT IN (SELECT (n, r) FROM a) UNION ALL SELECT DISTINCT n, r, 'assessed_not_established' FROM a WHERE (n, r) NOT IN (SELECT (n, r) FROM e)
    UNION ALL SELECT n, r, 'listed_twice' FROM l GROUP BY n, r HAVING count(*) > 1 UNION ALL SELECT n, r, 'assessed_twice' FROM a GROUP BY n, r HAVING count(*) > 1
    UNION ALL SELECT DISTINCT n, r, 'evidence_omitted' FROM v WHERE (n, r, ref) NOT IN (SELECT (n, r, ref) FROM g) AND (n, r) IN (SELECT (n, r) FROM a)""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_partkey").alias("requirement"), "l_linenumber", (F.col("l_linenumber") % 3).alias("reference"))
    side = lambda where, *cols: li.where(where).select("notice_id", "requirement", *cols)
    return A.requirement_coverage(side("l_linenumber <> 4").distinct(), side("l_linenumber <> 2"), side("l_linenumber <> 3"), side("l_linenumber <> 4", "reference").distinct(), side("l_linenumber NOT IN (3, 5)", "reference").distinct())


_A13 = {
    "schema_version_mismatch": "k % 31 = 0", "invalid_verdict": "verdict NOT IN ('APPLY', 'DO NOT APPLY', 'APPLY WITH CONDITIONS')", "incomplete_mismatch": "k % 29 = 0", "deadline_mismatch": "k % 23 = 0", "deadline_display_mismatch": "k % 41 = 0 OR k % 43 = 0", "assessments_required": "n = 0", "invalid_status": "k % 37 = 0 AND n > 0",
    "citation_missing": "met_bare > 0", "negative_without_evidence": "not_bare > 0", "unsupported_not_unverified": "bare > 0", "gap_missing": "k % 19 = 0 AND unv > 0", "tender_evidence_missing": "k % 2 = 0 AND no_tender > 0", "no_evidence_wording": "unv_bare > 0 AND k % 17 = 0 OR k % 19 = 0 AND unv_bare > 0",
    "verdict_does_not_follow": "verdict <> CASE WHEN neg > 0 THEN 'DO NOT APPLY' WHEN met = n AND k % 3 <> 0 THEN 'APPLY' ELSE 'APPLY WITH CONDITIONS' END", "limitation_missing": "k % 5 = 0 AND k % 10 <> 0", "deadline_fabricated": "k % 7 = 0 AND k % 14 <> 0", "urgency_mismatch": "(k % 11 = 0) <> (k % 7 <> 0 AND k % 13 <= 5)",
}


@register(
    "a13_verdict_violations",
    f"""WITH x AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 37 = 0 THEN 'odd' WHEN l_returnflag = 'R' THEN 'not_met' WHEN l_returnflag = 'A' THEN 'unverified' ELSE 'met' END AS s, l_linenumber % 5 AS c, l_linenumber % 4 AS t FROM lineitem),
    a AS (SELECT k, count(*) AS n, count_if(s = 'met') AS met, count_if(s = 'not_met') AS neg, count_if(s = 'unverified') AS unv, count_if(s = 'met' AND c = 0) AS met_bare, count_if(s = 'not_met' AND (c = 0 OR t = 0)) AS not_bare, count_if(s <> 'unverified' AND c = 0) AS bare, count_if(t = 0) AS no_tender, count_if(s = 'unverified' AND c = 0) AS unv_bare FROM x GROUP BY 1),
    v AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'APPLY' WHEN 1 THEN 'DO NOT APPLY' WHEN 2 THEN 'APPLY WITH CONDITIONS' ELSE 'MAYBE' END AS verdict, coalesce(n, 0) AS n, coalesce(met, 0) AS met, coalesce(neg, 0) AS neg, coalesce(unv, 0) AS unv, coalesce(met_bare, 0) AS met_bare, coalesce(not_bare, 0) AS not_bare, coalesce(bare, 0) AS bare, coalesce(no_tender, 0) AS no_tender, coalesce(unv_bare, 0) AS unv_bare FROM orders LEFT JOIN a ON a.k = o_orderkey)
    SELECT k AS verdict_id, unnest(list_filter([{", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _A13.items())}], lambda x: x IS NOT NULL)) AS rule FROM v""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    k, flag, n = F.col("o_orderkey"), F.col("l_returnflag"), F.col("l_linenumber")
    key = F.col("l_orderkey")
    status = F.when(key % 37 == 0, "odd").when(flag == "R", "not_met").when(flag == "A", "unverified").otherwise("met")
    said = F.when(key % 17 == 0, "nothing").otherwise("There is No Evidence on File.")
    x = F.struct(status.alias("status"), F.when(key % 19 != 0, said).alias("gap"), said.alias("assessment"), (n % 4).alias("tender"), (n % 5).alias("company"))
    a = table(spark, d, "lineitem").groupBy(key.alias("o_orderkey")).agg(F.collect_list(x).alias("assessments"))
    empty = F.array().cast(a.schema["assessments"].dataType)
    texts = lambda some: F.when(some, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    v = table(spark, d, "orders").select("o_orderkey").join(a, "o_orderkey", "left").select(
        k.alias("verdict_id"), F.when(k % 31 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.get(F.array(*map(F.lit, ("APPLY", "DO NOT APPLY", "APPLY WITH CONDITIONS", "MAYBE"))), (k % 4).cast("int")).alias("verdict"), ((k % 5 == 0) != (k % 29 == 0)).alias("incomplete"), (k % 5 == 0).alias("incomplete_inputs"),
        F.when(k % 7 == 0, "UNRESOLVED").otherwise("RESOLVED").alias("deadline_status"), F.lit("2026-01-01").alias("deadline_utc"), F.when(k % 7 == 0, "UNRESOLVED").otherwise("RESOLVED").alias("expected_status"), F.when(k % 23 == 0, "2026-01-02").otherwise("2026-01-01").alias("expected_utc"), F.when(k % 14 != 0, "1 January").alias("deadline_shown"),
        F.when(k % 41 != 0, "2026-01-01").alias("deadline_date"), F.lit("2026-01-01").alias("expected_date"), F.lit("12:00").alias("deadline_time"), F.lit("12:00").alias("expected_time"), F.lit("WAT").alias("deadline_zone"), F.lit("WAT").alias("expected_zone"), F.when(k % 43 == 0, "UTC").alias("deadline_source_zone"), F.lit(None).cast("string").alias("expected_source_zone"),
        F.coalesce("assessments", empty).alias("assessments"), (k % 2 == 0).alias("has_tender_text"), texts(k % 3 == 0).alias("gaps"), texts(k % 10 == 0).alias("limitations"), (k % 11 == 0).alias("urgent"), (k % 13).alias("days_left"), F.lit(5).alias("urgency_window"),
    )
    return A.verdict_violations(v)


@register("a14_notice_penalty", "SELECT doc_id, CASE WHEN quality = 1 THEN 0.65 ELSE 0.0 END AS confidence, CASE WHEN toxic = 1 THEN 'notice_only' ELSE 'notice_only,other' END AS limitations FROM labels")
def a14(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).otherwise(0.1).alias("confidence"), F.when(F.col("toxic") == 1, F.array(F.lit("notice_only"))).otherwise(F.array(F.lit("other"))).alias("limitations"))
    return A.apply_notice_penalty(v, "notice_only").withColumn("limitations", F.array_join("limitations", ","))


@register(
    "a13_reference_violations",
    """WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id // 4 AS v, CASE doc_id % 5 WHEN 0 THEN contains(l[1], substr(l[1], 1, 20)) WHEN 1 THEN len(l) > 1 AND contains(l[2], substr(l[1], 1, 20)) WHEN 2 THEN contains(l[1], substr(l[1], 3, 9) || 'zq') WHEN 3 THEN true ELSE false END AS ok FROM c),
    k AS (SELECT doc_id // 4 AS v, doc_id % 3 <> 1 AND doc_id % 7 <> 0 AS ok FROM c)
    SELECT DISTINCT v AS verdict_id, 'invalid_tender_reference' AS rule FROM t WHERE NOT ok UNION ALL SELECT DISTINCT v, 'invalid_kb_citation' FROM k WHERE NOT ok""",
)
def a13_references(spark: SparkSession, d: str) -> DataFrame:
    """References to a document's first line, to another, with words that aren't there, to established evidence, and to no line; citations of a heading, of a line that is none, and with words that aren't there."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("lines", F.split("text", "\n"))
    chunks = docs.select("doc_id", F.posexplode("lines").alias("k", "text")).select("doc_id", F.concat(F.lit("line:"), F.col("k").cast("string")).alias("location"), "text")
    verdict, k, first = F.floor(F.col("doc_id") / 4).alias("verdict_id"), F.col("doc_id") % 5, F.get("lines", 0)
    location = F.when(k == 1, "line:1").when(k == 3, "annex").when(k == 4, "line:-1").otherwise("line:0")
    quote = F.when(k == 2, F.concat(F.substring(first, 3, 9), F.lit("zq"))).otherwise(F.substring(first, 1, 20))
    cited = docs.select(verdict, "doc_id", location.alias("location"), quote.alias("quote"))
    established = docs.where(k == 3).select(verdict, "doc_id", F.lit("annex").alias("location"), first.alias("quote"))
    kb = docs.select(F.col("doc_id").alias("kb_id"), F.concat(F.lit("## Profile "), F.col("source"), F.lit("\nProfile\nwe have "), F.col("lang"), F.lit(" staff")).alias("content"))
    said = docs.select(verdict, F.col("doc_id").alias("kb_id"), F.when(F.col("doc_id") % 3 == 1, "Profile").otherwise(F.concat(F.lit("Profile "), F.col("source"))).alias("section"), F.when(F.col("doc_id") % 7 == 0, "we have none").otherwise(F.concat(F.lit("have "), F.col("lang"))).alias("quote"))
    return A.reference_violations(cited, chunks, established).unionByName(A.kb_violations(said, kb))


@register("a15_classify_tables", "SELECT p_partkey AS table_id, CASE p_partkey % 6 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'deadline' WHEN 2 THEN 'eligibility' WHEN 3 THEN 'financial' WHEN 4 THEN CASE WHEN p_size > 25 THEN 'experience' ELSE 'other' END ELSE 'other' END AS role FROM part")
def a15(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 6).cast("int")
    headers = (F.lit("Critère|Pondération|Prix"), F.lit("Milestone|Date|Responsible"), F.lit("Requisito|OBRIGATÓRIO"), F.lit("Preço|40%"), F.lit("Client"), F.lit("Date Date"))
    body = (F.col("p_type"), F.lit("Deadline"), F.col("p_type"), F.lit("custo|data"), F.when(F.col("p_size") > 25, "Projet").otherwise("client"), F.col("p_name"))
    rows = F.array(*[F.struct(F.lit(r).alias("row"), F.get(F.array(*texts), k).alias("text")) for r, texts in ((0, headers), (1, body))], F.struct(F.lit(2).alias("row"), F.lit("budget amount").alias("text")))
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.explode(rows).alias("c")).select("table_id", "c.row", "c.text")
    return A.classify_tables(cells, A.table_vocabulary(spark))


_N = "length(text)"
_ASC = "length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))"


_TOK = f"greatest(CAST(ceil({_N} / 3) AS BIGINT), {_N} - {_ASC} + CAST(ceil({_ASC} / 3) AS BIGINT))"


@register("t03_map_reduce_gate", f"WITH t AS (SELECT doc_id // 10 AS bundle, {_TOK} AS t FROM documents) SELECT bundle, CAST(sum(t) AS BIGINT) AS tokens, sum(t) + 1400 + 1000 > 6000 AS needs_map, CASE WHEN sum(t) + 1400 + 1000 > 6000 AND max(t) + 1200 + 1000 > 6000 THEN 'segment_exceeds_window' END AS error FROM t GROUP BY 1")
def t03(spark: SparkSession, d: str) -> DataFrame:
    tokens = estimate_tokens(F.col("text"))
    b = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("bundle")).agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))
    return A.map_reduce_gate(b, 6_000, 1_000).drop("longest")


@register("j18_archive_lineage", "SELECT 'http://x/' || p_brand || '.zip' AS parent, count(*) AS members, bool_and(p_size > 5) AS acquired FROM part GROUP BY 1")
def j18(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select(F.concat(F.lit("http://x/"), F.col("p_brand"), F.lit(".zip!/"), F.col("p_partkey").cast("string")).alias("url"), (F.col("p_size") > 5).alias("ok"))
    return A.archive_lineage(docs)


@register("k04_document_identity", "SELECT source, sha256(text) AS checksum, arg_max(doc_id, (n_chars % 2, doc_id)) AS doc_id FROM documents GROUP BY 1, 2 UNION ALL SELECT source, 'file' || doc_id % 5, arg_max(doc_id, (n_chars % 2, doc_id)) FROM documents GROUP BY 1, 2")
def k04(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("checksum"), "doc_id", (F.col("n_chars") % 2).alias("seen"), F.concat(F.lit("file"), (F.col("doc_id") % 5).cast("string")).alias("name"))
    by_content = A.document_identity(docs, ["source", "checksum"], "seen", "doc_id").select("source", "checksum", "doc_id")
    return by_content.unionByName(A.document_identity(docs, ["source", "name"], "seen", "doc_id").select("source", F.col("name").alias("checksum"), "doc_id"))


@register("p11_size_mismatch", "SELECT doc_id, abs(n_chars * 900 - CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars * 600 END) > 1048576 AND (doc_id % 3 = 0 OR n_chars * 300 > 0.25 * n_chars * 600) AS mismatch, doc_id % 4 IN (0, 1) AND doc_id % 5 IN (0, 1) AS invalid FROM documents")
def p11(spark: SparkSession, d: str) -> DataFrame:
    k, pick = F.col("doc_id"), lambda *xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs)).cast("int"))
    wrong = A.invalid_response(pick("text/HTML; charset=utf-8", "application/xhtml+xml", "application/pdf", "text/plain"), pick("a.PDF", "b.zip", "c.html", "d", "e.txt"))
    return table(spark, d, "documents").select("doc_id", A.size_mismatch(F.when(k % 3 == 0, 0).otherwise(F.col("n_chars") * 600), F.col("n_chars") * 900).alias("mismatch"), wrong.alias("invalid"))


@register("k03_notification_events", f"WITH {_DIFF} SELECT o_orderkey AS notice_id, CASE outcome WHEN 'UPDATE' THEN 'UPDATE' WHEN 'NEW' THEN 'NEW' ELSE 'REJECTED' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'raw-notice' ELSE 'verdict' END AS form FROM orders LEFT JOIN diff ON external_id = o_orderkey AND o_orderkey % 6 <> 0")
def k03(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), (F.col("o_orderstatus") == "F").alias("failed"))
    return A.notification_events(v, diff(spark, d).where("external_id % 6 <> 0").select(F.col("external_id").alias("notice_id"), "outcome"))


@register("j16_resolve_profile", "SELECT c_custkey AS role, CASE WHEN a.s_suppkey IS NOT NULL THEN a.s_suppkey ELSE b.s_suppkey END AS profile_id FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey % 10 AND a.s_acctbal > 3000 LEFT JOIN supplier b ON b.s_suppkey = (c_custkey + 1) % 10 AND b.s_acctbal > 3000")
def j16(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "customer").select(F.col("c_custkey").alias("role"), (F.col("c_custkey") % 10).alias("primary_id"), ((F.col("c_custkey") + 1) % 10).alias("fallback_id"))
    return A.resolve_profile(roles, table(spark, d, "supplier").select(F.col("s_suppkey").alias("profile_id"), (F.col("s_acctbal") > 3000).alias("active"), F.lit(True).alias("approved")))


@register("p13_test_mode_subject", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[TEST] ' ELSE '' END || CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT ' ELSE '' END || o_orderpriority AS subject, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS violation FROM orders")
def p13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.concat(F.when(k % 4 == 0, "[TEST] [TEST] ").otherwise(""), F.col("o_orderpriority"))
    lists = F.when(k % 3 == 0, F.array(F.lit("dev_alert"))).when(k % 3 == 1, F.array(F.lit("dev_alert"), F.lit("business"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", A.subject(title, F.col("o_orderpriority") == "1-URGENT", k % 2 == 0).alias("subject"), A.test_mode_violation(lists, k % 2 == 0).alias("violation"))


@register("p12_needs_ocr", "SELECT doc_id, k AS page, length(trim(line)) < 25 AS needs_ocr FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)")
def p12(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return pages.select("doc_id", (F.col("k") + 1).alias("page"), A.needs_ocr(F.col("line")).alias("needs_ocr"))


@register("u02_requirement_set_equal", """WITH x AS (SELECT l_orderkey AS k, l_partkey % 3 AS r, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), y AS (SELECT l_orderkey AS k, l_partkey % 3 AS r, count(*) AS m FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL)
    SELECT coalesce(x.k, y.k) AS notice_id, bool_and(n IS NOT NULL AND m IS NOT NULL) AS equal, bool_and(n IS NULL OR m IS NOT NULL) AS subset, bool_and(n IS NOT DISTINCT FROM m) AS same_counts FROM x FULL JOIN y ON x.k = y.k AND x.r = y.r GROUP BY 1""")
def u02(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), (F.col("l_partkey") % 3).alias("requirement"), "l_linenumber")
    return A.requirement_set_equal(li.where("l_linenumber <= 3"), li.where("l_linenumber <> 2"), "notice_id", "requirement")
