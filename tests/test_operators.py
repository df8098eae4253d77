"""Literal cases of the notice operators."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from datetime import timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

from pyspark.sql import functions as F

from noticelake.functions import text as T
from noticelake.functions import time as C
from noticelake.functions import urls as U
from noticelake.operators import changes as X
from noticelake.operators import documents as D
from noticelake.operators import evidence as E
from noticelake.operators import operations as O  # noqa: E741
from noticelake.operators import reports as R


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_deadline_texts(spark):
    at = lambda t: one(spark, lambda c: F.date_format(C.parse_absolute_deadline(c), "yyyy-MM-dd HH:mm"), t)
    assert at("End Date: 2026-09-24 13:00:00 UTC") == "2026-09-24 13:00"
    assert at("Deadline for submission of applications: 24 September 2026 at 1.00 pm GMT") == "2026-09-24 13:00"
    assert at("Date limite: le 31 juillet 2026 à 10 h 00 GMT") == "2026-07-31 10:00"
    assert at("Date limite: le 31 juillet 2026 à 10 h 00") is None
    assert at("Closing Soon") is None


def test_relative_deadline(spark):
    left = lambda t: one(spark, lambda a, b: F.date_format(C.parse_relative_deadline(a, b.cast("timestamp")), "yyyy-MM-dd HH:mm"), t, "2026-01-01 00:00:00")
    assert left("5 days left") == "2026-01-06 00:00"
    assert left("7 hours left") == "2026-01-01 07:00"
    assert left("4000 days left") is None
    assert left("2.5 days left") is None and left("12345 days left") is None
    assert left("3 hrs remaining") == "2026-01-01 03:00" and left("2 calendar days to go") == "2026-01-03 00:00"


def test_relative_deadline_texts_as_written(spark):
    raw = lambda t: tuple(one(spark, lambda a, b: F.struct(F.date_format(C.relative_deadline(a, b.cast("timestamp"))["deadline"], "yyyy-MM-dd HH:mm"), C.relative_deadline(a, b.cast("timestamp"))["raw"]), t, "2026-01-01 00:00:00"))
    assert raw("Only 5  Days\tLEFT!") == ("2026-01-06 00:00", "5  Days\tLEFT")
    assert raw("4000 days left, 2 hrs left") == ("2026-01-01 02:00", "2 hrs left")
    assert raw("Tender Closing  Soon.") == (None, "Closing  Soon") and raw("Last date imminent") == (None, "Last date imminent")
    assert raw("delivery within 5 days") == (None, None) and raw("7, days left") == (None, None) and raw("1.5 hours left") == (None, None) and raw("") == (None, None)


def test_written_deadlines_by_tokens(spark):
    at = lambda t: one(spark, lambda c: F.date_format(C.written_deadline(c), "yyyy-MM-dd HH:mm"), t)
    assert at("24 September 2026 at 1.00 p.m. GMT") == "2026-09-24 13:00" and at("24 September 2026 at 12.30 am UTC") == "2026-09-24 00:30"
    assert at("le 31 juillet 2026 à 10 h 00 WAT") == "2026-07-31 09:00" and at("31 juillet 2026 à 10h00 CEST, à") == "2026-07-31 08:00"
    assert at("24 setembro 2026 às 14:00 gmt") == "2026-09-24 14:00" and at("24 September 2026 GMT") == "2026-09-24 00:00"
    assert at("24 September 2026 at 13:00") is None and at("24 September 2026 at 13:00 EST") is None and at("31 February 2026 GMT") is None
    assert at("12 copies 2026. 24 September 2026 GMT") is None and at("no date") is None


def test_mail_dates(spark):
    at = lambda t: one(spark, lambda c: F.date_format(C.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"), t)
    cases = ["Thu, 24 Sep 2026 13:00:00 GMT", "Thu, 24 Sep 2026 13:00 GMT", "24 Sep 2026 13:00:00 EST", "24 Sep 26 13:00 +0130", "Thu 24 September 2026 13:00:05 -0330", "24 Sep 2026 13:00:00", "1 Jan 70 00:00:00 PDT", "24 Sep 2026 13:00:00 WAT"]
    for t in cases:
        want = parsedate_to_datetime(t)
        assert at(t) == (want if want.tzinfo is None else want.astimezone(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S"), t
    assert [at(t) for t in ("Thu, 24 Foo 2026 13:00 GMT", "Thu, 24 Sep 2026 25:00:00 GMT", "24 Sep", "Thu", " ", "24 Sep 2026 noon GMT")] == [None] * 6


def test_secrets_are_masked_whole_at_any_depth(spark):
    r = random.Random(2)
    names = [*T.SECRET_KEYS, "user", "tokens", "x_token", "Secret-2", "a_secret_b", "AUTH", "list"]

    def value(depth):
        kind = r.randint(0, 6 if depth else 3)
        if kind == 0:
            return r.choice(["a\"b", "}{", "token", 'say "secret": {', "", "[é]"])
        return r.choice([1, -2.5, True, None]) if kind < 4 else [value(depth - 1) for _ in range(r.randint(0, 3))] if kind == 4 else {r.choice(names): value(depth - 1) for _ in range(r.randint(0, 4))}

    def masked(v):
        if isinstance(v, dict):
            secret = lambda k: any(k == s or k.endswith(f"_{s}") or k.startswith(f"{s}_") for s in T.SECRET_KEYS)
            return {k: "[REDACTED]" if secret(k.lower().replace("-", "_")) else masked(x) for k, x in v.items()}
        return [masked(x) for x in v] if isinstance(v, list) else v

    docs = [{r.choice(names): value(4) for _ in range(3)} for _ in range(200)]
    for indent in (None, 2):
        texts = [(json.dumps(x, indent=indent, ensure_ascii=False),) for x in docs]
        got = spark.createDataFrame(texts, "t string").select("t", T.redact_fields(F.col("t")).alias("r")).collect()
        assert all(json.loads(x.r) == masked(json.loads(x.t)) for x in got)
    assert one(spark, T.redact_fields, '{"password": [1, {"a": ') == '{"password": "[REDACTED]"'
    assert one(spark, T.redact_text, "password='a b' api-key: x token=\"q\" user=me") == "password=[REDACTED] api-key: [REDACTED] token=[REDACTED] user=me"


def test_urls(spark):
    assert one(spark, U.canonical_url, "HTTPS://A.Example.com/x/?utm_source=f&b=1#top") == "https://a.example.com/x?b=1"
    assert one(spark, U.derive_external_id, "https://a.example.com/x/?b=1") == "a.example.com/x?b=1"
    assert one(spark, U.absolute_url, "https://a.example.com/d/e?q", "../x") == "https://a.example.com/x"
    assert one(spark, U.absolute_url, "https://a.example.com/d/e?q", "/x") == "https://a.example.com/x"
    assert one(spark, U.absolute_url, "https://a.example.com/d/e", "x.pdf") == "https://a.example.com/d/x.pdf"
    assert one(spark, U.absolute_url, "https://a.example.com/d/e", " ") == ""
    assert one(spark, U.storage_name, "../con") == "_con"
    bases = ("https://a.example.com/b/c/d;p?q", "https://a.example.com", "https://a.example.com/d/e/")
    links = ("g", "./g", "g/", "/g", "//g/h", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "g/./h", "g/../h", "/./g", "/../g", "g//h", "http:g")
    pairs = spark.createDataFrame([(base, href) for base in bases for href in links], "base string, href string")
    for r in pairs.withColumn("link", U.absolute_url(F.col("base"), F.col("href"))).collect():
        assert r.link.rstrip("/") == urljoin(r.base, r.href).rstrip("/"), r


def test_text(spark):
    assert one(spark, T.advertised_size, "1,2 MB") == int(1.2 * 1024**2)
    assert one(spark, T.advertised_size, "size") is None
    assert one(spark, T.normalize_quote, "“a”  —\nb") == '"a" - b'
    assert one(spark, T.normalize_quote, "ﬁne①") == "ﬁne①" and one(spark, lambda c: T.normalize_quote(c, nfkc=True), "ﬁne①") == unicodedata.normalize("NFKC", "ﬁne①")
    assert one(spark, T.fold_accents, "Ĉu e\u0301tÉ Ñandú Ż") == "cu ete nandu z"
    assert [one(spark, T.is_placeholder, t) for t in ("...", " n/a ", "<x y>", "unknown", "na", "None")] == [True, True, True, False, False, False]
    assert one(spark, T.is_valid_email, "a@b") is False
    assert one(spark, T.is_valid_email, "a@b.org") is True


def test_diff_rules(spark):
    schema = "source_id int, external_id string, title string, url string, deadline string, marker string"
    cur = spark.createDataFrame([(1, "a", "T", "u", "d", ""), (1, "b", "T2", "u", "d", ""), (1, "c", " T ", "u2", "d", ""), (1, "d", "T2", "u", "d", ""), (1, "e", "T", "u", "d", "")], schema)
    old = spark.createDataFrame([(1, "a", "T", "u", "d", "", "new"), (1, "b", "T", "u", "d", "", "new"), (1, "c", "T", "u", "d", "", "new"), (1, "d", "T", "u", "d", "", "expired")], schema + ", status string")
    got = {r.external_id: (r.outcome, r.changed_fields) for r in X.diff_listings(cur, old, ["source_id", "external_id"], ["title", "url", "deadline"], X.MATERIAL).collect()}
    assert got == {"a": ("UNCHANGED", []), "b": ("UPDATE", ["title"]), "c": ("UNCHANGED", ["url"]), "d": ("UNCHANGED", ["title"]), "e": ("NEW", [])}


def test_upsert_twice_changes_nothing(spark):
    cur = spark.createDataFrame([(1, "x"), (2, "y")], "id int, title string")
    old = spark.createDataFrame([(1, "w", "new")], "id int, title string, status string")
    once = X.upsert_notices(old, cur, ["id"], ["title"])
    twice = X.upsert_notices(once, cur, ["id"], ["title"])
    assert sorted(map(tuple, once.select("id", "title").collect())) == sorted(map(tuple, twice.select("id", "title").collect()))
    assert twice.where("is_update").count() == 0


def test_delivery_limits(spark):
    mib = 1024**2
    files = spark.createDataFrame([(1, k, mib) for k in range(30)], "notification_id int, pos int, size long")
    provider = spark.createDataFrame([(1, 1, 10 * mib, 20, 25 * mib)], "provider_id int, priority int, max_file long, max_files int, max_message long")
    assert tuple(D.plan_delivery(files, provider).select("attached", "linked").first()) == (18, 12)


def test_segments(spark):
    text = ("word " * 3000) + "x" * 9000
    parts = one(spark, lambda c: E.split_segments(c, 1000), text)
    assert "".join(parts) == text and max(map(len, parts)) <= 1000
    at = "x" * 600 + "\n" + "y" * 300 + ". " + "z" * 500  # a later sentence goes before an earlier line break
    assert [len(p) for p in one(spark, lambda c: E.split_segments(c, 1000), at)] == [903, 500]
    assert one(spark, lambda c: E.split_segments(c, 1000), "") == [] and one(spark, lambda c: E.split_segments(c, 10), "ab cd") == ["ab cd"]
    assert one(spark, lambda c: E.split_segments(c, 10), "ab" * 6) == ["ab" * 5, "ab"]
    got = E.split_chunks(spark.createDataFrame([(1, "page:2", "aaaa bbbb cccc"), (1, "page:3", "")], "doc_id int, location string, text string"), 10).collect()
    assert [tuple(r) for r in got] == [(1, "page:2", 0, 0, "aaaa bbbb "), (1, "page:2", 1, 10, "cccc")]


def test_evidence_behind_many_sections_that_do_not_fit(spark):
    big = [(i, "alpha beta gamma " + "x" * 90) for i in range(300)]
    small = [(1000 + i, "alpha beta" + " " * (i % 3)) for i in range(30)]
    sections = spark.createDataFrame(big + small, "section_id int, text string")
    reqs = spark.createDataFrame([(1, "alpha beta gamma")], "req_id int, text string")
    got = sorted((r.position, r.section_id, r.score) for r in E.retrieve_evidence(reqs, sections, 3, 100).collect())
    assert got == [(0, 1000, 2), (1, 1001, 2), (2, 1002, 2)]


def test_evidence_equals_a_plain_walk(spark):
    words = [f"w{i:02}" for i in range(12)]
    sections = [(i, " ".join(words[(i * j) % 12] for j in range(1, 2 + i * 7 % 9)) + "." * (i * 13 % 40)) for i in range(400)]
    reqs = [(r, " ".join(words[r : r + 6])) for r in range(6)]
    want = []
    for r, text in reqs:
        taken, used = 0, 0
        ranked = sorted((-len(set(text.split()) & set(re.findall("[a-z0-9]{3,}", t))), str(i), i, len(t)) for i, t in sections)
        for score, _, i, n in ranked:
            if score and taken < 4 and used + n <= 90:
                want.append((r, i, -score, taken))
                taken, used = taken + 1, used + n
    out = E.retrieve_evidence(spark.createDataFrame(reqs, "req_id int, text string"), spark.createDataFrame(sections, "section_id int, text string"), 4, 90)
    assert sorted(map(tuple, out.select("req_id", "section_id", "score", "position").collect())) == sorted(want)


def test_segments_are_a_plain_walk(spark):
    r, n, texts = random.Random(3), 20, []
    for _ in range(200):
        texts.append("".join(r.choice("ab .;\né𝄞") for _ in range(r.randint(0, 90))))
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.split_segments(F.col("t"), n)).collect():
        want, start = [], 0
        while start < len(text):
            end = min(start + n, len(text))
            if end < len(text):
                cut = max(text.rfind(mark, start + n // 2, end) for mark in ("\n", ". ", "; ", " "))
                end = cut + 1 if cut > start else end
            want.append(text[start:end])
            start = end
        assert got == want


def test_sections_that_stand(spark):
    """What is kept is enough for the walk, and little."""
    r = random.Random(1)
    for _ in range(40):
        rows = [(-r.randint(1, 6), str(i), r.randint(1, 60)) for i in range(300)]
        standing = E.Standing(4)
        for k in range(0, 300, 50):
            standing.add([x for x in rows[k : k + 50] if standing.possible(-x[0], x[2])])

        def walk(entries):
            out, used = [], 0
            for e in sorted(entries):
                if len(out) < 4 and used + e[2] <= 70:
                    out.append(e)
                    used += e[2]
            return out

        assert walk(standing.kept) == walk(rows) and len(standing.kept) < 60


def test_evidence_in_blocks_of_requirements_with_headings(spark):
    sections = [(i, f"h{i % 7:03} head", f"body{i % 5:03} text" + "." * (i % 9), f"tag{i % 3:03}") for i in range(300)]
    reqs = [(r, f"h{r:03} body{r % 5:03} tag{r % 3:03} nothing") for r in range(9)] + [(20, ""), (21, None)]
    df = spark.createDataFrame(sections, "section_id long, heading string, text string, metadata string")
    ask = spark.createDataFrame(reqs, "req_id long, text string")
    one_pass, many = (sorted(map(tuple, E.retrieve_evidence(ask, df, 5, 100, n).withColumn("signals", F.array_join("signals", " ")).collect())) for n in (1 << 20, 6))
    assert one_pass == many and {x[0] for x in many} == set(range(9))
    want = []
    for r, text in reqs[:9]:
        ranked, used, taken = sorted((-len(set(re.findall("[a-z0-9]{3,}", " ".join(s[1:]))) & set(text.split())), str(s[0]), s) for s in sections), 0, 0
        for score, _, s in ranked:
            size = len(s[1]) + len(s[2])
            if score and taken < 5 and used + size <= 100:
                common = sorted(set(re.findall("[a-z0-9]{3,}", " ".join(s[1:]))) & set(text.split()))
                want.append((r, s[0], -score, taken, " ".join(f"keyword:{w}" for w in common)))
                used, taken = used + size, taken + 1
    assert many == sorted(want)
    assert E.retrieve_evidence(ask.limit(0), df).collect() == [] and E.retrieve_evidence(ask, df.limit(0)).collect() == []


def test_quotes_with_ellipses_and_lists_of_locations(spark):
    chunks = spark.createDataFrame([(1, "section:1", "Bidders shall submit a valid tax clearance"), (1, "section:2", "certificate and three  years of audited accounts."), (3, "page:1", "one"), (3, "page:10", "ten"), (3, "page:2", "two ﬁnal")], "doc_id int, location string, text string")
    cites = [
        (1, 1, "section:1", "Bidders shall submit ... years of audited accounts", "fragments", "section:1"),
        (2, 1, "section:1", "Bidders shall submit… and …three years of audited", "fragments", "section:1"),
        (3, 1, "section:1", "years of audited accounts ... Bidders shall submit", "quote_not_found", None),
        (4, 1, "section:1", "Bidders ... shall", "quote_not_found", None),
        (5, 1, "section:1", "Bidders shall submit ... invented words in place", "quote_not_found", None),
        (6, 1, "section:9, section:2", "certificate and", "exact", "section:2"),
        (7, 1, "section:1, section:2", "and three years", "normalized", "section:2"),
        (8, 1, "section:1,section:9", "clearance certificate", "document", "section:1"),
        (9, 1, None, "valid tax", "location_unknown", None),
        (10, 2, "section:1", "valid tax", "document_missing", None),
        (11, 1, "page:99", "valid tax", "location_unknown", None),
        (12, 1, "section:1", "", "empty_quote", None),
        (13, 1, "section:2", None, "empty_quote", None),
        (14, 3, "page:1", "one two", "document", "page:1"),
        (15, 3, "page:1", "two final ten", "document", "page:2"),
        (16, 3, "page:1", "one ten", "quote_not_found", None),
        (17, 1, "section:1", "years of audited accounts", "document", "section:2"),
    ]
    for folded, skipped in ((True, ()), (False, (15,))):
        out = E.verify_quotes(spark.createDataFrame(cites, "cite_id int, doc_id int, location string, quote string, want string, at string").drop("want", "at"), chunks, lambda c: T.normalize_quote(c, nfkc=folded))  # noqa: B023
        assert sorted(tuple(r) for r in out.collect() if r.cite_id not in skipped) == [(c[0], *c[4:]) for c in cites if c[0] not in skipped]


def test_crawl_ends_at_a_declared_total_or_a_visited_url(spark):
    rows = [("total", p, 2 * p + i, 4, f"u{p}") for p in (1, 2, 3) for i in range(2)]
    rows += [("visited", p, 2 * p + i, None, u) for p, u in ((1, "a"), (2, "b"), (3, "a"), (4, "c")) for i in range(2)]
    rows += [("short", p, 2 * p + i, 90, f"u{p}") for p in (1, 2) for i in range(3 - p)]
    rows += [("most", p, 2 * p + i, 90, "a" if p > 4 else f"u{p}") for p in range(1, 7) for i in range(2)]
    rows += [("end", p, 2 * p + i, None, None) for p in (1, 2) for i in range(2)]
    out = X.crawl_stop_report(spark.createDataFrame(rows, "crawl string, page int, item int, total int, url string"), 4, 2)
    assert {r.crawl: (r.stop_page, r.reason, r.kept_items) for r in out.collect()} == {
        "total": (2, "total_reached", 4), "visited": (2, "already_visited_url", 4), "short": (2, "short_page", 3), "most": (4, "max_pages_reached", 8), "end": (2, "no_next_page", 4)
    }


def _most_rows(df) -> int:
    """The most rows that a join of the executed plan gave."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        # behind adaptive plans and their stages
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_routing_meets_each_profile_and_address_once(spark):
    """500 notifications and 600 recipients with two addresses: no join gives more than the rows of the result; repeated ids lose and repeat nothing."""
    n = spark.range(500).selectExpr("id AS notification_id", "id % 3 AS source_id", "CASE WHEN id % 5 > 0 THEN 'APPLY' END AS recommendation", "id % 2 = 0 AS urgent")
    p = spark.range(600).selectExpr("id + 7 AS recipient_id", "concat(' A', id % 2, '@x.org') AS email", "CASE WHEN id % 4 = 3 THEN 'dev_alert' ELSE 'business' END AS list_type", "CASE id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'apply' ELSE 'urgent' END AS receives", "CASE WHEN id % 6 = 5 THEN array(id % 3) ELSE array() END AS scope", "id > 9 AS active")
    out = O.route_recipients(n, p)
    got = {(r.notification_id, r.email, r.delivery): (r.recipient_id, r.list_type) for r in out.collect()}
    want = {}
    for k in range(500):
        for i in range(10, 600):
            dev, scope, receives = i % 4 == 3, [i % 3] if i % 6 == 5 else [], ("all", "apply", "urgent")[i % 3]
            fits = dev if k % 5 == 0 else not dev and (not scope or k % 3 in scope) and (receives != "urgent" or k % 2 == 0)
            if fits:
                want.setdefault((k, f"a{i % 2}@x.org", "to"), (i + 7, "dev_alert" if dev else "business"))
    assert got == want and _most_rows(out) <= len(want)
    assert _most_rows(O.route_recipients(n, p, test_mode=True)) <= 1000
    assert _most_rows(O.routing_failed(n, p)) <= 500 and O.routing_failed(n, p).count() == 0
    assert O.routing_failed(n, p.where("list_type = 'business'")).count() == 100
    twice = n.unionByName(n.withColumn("urgent", F.expr("NOT urgent")))
    assert O.route_recipients(twice, p).groupBy("notification_id", "email", "delivery").count().where("count > 1").isEmpty()


def test_alerts_are_routed_by_profile(spark):
    """Repeated alerts and recipients give each pair once, and pairs aren't shuffled to find that."""
    a = spark.createDataFrame([(1, "x", "info"), (1, "y", "critical"), (1, "x", "info"), (2, "y", "warning"), (3, None, "critical"), (4, "x", "other"), (5, "z", "info")], "alert_id long, alert_type string, severity string")
    r = spark.createDataFrame([(1, [], "info"), (1, ["x"], "info"), (2, ["x", "y", "y"], "warning"), (3, ["x"], "critical"), (4, None, "critical")], "recipient_id long, alert_types array<string>, min_severity string")
    got = sorted(tuple(x) for x in R.route_alerts(a, r).collect())
    assert got == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (3, 1), (3, 4), (5, 1)]
    last = R.route_alerts(a, r)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate" in line for line in last[: next(k for k, line in enumerate(last) if "Join" in line)])


def test_pairs_of_alerts_are_made_by_many_tasks(spark):
    """600 alerts and 2,000 recipients: inputs of few bytes and 833,300 pairs, of which no task makes a quarter."""
    a = spark.range(600).selectExpr("id AS alert_id", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS alert_type", "get(array('info', 'warning', 'critical'), CAST(id % 3 AS INT)) AS severity")
    r = spark.range(2000).selectExpr("id AS recipient_id", "CASE id % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('x') ELSE array('x', 'y') END AS alert_types", "get(array('info', 'warning'), CAST(id % 2 AS INT)) AS min_severity")
    want = sum((k % 2 == 0 or i % 3 != 1) and k % 3 >= i % 2 for k in range(600) for i in range(2000))
    made = [x["count"] for x in R.route_alerts(a, r).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == want and max(made) < want / 4


def test_audit_numbers_an_entity_by_blocks(spark):
    """Positions run over all of an entity's blocks, changes without a time last; no window is over a whole entity's changes."""
    rows = [(k, "e" if k % 3 else None, None if k % 17 == 0 else f"2024-01-{k % 4 + 1:02d} 0{k % 5}:00:00", {"k": "v"}) for k in range(200)]
    df = spark.createDataFrame(rows, "change_id long, entity string, at string, fields map<string,string>")
    timed, apart = df.withColumn("ts", F.col("at").cast("timestamp")).drop("at"), df.drop("at").withColumn("change_id", F.col("change_id") * 10_000)
    for out, order in ((R.config_audit(timed), lambda x: (x[2] or "", x[0])), (R.config_audit(apart), lambda x: x[0])):
        want = {(x[0], n) for e in ("e", None) for n, x in enumerate(sorted((x for x in rows if x[1] == e), key=order, reverse=True), 1)}
        assert {(r.change_id if "ts" in out.columns else r.change_id // 10_000, r.position) for r in out.collect()} == want
        numbered = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x and "Window" in x]
        assert numbered and all(re.search(r"row_number\(\) windowspecdefinition\(entity#[0-9]+, _block#", x) for x in numbered)
