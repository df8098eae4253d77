"""Mixed sources, running totals and rate windows by blocks, vocabularies."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from noticelake.operators import assessment as A
from noticelake.operators import operations as O
from noticelake.sources import registry as G

PAYLOAD = "source_id long, payload_id long, url string, content string, fetched_at timestamp, facet string"
CARD = {"card": "<li>[\\s\\S]*?</li>", "link": 'href="([^"]*/n([0-9]+))"', "title": "<b>([^<]*)</b>"}


def page(*numbers):
    return "".join(f'<li><a href="/n{n}">see</a><b>title {n}</b></li>' for n in numbers)


def test_no_payload_is_skipped_in_silence(spark, tmp_path):
    rows = [
        (1, 1, "https://x.org/a", page(1, 2), None, None), (1, 2, "https://x.org/a", "<li>no link</li>", None, None), (2, 3, "", '{"d":[{"i":"7"},{"i":" ","j":"8"}]}', None, None), (3, 4, "", "?", None, None), (4, 5, "", "?", None, None),
        (5, 6, "https://x.org/", page(1, 2), None, "goods"), (5, 7, "https://x.org/", page(2, 3), None, "works"), (5, 8, "https://x.org/", page(9), None, "unasked"), (None, 9, "", "?", None, None), (6, 10, "", "?", None, None),
    ]
    config = [(1, "WAY_OF_OUR_OWN", json.dumps(CARD)), (2, "json_api ", json.dumps({"items": "$.d", "fields": {"external_id": ["$.i", "$.j"]}})), (3, "telegraph", "{}"), (4, "json_api", "[]"), (5, "filtered_html", json.dumps({**CARD, "facets": ["works", "goods"]})), (2, "zzz", "{}"), (None, "rss_atom", "{}")]
    out = G.read_sources(spark.createDataFrame(rows, PAYLOAD), spark.createDataFrame(config, "source_id long, source_type string, settings string"), str(tmp_path), {"way_of_our_own": G.READERS["paginated_html_list"]})
    assert out.schema.simpleString() == spark.createDataFrame([], G.LISTING).schema.simpleString()
    got = sorted(((r.source_id, r.payload_id, r.external_id, r.error_code) for r in out.collect()), key=str)
    assert got == sorted([
        (1, 1, "1", None), (1, 1, "2", None), (1, 2, None, "parser_mismatch"), (2, 3, "7", None), (2, 3, "8", None), (3, 4, None, "unknown_source_type"), (4, 5, None, "invalid_settings"),
        (5, 7, "2", None), (5, 7, "3", None), (5, 6, "1", None), (None, 9, None, "source_not_configured"), (6, 10, None, "source_not_configured"),
    ], key=str)


def test_no_payloads_and_no_configuration(spark, tmp_path):
    config = spark.createDataFrame([], "source_id long, source_type string, settings string")
    assert G.read_sources(spark.createDataFrame([], PAYLOAD), config, str(tmp_path)).collect() == []
    some = spark.createDataFrame([(1, 1, "", "", None, None)], PAYLOAD)
    assert [r.error_code for r in G.read_sources(some, config, str(tmp_path)).collect()] == ["source_not_configured"]


def hot(seed: int, n: int):
    """Requests of one provider that has most of them, in bursts, with equal times, at the ends of blocks and days, and of others."""
    r, day, out = random.Random(seed), 86_400_000_000, []
    for k in range(n):
        at = r.choice([r.randint(0, 3 * day), r.randint(0, 40) * 600_000_000 - r.choice([0, 1, 30_000_000, 59_999_999, 60_000_000]), day + r.randint(-90, 90) * 1_000_000, 7_000_000_000 + r.randint(0, 5) * 1_000_000])
        out.append((k, "hot" if r.random() < 0.8 else r.choice(["a", None]), max(at, 0)))
    return out


@pytest.mark.parametrize("block", [10, 1440])
def test_rate_windows_are_counts_over_all(spark, block):
    rows = hot(3, 500)
    df = spark.createDataFrame(rows, "id int, provider string, us long").select("id", "provider", F.timestamp_micros("us").alias("ts"))
    got = {r.id: (r.in_minute, r.in_day, r.in_60_s, r.over_limit) for r in O.rate_windows(df, "provider", 3, 60, block).collect()}
    for k, key, us in rows:
        mine = [t for _, p, t in rows if p == key]
        minute, day = (sum(t // size == us // size for t in mine) for size in (60_000_000, 86_400_000_000))
        slide, so_far = sum(us - 60_000_000 < t <= us for t in mine), sum(t // 86_400_000_000 == us // 86_400_000_000 and t <= us for t in mine)
        assert got[k] == (minute, day, slide, slide > 3 or so_far > 60)


def test_running_totals_go_on_between_blocks(spark):
    rows = [(k, key, us, k % 7) for k, key, us in hot(5, 400)] + [(1000, "hot", None, 5), (1001, "hot", None, 6), (1002, "a", 10, None)]
    df = spark.createDataFrame(rows, "id int, key string, us long, cost int").select("id", "key", F.timestamp_micros("us").alias("ts"), F.col("cost").cast("double").alias("cost"))
    got = {r.id: r.total for r in O.running_total(df, ["key"], "ts", ["id"], F.coalesce("cost", F.lit(0.0)), "total", "1 hour").collect()}
    order = lambda x: (x[2] is not None, x[2] or 0, x[0])
    for x in rows:
        assert got[x[0]] == sum(y[3] or 0 for y in rows if y[1] == x[1] and order(y) <= order(x))


def test_no_task_holds_a_hot_key(spark):
    """A provider's year is dealt by time: rows of one key lie in many partitions of the windows."""
    at = datetime.datetime(2026, 1, 1)
    df = spark.range(4000).select("id", F.lit("p").alias("provider"), (F.lit(at) + F.make_interval(mins=(F.col("id") * 30).cast("int"))).alias("ts"))
    for out in (O.rate_windows(df, "provider", 1, 60), O.running_total(df, ["provider"], "ts", ["id"], F.lit(1.0), "n")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_block" in line or "_of" in line or "_day" in line for line in windows)


def test_vocabulary_has_plurals_and_roles_of_their_own(spark):
    words = {}
    for r in A.table_vocabulary(spark).collect():
        words.setdefault(r.word, set()).add(r.role)
    assert {"deadlines", "criterios", "certidoes", "currencies", "preco", "prices"} <= set(words) and words["criteria"] == {"evaluation"}
    cells = spark.createDataFrame([(1, 0, "Critérios"), (1, 0, "Notes"), (1, 1, "prix"), (2, 0, "PRICES"), (2, 1, "Currency"), (3, 0, "price"), (4, 0, "weather report")], "table_id int, row int, text string")
    assert {r.table_id: r.role for r in A.classify_tables(cells, A.table_vocabulary(spark)).collect()} == {1: "evaluation", 2: "financial", 3: "other", 4: "other"}
