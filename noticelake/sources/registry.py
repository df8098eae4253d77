"""Readers of listings by their sources' types, chosen by a configuration table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.changes import union_facets
from noticelake.sources import landed as L

#: Columns of a listing, whatever its source's type; ``error_code`` says why a payload gave none.
LISTING = "source_id long, payload_id long, position int, external_id string, link string, title string, published timestamp, deadline timestamp, deadline_raw string, reference string, error_code string"
#: Different readers that a configuration may have: types with their settings, not sources.
MAX_READERS = 500

Reader = Callable[[DataFrame, dict], DataFrame]


def _id() -> Column:
    return F.struct("source_id", "payload_id")


def _html(payloads: DataFrame, settings: dict) -> DataFrame:
    """S1: cards of a page; settings are those of ``Listing``."""
    pages = payloads.select(_id().alias("page_id"), "url", F.col("content").alias("html"), "fetched_at")
    return L.read_html_listings(pages, L.Listing(**settings)).withColumn("id", F.col("page_id"))


def _facets(payloads: DataFrame, settings: dict) -> DataFrame:
    """S1 for each facet of a filter, and S5 over them in the order of ``facets``: of a source's listings with one id the first stays."""
    settings = dict(settings)
    order = settings.pop("facets")
    found = _html(payloads, settings)
    pages = payloads.select(_id().alias("id"), "facet")
    both = found.join(pages, "id")
    sound = both.where("error_code IS NULL").withColumns({"key": F.struct("id.source_id", "external_id"), "place": F.struct("id.payload_id", "position")})
    return union_facets(sound, "key", "facet", "place", order).unionByName(both.where("error_code IS NOT NULL"), allowMissingColumns=True)


def _feed(payloads: DataFrame, settings: dict) -> DataFrame:
    """S2: entries of RSS, RDF and Atom; settings are those of ``read_feed_listings``."""
    return L.read_feed_listings(payloads.select(_id().alias("feed_id"), F.col("content").alias("xml")), **settings).withColumn("id", F.col("feed_id"))


def _json(payloads: DataFrame, settings: dict) -> DataFrame:
    """S3: objects at ``items`` with ``fields`` by their paths."""
    return L.read_json_listings(payloads.select(_id().alias("payload_id"), F.col("content").alias("json")), settings["items"], settings["fields"]).withColumn("id", F.col("payload_id"))


# Names of the types of sources.
READERS: dict[str, Reader] = {"paginated_html_list": _html, "search_form": _html, "filtered_html": _facets, "rss_atom": _feed, "json_api": _json}


def _listing(rows: DataFrame) -> DataFrame:
    """Any reader's rows in the columns of a listing."""
    out = []
    for field in LISTING.split(", "):
        name, kind = field.split()
        c = F.col(f"id.{name}") if name in ("source_id", "payload_id") else F.col(name) if name in rows.columns else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return rows.select(*out)


def read_sources(payloads: DataFrame, config: DataFrame, folder: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(source_id, payload_id, url, content, fetched_at, facet) and (source_id, source_type, settings as JSON) -> listings of all sources.

    A payload of a type that has no reader gives a row with ``error_code``
    ``unknown_source_type``, one of a source without configuration
    ``source_not_configured``, and one of settings that are no JSON object
    ``invalid_settings``: none is skipped in silence.  Types are taken without
    regard to case and white space; ``readers`` add to the known ones or replace them.

    Payloads are dealt once, into a table in ``folder`` (which executors
    share) with a partition for each reader, so that each reader scans its own
    payloads only.  A source that is configured twice is read by the first of
    its types and settings in their order.
    """
    spark = payloads.sparkSession
    known = {**READERS, **(readers or {})}
    one = config.where("source_id IS NOT NULL").groupBy("source_id").agg(F.min(F.struct(F.lower(F.trim(F.coalesce("source_type", F.lit("")))).alias("source_type"), F.coalesce("settings", F.lit("{}")).alias("settings"))).alias("c")).select("source_id", "c.*")
    kinds = [(r.source_type, r.settings) for r in one.select("source_type", "settings").distinct().orderBy("source_type", "settings").limit(MAX_READERS + 1).collect()]
    if len(kinds) > MAX_READERS:
        raise ValueError(f"more than {MAX_READERS} different readers")
    numbers = spark.createDataFrame([(*k, i) for i, k in enumerate(kinds)], "source_type string, settings string, reader int")
    path = f"{folder}/{uuid.uuid4().hex}"
    tagged = payloads.join(one.join(numbers, ["source_type", "settings"]).select("source_id", "reader"), "source_id", "left").withColumn("reader", F.coalesce("reader", F.lit(-1)))
    tagged.write.partitionBy("reader").parquet(path)
    dealt = spark.read.schema(tagged.schema).parquet(path)

    def failed(number: int, code: str) -> DataFrame:
        return _listing(dealt.where(F.col("reader") == number).select(_id().alias("id"), F.lit(code).alias("error_code")))

    parts = [failed(-1, "source_not_configured")]
    for number, (kind, settings) in enumerate(kinds):
        try:
            values = json.loads(settings)
        except ValueError:
            values = None
        if kind not in known:
            parts.append(failed(number, "unknown_source_type"))
        elif not isinstance(values, dict):
            parts.append(failed(number, "invalid_settings"))
        else:
            parts.append(_listing(known[kind](dealt.where(F.col("reader") == number), values)))
    return reduce(DataFrame.unionByName, parts)
