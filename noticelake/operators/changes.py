"""Change detection of listings against a seen snapshot, upserts, statuses and backlogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.text import same_instant, same_text

FIELDS = ("title", "url", "published", "deadline", "deadline_zone", "reference", "addendum_marker")
#: Fields whose change makes an update, with the kind of change; a marker that was blank before is an addendum.
MATERIAL = {"title": "TITLE_CHANGED", "deadline": "DEADLINE_CHANGED", "addendum_marker": "CHANGE_MARKER_CHANGED"}
ADDED = {"addendum_marker": "ADDENDUM_ADDED"}
TERMINAL = ("verdict_failed", "expired")


def dedupe_listings(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first listing of each id in order of arrival, with the number of ``duplicates`` dropped for it.

    Listings with a blank id are dropped and count as duplicates: one row with
    nothing but their number, where there are any.
    """
    order = Window.partitionBy(key).orderBy(position)
    named = F.coalesce(F.trim(F.col(key)), F.lit("")) != ""
    known = df.where(named)
    counts = known.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("duplicates"))
    first = known.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn").join(counts, key)
    blank = df.where(~named).agg(F.count(F.lit(1)).alias("duplicates")).where("duplicates > 0")
    return first.unionByName(blank, allowMissingColumns=True)


def validate_candidates(df: DataFrame, identity: str, required: Sequence[str]) -> DataFrame:
    """Appends ``error_code``: blank identity, a blank required field, or null for sound rows."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bad = F.lit(False)
    for c in required:
        bad = bad | blank(c)
    return df.withColumn("error_code", F.when(blank(identity), "dedup_missing_identity").when(bad, "dedup_malformed_candidate"))


def _same(a: Column, b: Column, name: str, types: dict[str, str]) -> Column:
    return same_text(a, b) if types[name] == "string" else same_instant(a, b) if types[name].startswith("timestamp") else a.eqNullSafe(b)


def diff_listings(current: DataFrame, seen: DataFrame, keys: Sequence[str], fields: Sequence[str], material: dict[str, str] = MATERIAL, status: str = "status", terminal: Sequence[str] = TERMINAL, added: dict[str, str] = ADDED) -> DataFrame:
    """Current listings with ``outcome`` (NEW, UPDATE, UNCHANGED), ``changed_fields``, ``change_types`` and ``changes`` (field, before, after).

    A left join on the keys; text compares with white space folded, times as
    instants.  Only material fields make an update, and a notice in a terminal
    status stays unchanged.  A field of ``added`` that was blank before has that
    kind of change.  The join's keys carry the partitioning; a hot source is
    spread by its external ids.
    """
    types = dict(current.dtypes)
    old = seen.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_old_{f}") for f in fields], F.col(status).alias("seen_status"), F.lit(True).alias("_seen"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    both = current.join(old, on, "left")
    differs = {f: F.col("_seen").isNotNull() & ~_same(F.col(f), F.col(f"_old_{f}"), f, types) for f in fields}
    changed = F.array_compact(F.array(*[F.when(differs[f], F.lit(f)) for f in fields]))
    blank = lambda f: F.coalesce(F.trim(F.col(f"_old_{f}").cast("string")), F.lit("")) == ""
    kind = lambda f: F.when(blank(f), added[f]).otherwise(material[f]) if f in added else F.lit(material[f])
    kinds = F.array_compact(F.array(*[F.when(differs[f], kind(f)) for f in material if f in fields]))
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after"))
    changes = F.array_compact(F.array(*[F.when(differs[f], pair(f)) for f in fields]))
    frozen = F.coalesce(F.col("seen_status").isin(*terminal), F.lit(False))
    outcome = F.when(F.col("_seen").isNull(), "NEW").when((F.size(kinds) > 0) & ~frozen, "UPDATE").otherwise("UNCHANGED")
    return both.withColumns({"changed_fields": changed, "change_types": kinds, "changes": changes, "outcome": outcome}).select(*current.columns, "seen_status", "changed_fields", "change_types", "changes", "outcome")


def dedup_summary(diff: DataFrame, by: Sequence[str], arrived: DataFrame | None = None, key: str = "external_id") -> DataFrame:
    """New, updated and unchanged listings by group, and their sum; with the listings as they ``arrived`` also the duplicates, blank ids among them."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = diff.groupBy(*by).agg(n("NEW").alias("new_count"), n("UPDATE").alias("update_count"), n("UNCHANGED").alias("unchanged_count"), F.count(F.lit(1)).alias("listings_found"))
    if arrived is None:
        return out
    named = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    per_id = arrived.groupBy(*by, named.alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    extra = per_id.groupBy(*by).agg(F.sum(F.col("_n") - F.when(F.col("_id").isNull(), 0).otherwise(1)).alias("duplicate_count"))
    return out.join(extra, list(by), "left").fillna(0, ["duplicate_count"])


def upsert_notices(seen: DataFrame, current: DataFrame, keys: Sequence[str], mutable: Sequence[str], merged: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: new notices with status ``new``, known ones with mutable fields overwritten, status and ``is_update`` set where one changed, the rest as they were.

    The maps named by ``merged`` keep their old keys; of keys on both sides the
    new value counts.
    """
    fields = [*mutable, *merged]
    new = current.select(*keys, *[F.col(m).alias(f"_new_{m}") for m in fields], F.lit(True).alias("_current"))
    both = seen.withColumn("_seen", F.lit(True)).join(new, list(keys), "full_outer")

    def union(m: str) -> Column:
        old, add = F.coalesce(F.col(m), F.create_map().cast(seen.schema[m].dataType)), F.coalesce(F.col(f"_new_{m}"), F.create_map().cast(seen.schema[m].dataType))
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(add, k)), add)

    plain = lambda c: F.array_sort(F.map_entries(c))
    differs = [~F.col(m).eqNullSafe(F.col(f"_new_{m}")) for m in mutable] + [~plain(F.col(m)).eqNullSafe(plain(union(m))) for m in merged]
    changed = F.col("_seen").isNotNull() & F.col("_current").isNotNull() & F.exists(F.array(*differs), lambda x: x)
    status = F.when(F.col("_seen").isNull(), "new").when(changed, "updated").otherwise(F.col("status"))
    values = [F.when(F.col("_current"), F.col(f"_new_{m}")).otherwise(F.col(m)).alias(m) for m in mutable] + [union(m).alias(m) for m in merged]
    return both.select(*keys, *values, status.alias("status"), F.coalesce(changed, F.lit(False)).alias("is_update"))


def unprocessed(df: DataFrame, now: Column, limit: int) -> DataFrame:
    """Open notices that are new, oldest first, up to ``limit``: the feature is a batch."""
    return df.where((F.col("status") == "new") & (F.col("deadline").isNull() | (F.col("deadline") > now))).orderBy("first_seen_at", "id").limit(limit)


def expired(df: DataFrame, now: Column, sources: DataFrame | None = None) -> DataFrame:
    """New notices whose deadline has passed; with ``sources`` (source_id) only theirs, none for an empty table."""
    out = df.where((F.col("status") == "new") & (F.col("deadline") <= now))
    return out if sources is None else out.join(sources.select("source_id").distinct(), "source_id", "left_semi")


def recover_backlog(selected: DataFrame, notices: DataFrame, now: Column, limit: int) -> DataFrame:
    """The work of a run: what is new or updated, then the oldest unprocessed others, up to ``limit``."""
    rest = unprocessed(notices.join(selected.select("id"), "id", "left_anti"), now, limit).select("id", F.lit("backlog").alias("origin"))
    return selected.select("id", F.lit("selected").alias("origin")).unionByName(rest)


def status_history(df: DataFrame, key: str, ts: str, order: str, state: str) -> DataFrame:
    """Appends the ``previous`` state, ``seconds_in_state`` until the next event, and ``visit``, the number of state changes so far."""
    w = Window.partitionBy(key).orderBy(ts, order)
    out = df.withColumn("previous", F.lag(state).over(w))
    out = out.withColumn("seconds_in_state", (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)
    return out.withColumn("visit", F.sum(F.when(F.col("previous").eqNullSafe(F.col(state)), 0).otherwise(1)).over(w))


def validate_transitions(df: DataFrame, key: str, ts: str, order: str, state: str, edges: DataFrame) -> DataFrame:
    """Events whose step from the state before isn't among ``edges`` (from_state, to_state); staying is allowed."""
    steps = df.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(ts, order))).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    return steps.withColumn("to_state", F.col(state)).join(edges, ["from_state", "to_state"], "left_anti").drop("to_state")


def union_facets(df: DataFrame, key: str, facet: str, position: str, order: Sequence[str]) -> DataFrame:
    """The union of facet walks in the configured ``order``: the first facet that shows an id wins; with its ``facet_index``.  Facets that aren't configured aren't walked."""
    index = F.array_position(F.array(*map(F.lit, order)), F.col(facet)) - 1
    walked = df.where(F.col(facet).isin(*order)).withColumn("facet_index", index.cast("int"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy("facet_index", position))
    return walked.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def crawl_stop_report(items: DataFrame, most_pages: int, page_size: int) -> DataFrame:
    """(crawl, page, item) -> (crawl, stop_page, reason, kept_items): where a crawl ends and why.

    A page after the first that shows nothing new ends it, as does a short page
    or the page limit; later pages don't count.  Items may have the ``total``
    that their page declares, which ends the crawl once so many rows were shown,
    and their page's ``url``: before one that was visited the crawl ends.
    """
    first = items.groupBy("crawl", "item").agg(F.min("page").alias("page"))
    fresh = first.groupBy("crawl", "page").agg(F.count(F.lit(1)).alias("fresh"))
    more = [F.max(c).alias(c) for c in ("total", "url") if c in items.columns]
    pages = items.groupBy("crawl", "page").agg(F.count(F.lit(1)).alias("n"), *more).join(fresh, ["crawl", "page"], "left").fillna(0, ["fresh"])
    reason = F.when((F.col("page") > 1) & (F.col("fresh") == 0), "no_new_items")
    if "total" in items.columns:
        pages = pages.withColumn("shown", F.sum("n").over(Window.partitionBy("crawl").orderBy("page")))
        reason = reason.when(F.col("shown") >= F.col("total"), "total_reached")
    reason = reason.when(F.col("n") < page_size, "short_page").when(F.col("page") >= most_pages, "max_pages_reached")
    if "url" in items.columns:
        visited = F.col("url").isNotNull() & (F.col("page") > F.min("page").over(Window.partitionBy("crawl", "url")))
        pages = pages.withColumn("visited", visited).withColumn("visited_next", F.lead("visited").over(Window.partitionBy("crawl").orderBy("page")))
        reason = reason.when(F.col("visited_next"), "already_visited_url")
    stops = pages.withColumn("reason", reason)
    stop = stops.groupBy("crawl").agg(F.coalesce(F.min(F.when(F.col("reason").isNotNull(), F.col("page"))), F.max("page")).alias("stop_page"))
    kept = pages.join(stop, "crawl").where("page <= stop_page").groupBy("crawl").agg(F.sum("fresh").alias("kept_items"))
    why = stops.select("crawl", F.col("page").alias("stop_page"), F.coalesce("reason", F.lit("no_next_page")).alias("reason"))
    return stop.join(why, ["crawl", "stop_page"]).join(kept, "crawl")
