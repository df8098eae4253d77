"""Landed payloads as listings: HTML pages, feeds, JSON, documents and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import advertised_size, clean_text, hint_language, let
from noticelake.functions.time import parse_absolute_deadline, parse_timestamp, relative_deadline
from noticelake.functions.urls import absolute_url, bare_media_type, guess_mime

DOCUMENT_SUFFIXES = ("pdf", "doc", "docx", "zip", "xls", "xlsx", "csv", "txt")


def unescape(c: Column) -> Column:
    """Tags dropped and the five named entities resolved."""
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return clean_text(t)


class Listing(NamedTuple):
    """How a page shows listings: expressions for a ``card``, and within it for its ``link`` (group 1 the address, group 2 the id), ``title``, and, in group 1, ``published`` and ``reference``; ``deadline`` says whether the card's text is read for one."""

    card: str
    link: str
    title: str
    published: str | None = None
    reference: str | None = None
    deadline: bool = False


def read_html_listings(pages: DataFrame, config: Listing) -> DataFrame:
    """(page_id, url, html, fetched_at) -> listings, one per card whose link is known: external_id, link, title, published, deadline, deadline_raw, reference, language and provenance.

    A deadline is a written one with a zone, else what remains counted from the
    moment the page was fetched.  Pages whose cards hold no known link give one
    row with ``error_code`` ``parser_mismatch``; pages without cards give none.
    """
    fetched = F.col("fetched_at").cast("timestamp") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    cards = pages.select("page_id", "url", fetched.alias("fetched_at"), F.posexplode(F.regexp_extract_all("html", F.lit(config.card), F.lit(0))).alias("position", "card")).withColumn("text", unescape(F.col("card")))
    get = lambda p, k: F.regexp_extract("card", p, k)
    blank = F.lit(None).cast("string")
    nothing = F.lit(None).cast("timestamp")

    def due(text: Column) -> Column:
        either = lambda written, left: F.struct(F.coalesce(written, left["deadline"]).alias("deadline"), F.when(written.isNull(), left["raw"]).alias("raw"))
        return let(parse_absolute_deadline(text), lambda w: let(relative_deadline(text, F.col("fetched_at")), lambda r: either(w, r)))

    if config.deadline:
        cards = cards.withColumn("due", let(F.col("text"), due))
    rows = cards.select(
        "page_id", "position", F.nullif(get(config.link, 2), F.lit("")).alias("external_id"), absolute_url(F.col("url"), get(config.link, 1)).alias("link"), unescape(get(config.title, 1)).alias("title"), (parse_timestamp(get(config.published, 1)) if config.published else nothing).alias("published"),
        (F.col("due.deadline") if config.deadline else nothing).alias("deadline"), (F.col("due.raw") if config.deadline else blank).alias("deadline_raw"), (F.nullif(unescape(get(config.reference, 1)), F.lit("")) if config.reference else blank).alias("reference"),
        hint_language(F.col("text")).alias("language"), F.struct(F.lit("html").alias("response_kind"), F.col("url").alias("discovery_url"), F.lit("link_pattern").alias("identity_source")).alias("provenance"),
    )
    found = rows.where("external_id IS NOT NULL AND link <> ''").withColumn("error_code", blank)
    broken = rows.groupBy("page_id").agg(F.max("external_id").alias("any")).where("any IS NULL").select("page_id", F.lit("parser_mismatch").alias("error_code"))
    return found.unionByName(broken, allowMissingColumns=True)


def read_feed_listings(feeds: DataFrame, max_items: int = 200, body: int = 2000, pattern: str | None = None) -> DataFrame:
    """(feed_id, xml) -> entries of RSS, RDF and Atom feeds, without regard to prefixes.

    The id is what ``pattern`` finds in the link (group 1), else the guid or id,
    else the link; the time the first readable of pubDate, published, updated,
    date and modified.  ``max_items`` 0 means all.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col("xml"), r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"(?s)<\?xml.*?\?>", "")
    entries = feeds.select("feed_id", F.posexplode(F.regexp_extract_all(plain, F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))).alias("position", "x"))
    tag = lambda *names: F.coalesce(*[F.nullif(unescape(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{n}(?: [^>]*)?>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")) for n in names])
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("x", r'(?i)<link[^>]*href="([^"]*)"', 1), F.lit("")))
    when = F.coalesce(*[let(tag(n), parse_timestamp) for n in ("pubdate", "published", "updated", "date", "modified")])
    out = entries.select("feed_id", "position", F.coalesce(*([F.nullif(F.regexp_extract(link, pattern, 1), F.lit(""))] if pattern else []), tag("guid", "id"), link).alias("external_id"), link.alias("link"), tag("title").alias("title"), when.alias("published"), F.substring(F.coalesce(tag("description", "summary"), F.lit("")), 1, body).alias("body"))
    return out.where(F.col("position") < max_items) if max_items else out


def read_json_listings(payloads: DataFrame, items: str, fields: dict[str, list[str]]) -> DataFrame:
    """(payload_id, json) -> one row per object at ``items``; a field is the first non-blank scalar among its paths.

    A deadline counts only with an offset, a Z or as an epoch number; otherwise
    its text stays in ``deadline_raw`` and the instant is null.
    """
    exploded = payloads.select("payload_id", F.posexplode(F.from_json(F.get_json_object("json", items), "array<string>")).alias("position", "x"))
    first = lambda paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object("x", p)), F.lit("")) for p in paths])
    out = exploded.select("payload_id", "position", *[first(paths).alias(n) for n, paths in fields.items()])
    if "deadline" in fields:
        exact = F.col("deadline").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$|^-?[0-9]+([.][0-9]+)?$")
        out = out.withColumn("deadline_raw", F.col("deadline")).withColumn("deadline", F.when(exact, parse_timestamp(F.col("deadline"))))
    return out


class Details(NamedTuple):
    """Paths into a detail payload: candidates for a text, in order; one for an array; and the fields of its items."""

    entity: Sequence[str]
    scope: Sequence[str]
    references: str
    hints: str
    hint_text: str
    files: str
    link: str
    name: str
    kind: str
    size: str


def read_json_details(payloads: DataFrame, paths: Details) -> DataFrame:
    """(payload_id, url, json) -> entity, scope, references, requirement hints, and attachments (link, name, mime, size).

    Hints may be texts or objects with a text, references one or many.  An
    attachment needs a link; its name is the stated one or the link's last part,
    its type the stated one or that of the name; a size is a number or a text
    such as ``1,2 MB``.
    """
    payloads = payloads.select("payload_id", "url", F.try_parse_json("json").alias("json"))  # each text is parsed once, as its paths are many
    v = lambda: F.col("json")
    text = lambda of, p: F.nullif(clean_text(F.try_variant_get(of, p, "string")), F.lit(""))
    first = lambda candidates: F.coalesce(*[text(v(), p) for p in candidates])
    items = lambda p: F.coalesce(F.try_variant_get(v(), p, "array<variant>"), F.when(F.try_variant_get(v(), p, "variant").isNotNull(), F.array(F.try_variant_get(v(), p, "variant"))), F.array().cast("array<variant>"))
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    link = lambda x: absolute_url(F.col("url"), text(x, paths.link))
    name = lambda x: F.coalesce(text(x, paths.name), F.regexp_extract(text(x, paths.link), r"([^/?#]*)(?:[?#].*)?$", 1))
    size = lambda x: F.coalesce(F.try_variant_get(x, paths.size, "bigint"), advertised_size(F.try_variant_get(x, paths.size, "string")))
    attachment = lambda x: F.struct(link(x).alias("link"), name(x).alias("name"), F.coalesce(bare_media_type(text(x, paths.kind)), guess_mime(name(x))).alias("mime"), size(x).alias("size"))
    return payloads.select(
        "payload_id", first(paths.entity).alias("entity"), first(paths.scope).alias("scope"), some(F.transform(items(paths.references), lambda x: text(x, "$"))).alias("references"),
        some(F.transform(items(paths.hints), lambda x: F.coalesce(text(x, paths.hint_text), text(x, "$")))).alias("hints"), F.transform(F.filter(items(paths.files), lambda x: text(x, paths.link).isNotNull()), attachment).alias("attachments"),
    )


ARCHIVE_TYPES = ("application/zip", "application/x-zip-compressed")


def extract_page_links(pages: DataFrame, excluded: Sequence[str] = (), markers: Sequence[str] = ()) -> DataFrame:
    """(page_id, url, html) -> (page_id, position, link, name, mime, is_document, is_zip) of the anchors.

    Addresses beyond ASCII go, blank ones, those that one of the ``excluded``
    expressions finds, and links to the next page.  A document has a known
    suffix or one of the ``markers`` in its address; its name is the address's
    last part if that has a dot, else the anchor's text.
    """
    anchor = r"(?s)<a ([^>]*)>(.*?)</a>"
    tags = pages.select("page_id", "url", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("text"))).alias("position", "x"))
    anchors = tags.select("page_id", "url", "position", F.regexp_extract("x.tag", r'(?:^|\s)href="([^"]*)"', 1).alias("href"), F.lower(F.regexp_extract("x.tag", r'(?:^|\s)rel="([^"]*)"', 1)).alias("rel"), unescape(F.col("x.text")).alias("text"))
    bad = F.col("href").rlike(r"[^\x00-\x7F]") | (F.trim("href") == "") | F.array_contains(F.split("rel", " +"), "next")
    for pattern in excluded:
        bad = bad | F.col("href").rlike(pattern)
    kept = anchors.where(~bad).withColumn("link", absolute_url(F.col("url"), F.col("href")))
    last = F.regexp_extract("link", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:[^?#]*/)?([^/?#]*)", 1)
    name = F.when(F.contains(last, F.lit(".")) | (F.col("text") == ""), last).otherwise(F.substring("text", 1, 200))
    suffix = F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1)).isin(*DOCUMENT_SUFFIXES)
    marked = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains("link", m)) if markers else F.lit(False)
    return kept.select("page_id", "position", "link", name.alias("name"), guess_mime(name).alias("mime"), (suffix | marked).alias("is_document"), (guess_mime(name).isin(*ARCHIVE_TYPES) | F.lower("link").endswith(".zip")).alias("is_zip"))


def extract_label_values(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(page_id, html) -> (page_id, field, value) of ``<strong>LABEL:</strong> value`` blocks whose label is known."""
    pattern = r"(?s)<strong>([^<]*?):? *</strong>(.*?)(?=<strong>|</p>|</div>|$)"
    labels = F.create_map(*[F.lit(x) for f, names in fields.items() for n in names for x in (n, f)])
    pairs = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("value"))).alias("position", "x"))
    return pairs.select("page_id", "position", labels[F.lower(unescape(F.regexp_replace("x.label", ":$", "")))].alias("field"), unescape(F.col("x.value")).alias("value")).where("field IS NOT NULL")


def sniff(content: Column, path: Column) -> Column:
    """Kind of a file by its first bytes, else by its suffix."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", F.when(F.lower(path).endswith(".docx"), "docx").otherwise("zip")).when(head.startswith("89504E47"), "png").otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def scan_documents(spark, path: str) -> DataFrame:
    """Files below a path: path, content, checksum, kind, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("checksum"), sniff(F.col("content"), F.col("path")).alias("kind"), F.col("length").alias("size"))


#: Bytes of members that are handed on in one frame.
HELD = 4 << 20


def expand_archives(files: DataFrame, members: int = 200, total: int = 512 << 20, each: int = 256 << 20, ratio: int = 200, depth: int = 2) -> DataFrame:
    """(path, content) of ZIP files -> (path, member, content, depth, reject_reason).

    Members are named ``parent!/name``; archives inside are opened up to
    ``depth`` levels.  Unsafe names, links, large members and high ratios reject
    a member, unreadable or oversized archives reject the whole one.
    """

    def opened(path: str, blob: bytes, level: int) -> Iterator[tuple]:
        try:
            z = zipfile.ZipFile(io.BytesIO(blob))
            infos = z.infolist()
        except zipfile.BadZipFile:
            yield path, path, None, level, "bad_archive"
            return
        if len(infos) > members or sum(i.file_size for i in infos) > total:
            yield path, path, None, level, "archive_too_large"
            return
        for i in infos:
            if i.is_dir():
                continue
            name = f"{path}!/{i.filename}"
            unsafe = i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") or len(i.filename) > 255 or i.external_attr >> 28 == 0xA
            reason = "unsafe_member" if unsafe else "member_too_large" if i.file_size > each else "suspicious_ratio" if i.file_size > ratio * max(i.compress_size, 1) else None
            if reason:
                yield path, name, None, level, reason
                continue
            body = z.read(i)
            if body[:4] == b"PK\x03\x04" and level < depth and not i.filename.lower().endswith(".docx"):
                yield from opened(name, body, level + 1)
            else:
                yield path, name, body, level, None

    columns = ["path", "member", "content", "depth", "reject_reason"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for path, blob in zip(frame["path"], frame["content"]):
                for row in opened(path, bytes(blob), 1):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held >= HELD or len(rows) >= 1_000:  # bounds what is held beside one member
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, depth int, reject_reason string")


def reusable(work: DataFrame, artifacts: DataFrame, processor: str, config: str) -> DataFrame:
    """The work that no earlier extraction with the same processor and configuration has done; failures are never reused."""
    done = artifacts.where((F.col("status") == "extracted") & (F.col("processor_version") == processor) & (F.col("config_version") == config)).select("notice_id", "checksum")
    return work.join(done, ["notice_id", "checksum"], "left_anti")


def bundles(docs: DataFrame, by: str, *fields: str) -> DataFrame:
    """One canonical JSON text per notice, its documents by id."""
    return docs.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("bundle"))
