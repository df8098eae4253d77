"""URL expressions, by their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
CREDENTIALS = ("token", "key", "api_key", "apikey", "access_token", "signature", "password", "secret")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path; at least a slash, without slashes at the end."""
    p = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def query_pairs(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without fragment, tracking parameters and closing slashes; for identity, not for display."""
    name = lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1)))
    kept = F.array_join(F.transform(F.filter(query_pairs(url), lambda x: ~name(x).isin(*TRACKING)), lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("=")))), "&")
    whole = F.concat(scheme(url), F.lit("://"), authority(url), path(url), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(whole)


def derive_external_id(url: Column) -> Column:
    """Host, path and remaining query of the canonical URL, without slashes and question marks around."""
    return F.regexp_replace(F.regexp_replace(canonical_url(url), r"^[a-z][a-z0-9+.-]*://", ""), r"^[/?]+|[/?]+$", "")


def _resolved(segments: Column) -> Column:
    """A path from its segments: ``.`` goes, ``..`` takes the segment before with it, empty ones inside don't count."""
    inner = F.filter(segments, lambda x, k: (x != "") | (k == 0) | (k == F.size(segments) - 1))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x))
    out = F.aggregate(inner, F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(inner, -1).isin(".", ".."), F.array_append(out, "")).otherwise(out)
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(closed, "/")), "^/+", "/")


def absolute_url(base: Column, href: Column) -> Column:
    """The link resolved against its page, dot segments included; blank links stay blank.

    A link that is only a query keeps the page's path, one that is only a
    fragment the page's path and query.
    """
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    page = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*([?#].*)?$", 1)
    # the page's folder, with what the link adds
    beside = F.split(F.concat(F.regexp_extract(page, r"^(.*/)", 1), own), "/")
    relative = F.concat(F.when(F.substring(own, 1, 1) == "/", _resolved(F.split(own, "/"))).otherwise(_resolved(beside)), rest)
    return (
        F.when(F.trim(F.coalesce(href, F.lit(""))) == "", "")
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(origin, page, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, page, href))
        .otherwise(F.concat(origin, relative))
    )


def apply_query_params(url: Column, params: dict[str, str | bool | list[str] | None]) -> Column:
    """The URL with the parameters set: a key replaces all its occurrences, null removes it, a list repeats it; other pairs keep their order."""
    pairs = F.filter(query_pairs(url), lambda x: ~F.split_part(x, F.lit("="), F.lit(1)).isin(*params))
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    new = [f"{k}={text(v)}" for k, vs in params.items() if vs is not None for v in (vs if isinstance(vs, list) else [vs])]
    query = F.array_join(F.concat(pairs, F.array(*map(F.lit, new)) if new else F.array().cast("array<string>")), "&")
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)


def redact_url(url: Column) -> Column:
    """The URL without fragment and credential-like parameters, with user information masked."""
    kept = F.array_join(F.filter(query_pairs(url), lambda x: ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*CREDENTIALS)), "&")
    head = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"://[^/@]*@", "://***@")
    return F.concat(head, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


# Media types by suffix.
MEDIA = {"pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "zip": "application/zip", "html": "text/html", "txt": "text/plain", "csv": "text/csv", "png": "image/png"}


def guess_mime(name: Column) -> Column:
    """The media type of a file name's suffix, or that of bytes."""
    types = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(types[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def bare_media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def storage_name(name: Column) -> Column:
    """A safe file name: the last part, unsafe characters to underscores, no closing dots, device names prefixed, up to 200 characters, never empty."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    safe = F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1F<>:"|?*]', "_"), "[. ]+$", "")
    safe = F.when(F.lower(F.regexp_extract(safe, r"^([^.]*)", 1)).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("_"), safe)).otherwise(safe)
    return F.when(safe == "", "file").otherwise(F.substring(safe, 1, 200))


def storage_key(notice_id: Column, sha256: Column, name: Column) -> Column:
    """Where an attachment is kept: by notice, checksum and safe name."""
    return F.concat_ws("/", F.lit("tenders"), notice_id.cast("string"), F.lit("attachments"), sha256, storage_name(name))
