"""Text expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space, and the tags' separators.
WHITE = r"[\t-\r \x{85}\x{A0}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that each row computes once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_text(c: Column) -> Column:
    """Null to the empty string, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " "))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for white space; null is empty."""
    return clean_text(a) == clean_text(b)


def same_instant(a: Column, b: Column) -> Column:
    """Whether two times are one instant, both unknown included; times without a zone are UTC, as the session's zone is."""
    return a.cast("timestamp").eqNullSafe(b.cast("timestamp"))


def normalize_language(tag: Column) -> Column:
    """The lower-cased primary subtag; blank tags give null."""
    primary = F.lower(F.trim(F.split_part(F.replace(tag, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))))
    return F.when(primary != "", primary)


# Hints of the two languages, and the accents that hint at French.
FRENCH_HINTS = (" le ", " la ", " les ", " des ", " pour ", " avec ")
PORTUGUESE_HINTS = (" o ", " os ", " para ", " com ", " uma ", " não ")
FRENCH_ACCENTS = "[éèêàçù]"


def hint_language(c: Column) -> Column:
    """``fr`` or ``pt`` by the hint words found, French accents as a fallback, else ``en``."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    hits = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    fr, pt = hits(FRENCH_HINTS), hits(PORTUGUESE_HINTS)
    return F.when((fr > pt) & (fr >= 2), "fr").when((pt > fr) & (pt >= 2), "pt").when(text.rlike(FRENCH_ACCENTS), "fr").otherwise("en")


def estimate_tokens(c: Column) -> Column:
    """The larger of a third of the characters, and characters beyond ASCII plus a third of the others; both rounded up."""
    n = F.length(F.coalesce(c, F.lit("")))
    ascii_ = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", ""))
    return F.greatest(F.ceil(n / 3), n - ascii_ + F.ceil(ascii_ / 3)).cast("long")


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\t-\r ]+")).cast("long")


# Typographic quotes, dashes and spaces with their plain forms.
TYPOGRAPHIC, PLAIN = "‘’‚‛“”„‟‐‑‒–—― \n\r\t", "''''\"\"\"\"------    "


@F.pandas_udf(StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_quote(c: Column, nfkc: bool = False) -> Column:
    """Curly quotes and dashes to ASCII, line breaks and tabs to spaces, runs of spaces to one, trimmed.

    With ``nfkc`` compatibility forms are folded first, by Python and only for
    texts beyond ASCII; without it the expression stays in the JVM.
    """
    text = F.coalesce(c, F.lit(""))
    if nfkc:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.trim(F.regexp_replace(F.translate(text, TYPOGRAPHIC, PLAIN), " +", " "))


def _unaccented() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one base letter with marks, and those base letters."""
    pairs = []
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))
        if plain != chr(k) and len(plain) == 1:
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _unaccented()


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks, lower-cased; combining marks go."""
    return F.lower(F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), r"[\x{300}-\x{36F}]", ""))


def fold_tokens(c: Column) -> Column:
    """The distinct words of letters of a text, without accents."""
    return F.array_distinct(F.regexp_extract_all(fold_accents(c), F.lit(r"[\p{L}]+"), F.lit(0)))


# Units of advertised sizes in bytes.
UNITS = {"b": 1, "o": 1, "kb": 1024, "ko": 1024, "mb": 1024**2, "mo": 1024**2, "gb": 1024**3, "go": 1024**3}


def advertised_size(c: Column) -> Column:
    """Bytes of a stated size such as ``1,2 MB`` or ``300 Ko``; null where there is none."""
    pattern = r"(?i)([0-9]+(?:[.,][0-9]+)?) ?(kb|ko|mb|mo|gb|go|b|o)(?:[^a-z]|$)"
    number = F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return (number * units[F.lower(F.regexp_extract(c, pattern, 2))]).cast("long")


# What stands for no content.
PLACEHOLDERS = ("", "-", "--", "n/a", "N/A", "none", "null", "...")


def is_placeholder(c: Column) -> Column:
    """Blank, one of ``PLACEHOLDERS`` as written, or a template's ``<...>``."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return t.isin(*PLACEHOLDERS) | (t.startswith("<") & t.endswith(">"))


def is_valid_email(c: Column) -> Column:
    """A conservative single address: one @, local part up to 64, domain with a dot and labels up to 63, ASCII only."""
    shape = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})+$"
    return F.coalesce(c.rlike(shape) & (F.length(c) <= 255) & (F.length(F.split_part(c, F.lit("@"), F.lit(2))) <= 253), F.lit(False))


# Names of secrets; hyphens and letter case don't matter.
SECRET_KEYS = ("api_key", "apikey", "password", "passwd", "secret", "token", "authorization", "auth", "credential", "credentials", "private_key", "access_token", "refresh_token")
REDACTED = "[REDACTED]"
_NAMES = "(?:" + "|".join(k.replace("_", "[-_]") for k in SECRET_KEYS) + ")"


def is_secret_key(key: Column) -> Column:
    """Whether a name is a secret's, ends with ``_`` and one, or begins with one and ``_``."""
    return F.coalesce(key.rlike(rf"(?i)^(?:(?:.*[-_])?{_NAMES}|{_NAMES}[-_].*)$"), F.lit(False))


def redact_text(c: Column) -> Column:
    """The values of ``key=value`` and ``key: value`` with secrets' names, masked; a quoted value goes to its closing quote, a bare one to the next white space."""
    value = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^ \t\n\r]+)"""
    return F.regexp_replace(c, rf"(?i)\b({_NAMES})([ ]*[=:][ ]*){value}", f"$1$2{REDACTED}")


_STRING = r'"(?:[^"\\]|\\.)*+"'
_KEY = rf'(?i)"(?:(?:[^"\\]*[-_])?{_NAMES}|{_NAMES}[-_][^"\\]*)"\s*:'
_FIRST = rf'^\s*({_STRING}|[^\s,]+)'


def redact_fields(fields: Column) -> Column:
    """A JSON text with the values of secrets' keys masked, at any depth and whole: scalars, arrays and objects.

    The text is walked by its tokens: secrets' keys, brackets, and runs of all
    else.  After such a key a bracket opens what goes, and a counter of open
    brackets finds its end; the walk holds the counter and the places to cut, so
    it is linear in the text.  Texts without such a key stay as they are.
    """
    tokens = F.regexp_extract_all(fields, F.lit(rf'{_KEY}|[{{\[]|[}}\]]|(?:(?!{_KEY})(?:{_STRING}|[^"{{}}\[\]]|"))+'), F.lit(0))
    place = "array<struct<begin: int, end: int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(False).alias("armed"), F.lit(0).alias("begin"), F.array().cast(place).alias("cuts"))

    def step(acc: Column, t: Column) -> Column:
        n, head = F.length(t), F.substring(t, 1, 1)
        opens, closes, key = head.isin("{", "["), head.isin("}", "]"), t.rlike(rf"^{_KEY}$")
        depth = acc["open"] + opens.cast("int") - closes.cast("int")
        inside, masks = acc["open"] > 0, acc["armed"] & (acc["open"] == 0)
        scalar = F.regexp_extract(t, _FIRST, 1)
        lead = F.length(F.regexp_extract(t, r"^\s*", 0))
        cut = F.when(inside & (depth == 0), F.struct(acc["begin"].alias("begin"), (acc["at"] + n).alias("end"))).when(masks & ~opens & ~closes & ~key & (scalar != ""), F.struct((acc["at"] + lead).alias("begin"), (acc["at"] + lead + F.length(scalar)).alias("end")))
        return F.struct(
            (acc["at"] + n).alias("at"), F.when(inside, depth).when(masks & opens, 1).otherwise(0).alias("open"),
            # white space between a key and its bracket leaves the key in force
            F.when(inside, False).when(key, True).otherwise(masks & t.rlike(r"^\s*$")).alias("armed"),
            F.when(masks & opens, acc["at"]).otherwise(acc["begin"]).alias("begin"), F.when(cut.isNotNull(), F.array_append(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"),
        )

    def masked(acc: Column) -> Column:
        # what a missing bracket leaves open goes up to the end
        cuts = F.when(acc["open"] > 0, F.array_append(acc["cuts"], F.struct(acc["begin"].alias("begin"), acc["at"].alias("end")))).otherwise(acc["cuts"])
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("from"))
        join = lambda out, x: F.struct(F.concat(out["out"], F.substring(fields, out["from"] + 1, x["begin"] - out["from"]), F.lit(f'"{REDACTED}"')).alias("out"), x["end"].alias("from"))
        return F.aggregate(cuts, begin, join, lambda out: F.concat(out["out"], F.substring(fields, out["from"] + 1, F.length(fields))))

    return F.when(fields.rlike(_KEY), F.aggregate(tokens, start, step, masked)).otherwise(fields)


def content_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON in the order of their names; leave out times and versions."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def checksum(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def encoded_bytes(size: Column) -> Column:
    """Bytes of a Base64 attachment."""
    return (4 * F.ceil(size / 3)).cast("long")
