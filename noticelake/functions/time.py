"""Time expressions; the session's zone is UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import let


# Month names of mail dates, and the zones that they name with their offsets in minutes.
MAIL_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MAIL_ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}


def _map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def parse_mail_date(c: Column) -> Column:
    """RFC 2822 dates: an optional weekday, day, month name, year of four or two digits, a clock with or without seconds, and a zone as offset or name.

    Without a zone, or with a name that the standard doesn't have, the clock is
    UTC's.  Two digits of a year mean 1969 to 2068.
    """
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s,]+"), lambda w: w != "")
    bare = let(words, lambda ws: F.when(F.get(ws, 0).rlike("^[a-z]+$"), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))).otherwise(ws))

    def read(ws: Column) -> Column:
        clock, zone, year = F.split(F.get(ws, 3), ":"), F.coalesce(F.get(ws, 4), F.lit("")), F.get(ws, 2).try_cast("int")
        month = F.array_position(F.array(*map(F.lit, MAIL_MONTHS)), F.substring(F.get(ws, 1), 1, 3)).cast("int")
        full = F.when(F.length(F.get(ws, 2)) == 2, year + F.when(year < 69, 2000).otherwise(1900)).when(F.length(F.get(ws, 2)) == 4, year)
        part = lambda k: F.when(F.get(clock, k).rlike("^[0-9]{1,2}$"), F.get(clock, k).try_cast("int"))
        second = F.when(F.size(clock) < 3, 0).otherwise(part(2))
        local = F.when(F.get(ws, 1).rlike("^[a-z]{3,9}$") & (month > 0), F.try_make_timestamp(full, month, F.get(ws, 0).try_cast("int"), part(0), part(1), second))
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        offset = F.when(zone.rlike("^[+-][0-9]{4}$"), sign * (60 * F.substring(zone, 2, 2).try_cast("int") + F.substring(zone, 4, 2).try_cast("int"))).otherwise(F.coalesce(_map(MAIL_ZONES)[zone], F.lit(0)))
        return F.timestamp_seconds(F.unix_timestamp(local) - 60 * offset)

    return let(bare, read)


def parse_timestamp(c: Column) -> Column:
    """ISO 8601 with or without an offset (none means UTC), RFC 2822, or epoch seconds, milliseconds beyond 1e11; otherwise null."""
    t = F.trim(c)
    number = F.when(t.rlike(r"^-?[0-9]+([.][0-9]+)?$"), t.try_cast("double"))
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), t.try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), iso, parse_mail_date(t))


def business_days_until(now: Column, target: Column) -> Column:
    """Weekdays after today up to the target's date; -1 when the target has passed."""
    a, b = F.to_date(now), F.to_date(target)
    # whole weeks hold five; the rest is counted day by day
    rest = F.datediff(b, a) % 7
    odd = sum((F.when((F.lit(k) <= rest) & (F.weekday(F.date_add(a, k)) < 5), 1).otherwise(0) for k in range(1, 7)), F.lit(0))
    return F.when(target < now, -1).otherwise(5 * F.floor(F.datediff(b, a) / 7) + odd).cast("int")


def is_urgent(deadline: Column, status: Column, now: Column, window: int = 5) -> Column:
    return F.coalesce((status == "RESOLVED") & business_days_until(now, deadline).between(0, window), F.lit(False))


# Month names of three languages, and zones of deadline texts with their offsets in minutes.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
ZONES = {"GMT": 0, "UTC": 0, "WAT": 60, "CET": 60, "CEST": 120, "EAT": 180}
_ISO = r"([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2})(?::[0-9]{2})? ?(UTC|GMT|Z)"
_WORDS = r"([0-9]{1,2})(?: de)? ([A-Za-zéûçÉ]+)(?: de)?,? ([0-9]{4})(?: at| à| às)? ([0-9]{1,2})(?:[:.h]| h )([0-9]{2}) ?([ap]m)? ?([A-Z]{3,4})?"


def parse_absolute_deadline(c: Column) -> Column:
    """The instant of a written deadline with a known zone; without one there is no instant.

    Zone names are exact, month names may be in English, French or Portuguese.
    """
    months, zones = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (MONTHS, ZONES))
    g = lambda p, k: F.regexp_extract(c, p, k)
    number = lambda p, k: F.nullif(g(p, k), F.lit("")).try_cast("int")
    iso = F.try_make_timestamp(number(_ISO, 1), number(_ISO, 2), number(_ISO, 3), number(_ISO, 4), number(_ISO, 5), F.lit(0))
    half = F.lower(g(_WORDS, 6))
    hour = F.when(half == "pm", number(_WORDS, 4) % 12 + 12).when(half == "am", number(_WORDS, 4) % 12).otherwise(number(_WORDS, 4))
    local = F.try_make_timestamp(number(_WORDS, 3), months[F.lower(g(_WORDS, 2))], number(_WORDS, 1), hour, number(_WORDS, 5), F.lit(0))
    return F.coalesce(iso, F.timestamp_seconds(F.unix_timestamp(local) - 60 * zones[g(_WORDS, 7)]))


def read_tokens(c: Column, kind: Callable[[Column], Column], use: Callable[[Column, Column, Column], Column]) -> Column:
    """Reads a text by its tokens: numbers with their dots, words, other marks, and white space between them.

    ``kind`` gives each lower-cased token but white space one letter; ``use``
    gets these letters as one text, where a grammar is a short expression whose
    place is a token's, the tokens (text, at), and all tokens with the white
    space, of which ``at`` counts.
    """
    every = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\s+|[0-9.]*[0-9][0-9.]*|\p{L}+|[^\s]"), F.lit(0))

    def told(all_tokens: Column) -> Column:
        words = F.filter(F.transform(all_tokens, lambda t, k: F.struct(F.lower(t).alias("text"), k.alias("at"))), lambda w: w["text"].rlike(r"\S"))
        return let(words, lambda ws: let(F.array_join(F.transform(ws, lambda w: kind(w["text"])), ""), lambda letters: use(letters, ws, all_tokens)))

    return let(every, told)


# Words of remaining durations, and of hints that state no number.
DAYS, HOURS, KINDS_OF_DAY, LEFT = ("day", "days"), ("hour", "hours", "hr", "hrs"), ("calendar", "business"), ("left", "remaining")
CLOSING, NEAR = ("closing", "close", "closes"), ("soon", "imminent")
MOST_DAYS, MOST_HOURS = 3650, 8760


def _duration_kind(w: Column) -> Column:
    """N a number of up to three digits, M of four, d and h units, b a kind of day, l what says that it is left, t and g of "to go", and the words of hints."""
    words = {"t": ("to",), "g": ("go",), "d": DAYS, "h": HOURS, "b": KINDS_OF_DAY, "l": LEFT, "c": CLOSING, "s": NEAR[:1], "i": NEAR[1:], "D": ("deadline",), "L": ("last",), "A": ("date",)}
    out = F.when(w.rlike("^[0-9]{1,3}$"), "N").when(w.rlike("^[0-9]{4}$"), "M")
    for letter, of in words.items():
        out = out.when(w.isin(*of), letter)
    return out.otherwise("x")


def relative_deadline(c: Column, observed: Column) -> Column:
    """(deadline, raw): the moment of observation plus the days (up to 3650) or hours (up to 8760) that the text leaves, with the text that says so; a hint without a number gives its text only."""

    def use(letters: Column, ws: Column, every: Column) -> Column:
        def found(grammar: str) -> tuple[Column, Column]:
            """The number that a phrase begins with, and the phrase as written; null where there is none."""
            at, n = F.regexp_instr(letters, F.lit(grammar)), F.length(F.regexp_extract(letters, grammar, 0))
            first, last = F.get(ws, at - 1), F.get(ws, at + n - 2)
            written = F.array_join(F.slice(every, first["at"] + 1, last["at"] - first["at"] + 1), "")
            return F.when(at > 0, first["text"].try_cast("long")), F.when(at > 0, written)

        (days, in_days), (hours, in_hours), (_, hint) = found("[NM]b?d(l|tg)"), found("Nhl"), found("cs|D[si]|LA[si]")
        seconds = F.when(days <= MOST_DAYS, days * 86400).when(hours <= MOST_HOURS, hours * 3600)
        raw = F.when(days <= MOST_DAYS, in_days).when(hours <= MOST_HOURS, in_hours).otherwise(hint)
        return F.struct(F.timestamp_seconds(F.unix_timestamp(observed) + seconds).alias("deadline"), raw.alias("raw"))

    return read_tokens(c, _duration_kind, use)


# What stands between a written date and its clock, and half days.
CONNECTORS, HALF_DAYS = ("at", "à", "le", "a", "as", "às", "em"), ("am", "pm")


def _date_kind(w: Column) -> Column:
    """n a number of up to two digits, y of four, Y of four at the end of a sentence, k a clock with a dot, h, colon and half days of clocks, m a month, z a known zone, c what may stand before a clock, w another word."""
    out = F.when(w.rlike("^[0-9]{1,2}$"), "n").when(w.rlike("^[0-9]{4}$"), "y").when(w.rlike("^[0-9]{4}[.]$"), "Y").when(w.rlike(r"^[0-9]{1,2}[.][0-9]{2}$"), "k").when(w == "h", "h").when(w == ":", ":")
    out = out.when(w.isin(*HALF_DAYS), "p").when(w.isin(*MONTHS), "m").when(w.isin(*[z.lower() for z in ZONES]), "z").when(w.isin(*CONNECTORS), "c")
    return out.when(w.rlike(r"^\p{L}+$"), "w").otherwise("x")


def written_deadline(c: Column) -> Column:
    """The instant of the first written date (day, month name, year) that a known zone follows, with or without a clock between; without a zone there is none, and a word in the month's place ends the search."""
    whole = F.regexp_replace(c, r"(?i)\b([ap])\.\s?m\b\.?", "$1m")

    def use(letters: Column, ws: Column, every: Column) -> Column:
        at = F.regexp_instr(letters, F.lit("n[mwczhp][yY]"))
        rest = F.substring(letters, at, F.length(letters))
        clock = F.regexp_extract(rest, "^nmy(c(?:n[:h]n|k)p?)?z", 1)
        read = F.regexp_extract(rest, "^nmy(?:c(?:n[:h]n|k)p?)?z", 0)
        word = lambda k: F.get(ws, at + k - 1)["text"]
        number = lambda k: word(k).try_cast("int")
        dotted = F.split(word(4), "[.]")
        hour = F.when(clock == "", 0).when(F.contains(clock, F.lit("k")), F.get(dotted, 0).try_cast("int")).otherwise(number(4))
        minute = F.when(clock == "", 0).when(F.contains(clock, F.lit("k")), F.get(dotted, 1).try_cast("int")).otherwise(number(6))
        half = F.when(F.endswith(clock, F.lit("p")), word(F.length(clock) + 2))
        hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
        zone = word(F.length(read) - 1)
        local = F.when((at > 0) & (read != ""), F.try_make_timestamp(number(2), _map(MONTHS)[word(1)], number(0), hour, minute, F.lit(0)))
        return F.timestamp_seconds(F.unix_timestamp(local) - 60 * _map({k.lower(): v for k, v in ZONES.items()})[zone])

    return read_tokens(whole, _date_kind, use)


def parse_relative_deadline(c: Column, observed: Column) -> Column:
    """The instant of ``relative_deadline``."""
    return relative_deadline(c, observed)["deadline"]


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 30.0, retry_after: Column | None = None) -> Column:
    """Exponential backoff up to a bound; a server's Retry-After raises it."""
    delay = F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(30))))
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after, F.lit(0.0)))


def outbox_backoff(attempt: Column) -> Column:
    """0 first, then 30 s doubling up to an hour."""
    return F.when(attempt <= 1, 0).otherwise(F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(attempt - 2, F.lit(10))))).cast("int")


def http_class(status: Column) -> Column:
    """Class of a status: ok, rate_limited, server_error, permanent, or other."""
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.isin(408, 425) | (status >= 500), "retryable").when(status.between(400, 499), "permanent").otherwise("other")


def transport_class(code: Column) -> Column:
    """Class of a failed connection: what never reached the server may be tried again, what broke after sending may have arrived."""
    return F.when(code.isin("dns", "connect", "refused", "tls"), "unsent").when(code.isin("read_timeout", "reset", "broken"), "ambiguous").otherwise("other")


def retry_policy(status: Column, code: Column) -> Column:
    """(class, retryable, possible_duplicate) of an attempt's HTTP status, or of its transport code where there is no status."""
    kind = F.when(status.isNotNull(), http_class(status)).otherwise(transport_class(code))
    again = kind.isin("rate_limited", "retryable", "unsent", "ambiguous")
    return F.struct(kind.alias("class"), again.alias("retryable"), (kind == "ambiguous").alias("possible_duplicate"))
