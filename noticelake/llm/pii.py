"""Personal data: expressions propose spans, checksums confirm them, context words move their score.

Everything is a DataFrame expression of one row; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm import spans as S
from noticelake.llm.common import let

# A run that began before would have matched from there, so a match starts where
# its run does or where the last match ended; that spares one try per character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of account numbers with the countries that have them (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A country's letters tell where its number ends, so that words after it don't matter; a look at the first four characters spares most places a try of each country.
IBAN = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")"
KINDS = ("email", "ip", "card", "phone", "iban")

#: A span's score: what its expression is worth, what a checksum adds, and what a context word nearby adds or a doubtful one takes.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4}
CHECKED, NEARBY, DOUBTED = 0.4, 0.2, -0.3
WINDOW = 40
CONTEXT = {
    "email": r"(?i)(?:^|[^a-z0-9])(?:e-?mail|contact|write|mailto)(?:[^a-z0-9]|$)",
    "ip": r"(?i)(?:^|[^a-z0-9])(?:ip|address|host|server|client|login)(?:[^a-z0-9]|$)",
    "card": r"(?i)(?:^|[^a-z0-9])(?:card|visa|mastercard|amex|credit|debit|payment)(?:[^a-z0-9]|$)",
    "phone": r"(?i)(?:^|[^a-z0-9])(?:phone|tel|call|mobile|fax|contact)(?:[^a-z0-9]|$)",
    "iban": r"(?i)(?:^|[^a-z0-9])(?:iban|account|bank|transfer)(?:[^a-z0-9]|$)",
}
DOUBT = r"(?i)(?:^|[^a-z0-9])(?:version|example|sample|build|isbn)(?:[^a-z0-9]|$)"
#: Added spans below this score are left out; base spans always stay.
LEAST = 0.6


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test."""
    ds = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(ds, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97: the first four characters go to the end, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (F.when(number(c) > 9, acc * 100).otherwise(acc * 10) + number(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _octets(value: Column) -> Column:
    """Whether all four parts are at most 255; leading zeros don't count."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def scan(df: DataFrame) -> DataFrame:
    """Appends ``base_spans`` and ``spans`` (arrays of kind, start, end, value, by kind and start), and ``scores`` of the latter.

    ``base_spans`` holds mail and IP addresses, card numbers that pass Luhn and
    phone numbers; ``spans`` also account numbers of their country's length that pass mod 97 and
    aren't the beginning of a longer word, if context leaves them a score of ``LEAST``.  ``scores`` has one number between 0 and 1
    for each of ``spans``.  The work grows with a text's length and its matches.  Null texts count as empty and have no
    spans.  Rows are independent, so ties, repeated rows and empty tables need
    no rule; columns of the input with these names are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = lambda s: F.length(digits(s["value"]))
    confirmed = {
        "email": lambda s: F.lit(True), "ip": lambda s: _octets(s["value"]), "card": lambda s: length(s).between(13, 19) & luhn(s["value"]), "phone": lambda s: length(s).between(9, 15), "iban": lambda s: mod97(s["value"]) & ~text.substr(s["end"] + 1, F.lit(1)).rlike("[A-Z0-9]"),
    }
    out = df
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN)):
        out = out.withColumn(f"__{kind}", S.matches(text, pattern, kind, gate="@" if kind == "email" else None)).withColumn(f"__{kind}", F.filter(f"__{kind}", confirmed[kind]))
    out = out.withColumn("base_spans", S.in_order(F.concat("__email", "__ip", "__card", "__phone"), KINDS, by_kind=True))
    out = out.withColumn("__iban", S.apart(F.col("__iban"), F.col("base_spans")))
    out = out.withColumn("spans", F.concat("base_spans", "__iban"))
    score = let(S.blocks(text), lambda pieces: F.transform("spans", lambda s: F.struct(s.alias("span"), _score(pieces, s).alias("score"))))
    out = out.withColumn("scores", F.when(F.size("spans") > 0, score).otherwise(F.array().cast(f"array<struct<span: {S.SPAN}, score: double>>")))
    out = out.withColumn("scores", F.filter("scores", lambda x: (x["span"]["kind"] != "iban") | (x["score"] >= LEAST)))
    return out.withColumn("spans", F.transform("scores", lambda x: x["span"])).withColumn("scores", F.transform("scores", lambda x: x["score"])).drop(*[f"__{k}" for k in KINDS])


def _score(pieces: Column, s: Column) -> Column:
    """What the kind is worth, with what its checksum and the words within ``WINDOW`` code points before and after add or take."""
    near = F.concat_ws(" ", S.cut(pieces, F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"]), S.cut(pieces, s["end"], s["end"] + WINDOW))

    def total(words: Column) -> Column:
        score = F.lit(0.0)
        for k in KINDS:
            score = F.when(s["kind"] == k, BASE_SCORE[k] + (CHECKED if k in ("card", "iban") else 0.0) + F.when(words.rlike(CONTEXT[k]), NEARBY).otherwise(0.0)).otherwise(score)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + F.when(words.rlike(DOUBT), DOUBTED).otherwise(0.0)))

    return let(near, total)
