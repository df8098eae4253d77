"""Secret scans: known shapes, and the sliding-window entropy of candidate strings.

Everything is a DataFrame expression of one row; there is no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm import spans as S
from noticelake.llm.common import guarded, let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates for the entropy test, the longest runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Character classes: name, what the whole candidate must match, alphabet, window, least bits a character in some window.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 16, 3.01),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.71),
)
#: What the entropy test must not report: documented examples, digests of nothing, versions of "example", identifiers of one repeated character.
ALLOWED = r"(?i)example|placeholder|changeme|d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855|(.)\1{7}|0123456789|abcdefghij"

#: The same two for engines without groups of options or back references.
RE2_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RE2_ALLOWED = ALLOWED.replace(r"(.)\1{7}", "|".join(f"{c}{{8}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789/_=-") + r"|\+{8}")


def entropy(value: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits, of a window of ``window`` characters of the value, which has at least so many.

    The window slides by one character.  ``counts`` is a text whose k-th
    character, less ``@``, is the count of the alphabet's k-th; what leaves and
    what enters each change one of them, and the sum of ``c log2 c``.  So a step
    costs the same wherever it is in the value.
    """
    part = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    number = lambda counts, k: F.ascii(F.substring(counts, k + 1, F.lit(1))) - 64

    def moved(acc: Column, k: Column, by: int) -> Column:
        """The counts and their sum after character k came or went."""
        put = lambda c: F.struct(F.overlay(acc["counts"], F.char(64 + by + c), k + 1, F.lit(1)).alias("counts"), (acc["sum"] + F.get(part, c + by) - F.get(part, c)).alias("sum"))
        return let(number(acc["counts"], k), put)

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            left = F.when(i >= window, moved(acc, F.get(codes, i - window), -1)).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))
            bits = lambda s: F.when(i >= window - 1, F.greatest(acc["best"], math.log2(window) - s["sum"] / window)).otherwise(acc["best"])
            return let(left, lambda a: let(moved(a, F.get(codes, i), 1), lambda b: F.struct(b["counts"].alias("counts"), b["sum"].alias("sum"), bits(b).alias("best"))))

        zero = F.struct(F.lit("@" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), zero, step, lambda acc: acc["best"])

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), slide)


def _secret(value: Column) -> Column:
    """Whether a candidate mixes letters and digits, is not allowed, and has a window of high entropy for its class."""
    of_class = F.lit(False)
    for _, whole, alphabet, window, bits in reversed(CLASSES):
        of_class = F.when(value.rlike(whole), entropy(value, alphabet, window) >= bits).otherwise(of_class)
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(ALLOWED), of_class).otherwise(F.lit(False))


def scan(df: DataFrame) -> DataFrame:
    """Appends ``base_spans`` and ``spans`` (arrays of kind, start, end, value, in the order of start and kind).

    ``base_spans`` holds assignments with a value of 12 or more characters,
    access keys and hexadecimal runs; ``spans`` also the candidates whose
    entropy is high and which overlap none of those.  Null texts count as empty
    and have no spans.  The work grows with a text's length and its matches.  Rows are independent, so ties, repeated rows and empty
    tables need no rule; columns of the input with these names are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = F.regexp_extract
    out = df
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        out = out.withColumn(f"__{kind}", S.matches(text, pattern, kind))
    assign = F.filter("__assign", lambda s: F.length(value(s["value"], ASSIGN, 2)) >= 12)
    out = out.withColumn("base_spans", S.in_order(F.concat(assign, "__access", "__hex"), KINDS))
    out = out.withColumn("__entropy", S.apart(F.col("__entropy"), F.col("base_spans")))
    out = out.withColumn("__entropy", F.filter("__entropy", lambda s: _secret(s["value"])))
    return out.withColumn("spans", S.in_order(F.concat("base_spans", "__entropy"), KINDS)).drop("__assign", "__access", "__hex", "__entropy")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found secret in ``text`` replaced by the mark; null texts stay null."""
    rows, back = guarded(df, "text")
    return back(scan(rows).withColumn("text", S.redacted(F.col("text").cast("string"), F.col("spans"), mark)))
