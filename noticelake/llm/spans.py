"""Where regular expressions match, with DataFrame functions only.

A match's place follows from the pieces between the matches: the k-th match
starts after the first k pieces and the k - 1 matches before it.  Running
totals and cuts go by blocks, so that the work grows with the length of a text
and the number of its matches, and with no product of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.llm.common import let

SPAN = "struct<kind: string, start: int, end: int, value: string>"
#: Items that a running total appends one by one, and code points of a block of text.
ITEMS, POINTS = 256, 1024
_FAR = (1 << 31) - 1


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(kind: str, start: Column, end: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running results of an associative operation over an array of integers.

    Up to ``ITEMS`` results are appended to an array one by one; longer arrays
    go by blocks of so many, and then the results of whole blocks likewise.
    """

    def short(v: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(v, start, lambda acc, x: F.array_append(acc, op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(zero)), x).cast("int")))

    def blocked(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / ITEMS).cast("int"))
        parts = F.transform(numbers, lambda b: short(F.slice(v, b * ITEMS + 1, F.lit(ITEMS))))
        after = lambda t, k, x: op(F.get(t, k - 1), x).cast("int")
        whole = lambda bs, t: F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: after(t, k, x)))))
        return let(parts, lambda bs: let(short(F.transform(bs, lambda b: F.get(b, F.size(b) - 1))), lambda t: whole(bs, t)))

    return let(values, lambda v: F.when(F.size(v) <= ITEMS, short(v)).otherwise(blocked(v)))


def matches(text: Column, pattern: str, kind: str, gate: str | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern that matches no empty string, as spans in code points, end exclusive.

    ``gate`` is a cheaper expression without which there is no match.
    """
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(v: Column, p: Column) -> Column:
        ends = running(F.transform(v, lambda x, i: F.length(F.get(p, i)) + F.length(x)), lambda a, b: a + b, 0)
        return let(ends, lambda e: F.transform(v, lambda x, i: span(kind, F.get(e, i) - F.length(x), F.get(e, i), x)))

    hit = text.rlike(pattern)
    return F.when((text.rlike(gate) & hit) if gate else hit, let(values, lambda v: let(pieces, lambda p: placed(v, p)))).otherwise(none())


def in_order(spans: Column, kinds: Sequence[str], by_kind: bool = False) -> Column:
    """Spans by start and then kind as listed, or by kind and then start."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(*([rank[s["kind"]].alias("a"), s["start"].alias("b")] if by_kind else [s["start"].alias("a"), rank[s["kind"]].alias("b")]), s["end"].alias("c"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.

    In the common order of starts a span must not start before the farthest end
    of the others so far, nor end after the next other's start.
    """
    item = lambda s, mine, i: F.struct(s["start"].alias("at"), F.lit(mine).alias("mine"), s["end"].alias("end"), i.alias("i"))
    both = F.array_sort(F.concat(F.transform(others, lambda s: item(s, 0, F.lit(0))), F.transform(spans, lambda s, i: item(s, 1, i))))

    def kept(x: Column) -> Column:
        reach = running(F.transform(x, lambda s: F.when(s["mine"] == 0, s["end"]).otherwise(0)), F.greatest, 0)
        after = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["mine"] == 0, s["at"]).otherwise(_FAR))), F.least, _FAR))
        free = lambda s, k, r, n: (s["mine"] == 1) & (F.get(r, k) <= s["at"]) & (F.get(n, k) >= s["end"])
        return let(reach, lambda r: let(after, lambda n: F.transform(F.filter(x, lambda s, k: free(s, k, r, n)), lambda s: s["i"])))

    return let(spans, lambda own: F.when((F.size(own) == 0) | (F.size(others) == 0), own).otherwise(F.transform(let(both, kept), lambda i: F.get(own, i))))


def blocks(text: Column) -> Column:
    """The text in pieces of ``POINTS`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{POINTS}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end, exclusive, of a text in blocks; empty where end isn't beyond start."""
    first, last = F.floor(start / POINTS).cast("int"), F.floor((end - 1) / POINTS).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start % POINTS + 1, end - start)).otherwise("")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, overlapping ones together, replaced by the mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def joined(s: Column, reach: Column, pieces: Column) -> Column:
        before = lambda k: F.when(k == 0, 0).otherwise(F.get(reach, k - 1))
        parts = F.transform(s, lambda x, k: F.when(x["start"] >= before(k), F.concat(cut(pieces, before(k), x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(pieces, F.get(reach, F.size(s) - 1), F.length(text)))

    whole = let(ordered, lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest, 0), lambda r: let(blocks(text), lambda p: joined(s, r, p))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
