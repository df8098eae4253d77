"""Licence scans by a positional index of rare words.

A template is a licence's wording with the key phrases that a text must hold.
A word's IDF counts all documents that hold it as a word.  Each text looks up
the templates' words that are rarest among those it holds.  A looked-up word at
place i that stands at k in a template proposes the start i - k; proposals that
the text's other looked-up words bear out at their own relative places are
checked for the mandatory phrases.

Short wordings must stand word for word.  In whole licence texts names and
years move the words, so places may differ by the template's ``slack``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import let, lower_ascii
from noticelake.llm.license_texts import TEXTS


class Template(NamedTuple):
    label: str
    words: str
    #: The phrases that must stand, in the order of their places in the wording.
    keys: tuple[str, ...]
    #: By how many words their distance to the first phrase may differ.
    slack: int = 0


#: The phrases whose places count; the whole phrase is its key.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",)),
    Template("apache-2", "apache license version 2", ("apache license version 2",)),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
)
#: Notices of further licences, and whole texts with room for names.
MORE = (
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-4", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
    *(Template(label, words, keys, 24) for label, (words, keys) in TEXTS.items()),
)
#: Words that a text looks up at most, the rarest first; the rarest word of each template's keys is looked up beside them.
LOOKED_UP = 16
#: Licence words of a lower IDF are looked up only as the rarest of a template's keys: those in more than an eighth of the documents.
LEAST_IDF = math.log(8)


def words(text: Column) -> Column:
    """Words of digits, a-z after lower-casing A-Z, and characters beyond ASCII."""
    parts = F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def places(t: Template) -> list[int]:
    """Where in its wording the key phrases of a template stand."""
    ws, out = t.words.split(), []
    for key in t.keys:
        k, at = key.split(), out[-1] + 1 if out else 0
        out.append(next(i for i in range(at, len(ws)) if ws[i : i + len(k)] == k))
    return out


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF over all documents of the templates' words, which bound what reaches the driver."""
    known = sorted({w for t in templates for w in t.words.split()})
    held = docs.select(F.array_intersect(F.array(*map(F.lit, known)), words(F.col("text"))).alias("ws"))
    counts = held.select(F.explode_outer("ws").alias("w"), F.when(F.col("ws").isNotNull(), 1).alias("row")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n, found = docs.count(), {r.w: r.n for r in counts.where("w is not null").collect()}  # a row per word of the templates
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in known}


def _rarest(t: Template, idf: dict[str, float]) -> str:
    return max({w for key in t.keys for w in key.split()}, key=lambda w: (idf[w], w))


def _same(ws: Column, at: Column, phrase: list[str]) -> Column:
    return (at >= 0) & (F.slice(ws, F.greatest(at, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def _starts(t: Template, idf: dict[str, float], hits: Column, looked: Column, ws: Column) -> Column:
    """Sorted places of the first key phrase where the template's other phrases stand too.

    The starts that the rarest key word proposes are intersected with the
    postings of all looked-up key words, each at its relative place; what is
    left is checked for the phrases.  A text with the phrases has their words,
    so the intersection loses none.
    """
    at, keys = places(t), [k.split() for k in t.keys]
    offsets: dict[str, list[int]] = {}
    for a, key in zip(at, keys):
        for k, w in enumerate(key):
            offsets.setdefault(w, []).append(a + k)
    rarest = _rarest(t, idf)
    posting = F.create_map(*[x for w, ks in offsets.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))])
    proposed = F.flatten(F.transform(F.filter(hits, lambda h: h["w"] == rarest), lambda h: F.transform(posting[rarest], lambda k: h["i"] - k)))

    def borne_out(s: Column, w: Column) -> Column:
        """Whether w stands at one of its places from s, or within the slack of both phrases."""
        low = lambda k: F.greatest(s + k - 2 * t.slack, F.lit(0))
        return F.exists(posting[w], lambda k: F.array_contains(F.slice(ws, low(k) + 1, F.greatest(s + k + 2 * t.slack - low(k) + 1, F.lit(0))), w))

    def first_phrase(s: Column) -> Column:
        """Where within the slack of a start the first phrase stands."""
        return F.filter(F.transform(F.sequence(F.lit(-t.slack), F.lit(t.slack)), lambda d: s + at[0] + d), lambda p: _same(ws, p, keys[0]))

    def stands(p: Column, a: int, key: list[str]) -> Column:
        return F.exists(F.sequence(F.lit(a - at[0] - t.slack), F.lit(a - at[0] + t.slack)), lambda d: _same(ws, p + d, key))

    def verified(p: Column) -> Column:
        return reduce(lambda x, y: x & y, [stands(p, a, key) for a, key in zip(at[1:], keys[1:])], F.lit(True))

    own = F.array_intersect(looked, F.array(*map(F.lit, offsets)))
    left = let(own, lambda o: F.filter(F.array_distinct(proposed), lambda s: F.forall(o, lambda w: borne_out(s, w))))
    return F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform(left, first_phrase))), verified))


def _coverage(t: Template, ws: Column, p: Column) -> Column:
    """The share of the template's distinct words that stand between its start and end, given the place of its first phrase."""
    whole, at = t.words.split(), places(t)[0]
    low = F.greatest(p - at - t.slack, F.lit(0))
    kinds = sorted(set(whole))
    return F.size(F.array_intersect(F.array(*map(F.lit, kinds)), F.slice(ws, low + 1, p - at + len(whole) + t.slack - low))) / len(kinds)


def _covered(t: Template, ws: Column) -> Callable[[Column], Column]:
    return lambda p: _coverage(t, ws, p)


def scan(df: DataFrame, base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE) -> DataFrame:
    """Appends ``n_words``, ``base_starts`` and ``more_starts`` (label to places of the first key phrase) and ``coverage``, the best share of a found template's words.

    Null texts count as empty and have no words.  Rows are independent, so ties,
    repeated rows and empty tables need no rule; columns of the input with these
    names are replaced.  One pass counts the words' documents, one scans.
    """
    templates = base + more
    idf = frequencies(df, templates)
    by_idf = sorted(idf, key=lambda w: (-idf[w], w))
    leads = {_rarest(t, idf) for t in templates}
    known = F.array(*[F.lit(w) for w in by_idf if idf[w] >= LEAST_IDF or w in leads])
    out = df.withColumn("__words", words(F.col("text")))
    # the text's own licence words, rarest first, and where the looked-up ones stand
    out = out.withColumn("__own", F.array_intersect(known, "__words"))
    out = out.withColumn("__looked", F.filter("__own", lambda w, k: (k < LOOKED_UP) | w.isin(*leads)))
    places_ = F.filter(F.transform("__words", lambda w, i: F.when(F.array_contains("__looked", w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    out = out.withColumn("__hits", F.when(F.size("__looked") > 0, places_))
    ws = F.col("__words")
    for name, ts in (("base_starts", base), ("more_starts", more)):
        some = [F.struct(F.lit(t.label).alias("label"), F.when(F.col("__hits").isNull(), F.array().cast("array<int>")).otherwise(_starts(t, idf, F.col("__hits"), F.col("__looked"), ws)).alias("starts")) for t in ts]
        out = out.withColumn(name, F.array(*some))
    best = [F.array_max(F.transform(F.get(col, k)["starts"], _covered(t, ws))) for col, ts in (("base_starts", base), ("more_starts", more)) for k, t in enumerate(ts)]
    out = out.withColumn("coverage", F.when(F.col("__hits").isNull(), 0.0).otherwise(F.coalesce(F.greatest(*best), F.lit(0.0))))
    return out.withColumn("n_words", F.size("__words").cast("long")).drop("__words", "__own", "__looked", "__hits")
