"""Cross-entropy difference of two matched n-gram models over one vocabulary.

The tokens are characters: every code point of the corpus, and one token for
what stands before a text.  A target model counts the trigrams of the documents
that ``labels`` calls good, a background model those of all other documents.
The models are matched: both have the same order, vocabulary and smoothing, and
the smoothing's weight follows each one's size, as if their counts were scaled
to equal totals.  A document is scored by models that left out its own counts.
Its score is the mean over its tokens of target loss minus background loss, in
nats: the lower, the more it reads like the target.

Counts are exact and cover every document and every trigram; they are a table,
which grows with what the corpus holds.  The counts of its most frequent
trigrams go to all workers, and documents meet the others in a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import stored

#: Pseudo-counts that the lower order gets at each order, in the target model.
KAPPA = 4.0
#: Trigrams at most whose counts go to all workers; it moves work, not results.
SHARED = 1 << 18
#: Good documents at most whose ids go to all workers; more meet the documents in a join.
SENT = 1 << 18
#: Characters that are coded at once.
CHUNK = 1 << 21
#: Bits of a token in a gram: a code point and one, 0 before the text.
BITS = 21
#: The counts behind a trigram u v w: of u v w, of u v before any token, of v w, of v before any token, of w.
ORDERS = ("n3", "c3", "n2", "c2", "n1")
_SIDES = ("target", "background")
_COUNTS = [f"{o}_{s}" for o in ORDERS for s in _SIDES]


class Sizes(NamedTuple):
    """Tokens of both sides, and kinds of tokens."""

    target: int
    background: int
    kinds: int

    def kappa(self, side: str, kappa: float = KAPPA) -> tuple[float, float]:
        """The pseudo-counts of a side at each order, and of a kind of token at the lowest: those of the target scaled by the sizes."""
        scale = self.background / self.target if side == "background" and self.target and self.background else 1.0
        return kappa * scale, scale


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, grams, the place in them of each token, tokens of each text), for runs of texts of about ``CHUNK`` characters."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        parts.append(_points(text))
        size += len(parts[-1])
        if size >= CHUNK or k == len(texts) - 1:
            yield (first, k + 1, *grams(parts))
            first, parts, size = k + 1, [], 0


def grams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of texts given as code points, the place in them of each token, and the tokens of each text."""
    lengths = np.array([len(p) for p in parts], np.int64)
    before = np.zeros(2, np.int64)
    t = np.concatenate([x for p in parts for x in (before, p.astype(np.int64) + 1)])
    token = np.ones(len(t), bool)
    starts = np.cumsum(lengths + 2) - lengths - 2
    token[starts] = token[starts + 1] = False
    used = np.flatnonzero(np.bincount(t))
    local = np.zeros(used[-1] + 1, np.int64)
    local[used] = np.arange(len(used))
    x, at, k = local[t], np.flatnonzero(token), len(used)
    g = (x[at - 2] * k + x[at - 1]) * k + x[at]
    if k**3 <= 4 * CHUNK:
        seen = np.zeros(k**3, bool)
        seen[g] = True
        cells, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[g]
    else:
        cells, place = np.unique(g, return_inverse=True)
    return (used[cells // (k * k)] << 2 * BITS) | (used[cells // k % k] << BITS) | used[cells % k], place, lengths


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``good``.  Ids of good documents go to all workers up to ``SENT``; rows without an id are not good and take no part in a join."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    if good.limit(SENT + 1).count() <= SENT:
        return docs.join(F.broadcast(good), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    named = docs.where("doc_id IS NOT NULL").join(good, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return named.unionByName(docs.where("doc_id IS NULL").withColumn("good", F.lit(False)))


def counts(docs: DataFrame) -> DataFrame:
    """(text, good) -> (gram, target, background): trigram counts over all documents, summed in each task before they are shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of = frame["good"].to_numpy(bool)
            for a, b, cells, place, lengths in chunks(frame["text"].tolist()):
                target = np.bincount(place[np.repeat(of[a:b], lengths)], minlength=len(cells))
                yield pd.DataFrame({"gram": cells, "target": target, "background": np.bincount(place, minlength=len(cells)) - target})

    summed = docs.select("text", "good").mapInPandas(run, "gram long, target long, background long").groupBy("gram")
    return summed.agg(F.sum("target").alias("n3_target"), F.sum("background").alias("n3_background"))


def count_table(n3: DataFrame) -> tuple[DataFrame, Sizes]:
    """Trigram counts -> (gram, n, the ten counts behind it), a row for each trigram of the corpus, and the sizes."""

    def sums(df: DataFrame, key: str, of: Column, old: str, new: str) -> DataFrame:
        return df.groupBy(of.alias(key)).agg(*[F.sum(f"{old}_{s}").alias(f"{new}_{s}") for s in _SIDES])

    low = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << k * BITS) - 1))
    high = lambda c: F.shiftright(c, BITS)
    n2 = sums(n3, "pair", low("gram", 2), "n3", "n2")
    n1 = sums(n2, "word", low("pair", 1), "n2", "n1")
    all_ = n1.agg(F.count(F.lit(1)).alias("kinds"), *[F.coalesce(F.sum(f"n1_{s}"), F.lit(0)).alias(s) for s in _SIDES]).first()
    pairs = n2.withColumn("word", low("pair", 1)).withColumn("last", high("pair")).join(n1, "word").join(sums(n2, "last", high("pair"), "n2", "c2"), "last")
    out = n3.withColumn("pair", low("gram", 2)).withColumn("context", high("gram")).join(pairs.drop("word", "last"), "pair").join(sums(n3, "context", high("gram"), "n3", "c3"), "context")
    return out.select("gram", (F.col("n3_target") + F.col("n3_background")).alias("n"), *_COUNTS), Sizes(all_.target, all_.background, all_.kinds + 1)


def loss(count, total, kappa: float, one: float, kinds: int, log):
    """-log p(w | u, v) from the counts of the five orders, by name, and the tokens in all: each order is mixed with the one below."""
    p = (count("n1") + one) / (total + one * kinds)
    p = (count("n2") + kappa * p) / (count("c2") + kappa)
    return -log((count("n3") + kappa * p) / (count("c3") + kappa))


def most_frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows of a table whose count is at least a power of two, the smallest one that leaves ``most`` of them or fewer, and whether these are all."""
    rows = table.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("power")).collect()
    total, least = 0, None
    for r in rows:
        total += r.rows
        if total > most:
            return table.where(F.floor(F.log2("n")) >= least if least is not None else F.lit(False)), False
        least = r.power
    return table, True


def own_counts(cells: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, counts of the five orders in that text) for the distinct trigrams of each text."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    keys, times = np.unique(of * len(cells) + place, return_counts=True)
    text, cell = keys // max(1, len(cells)), keys % max(1, len(cells))
    gram, own = cells[cell], [times]
    for part in (gram >> BITS, gram & ((1 << 2 * BITS) - 1), gram >> BITS & ((1 << BITS) - 1), gram & ((1 << BITS) - 1)):
        _, number = np.unique(part, return_inverse=True)
        key = text * (number.max(initial=0) + 1) + number
        _, where = np.unique(key, return_inverse=True)
        own.append(np.bincount(where, times)[where].astype(np.int64) if len(where) else times)
    return text, cell, np.array(own)


def score(docs: DataFrame, labels: DataFrame, shared: int = SHARED) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, target_loss, background_loss, score), one row for each row.

    Losses are means over a text's tokens in nats.  Null and empty texts have
    no tokens and losses of 0.  A side without documents is the smoothing
    alone.  Rows that repeat an id are documents of their own, all good if the
    id is.  An empty table gives an empty table.

    A trigram that isn't among the ``shared`` ones has, of all T tokens, fewer
    than about 2 T / ``shared``, so no key of the join is a hot one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = _marked(docs, labels)
    table, sizes = count_table(stored(counts(marked)))
    table = stored(table)
    known, whole = most_frequent(table, shared)
    rows = known.toPandas().sort_values("gram")  # at most ``shared`` rows
    sent = docs.sparkSession.sparkContext.broadcast((rows["gram"].to_numpy(np.int64), rows[_COUNTS].to_numpy(np.float64).T.reshape(len(ORDERS), 2, -1)))
    smooth = [sizes.kappa(s) for s in _SIDES]

    @F.pandas_udf("struct<n: long, target: double, background: double, rest: array<struct<gram: long, n3: long, c3: long, n2: long, c2: long, n1: long>>>")
    def read(text: pd.Series, good: pd.Series) -> pd.DataFrame:
        keys, values = sent.value
        out, is_good = [], good.to_numpy(bool)
        for a, b, cells, place, lengths in chunks(text.tolist()):
            at = np.minimum(np.searchsorted(keys, cells), max(len(keys) - 1, 0))
            found = keys[at] == cells if len(keys) else np.zeros(len(cells), bool)
            of, cell, own = own_counts(cells, place, lengths)
            ok, left = found[cell], is_good[a:b][of]
            sums = []
            for j, (side, (kappa, one)) in enumerate(zip(_SIDES, smooth)):
                mine = (left == (side == "target"))[ok]
                n = values[:, j][:, at[cell[ok]]] - own[:, ok] * mine
                total = getattr(sizes, side) - lengths[of[ok]] * mine
                each = loss(lambda o: n[ORDERS.index(o)], total, kappa, one, sizes.kinds, np.log)
                sums.append(np.bincount(of[ok], each * own[0, ok], len(lengths)))
            rest = [[] for _ in lengths]
            for k in np.flatnonzero(~ok):
                rest[of[k]].append((int(cells[cell[k]]), *map(int, own[:, k])))
            out.extend(zip(lengths, *sums, rest))
        return pd.DataFrame(out, columns=["n", "target", "background", "rest"])

    out = marked.withColumn("x", read("text", "good")).select("doc_id", "good", "x.*")
    if not whole:
        out = stored(out.withColumn("row", F.monotonically_increasing_id()))
        rest = out.select("row", "good", F.col("n").alias("tokens"), F.explode("rest").alias("own")).withColumn("gram", F.col("own.gram")).join(table, "gram")

        def side(name: str, mine: Column) -> Column:
            kappa, one = sizes.kappa(name)
            less = lambda c: F.when(mine, c).otherwise(F.lit(0))
            each = loss(lambda o: F.col(f"{o}_{name}") - less(F.col(f"own.{o}")), F.lit(getattr(sizes, name)) - less(F.col("tokens")), kappa, one, sizes.kinds, F.log)
            return F.sum(F.col("own.n3") * each).alias(f"more_{name}")

        more = rest.groupBy("row").agg(side("target", F.col("good")), side("background", ~F.col("good")))
        out = out.join(more, "row", "left").withColumns({s: F.col(s) + F.coalesce(f"more_{s}", F.lit(0.0)) for s in _SIDES})
    mean = lambda s: F.when(F.col("n") > 0, F.col(s) / F.col("n")).otherwise(0.0)
    return out.select("doc_id", F.col("n").alias("n_tokens"), mean("target").alias("target_loss"), mean("background").alias("background_loss"), (mean("target") - mean("background")).alias("score"))
