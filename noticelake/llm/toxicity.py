"""Toxicity by a classifier chain over sparse text features.

Labels say only whether a document is toxic; the kinds of toxicity are learnt
as clusters of the labelled toxic documents by the features that set them apart.
The chain predicts the kinds one after the other and the label last.  The linear
model of a category sees the text's features and the probabilities of the
categories before it; in training those come from models that were fitted
without the document's fold, so that a later model learns how far to trust them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.common import stored
from noticelake.llm.linear import best_threshold, fit, sigmoid
from noticelake.llm.minhash import texts, word_hashes

#: Labelled documents that the models are fitted on, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 6_000
#: Text features of the models, at most.
MAX_FEATURES = 4_000
#: What a feature needs: positive documents, their share of all positive ones, their share of its documents, and standard deviations above chance.
LEAST_HITS, LEAST_SHARE, LEAST_PURITY, LEAST_Z = 5, 0.005, 0.9, 6.0
FOLDS = 4
#: Kinds of toxicity before the label itself.
KINDS = 2
_NOT_LETTERS = np.ones(256, bool)
_NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PREFIXES = (4, 5, 6)


def features(data: np.ndarray) -> np.ndarray:
    """Of a text's UTF-8 bytes, distinct hashes of the words (runs of letters) and of their prefixes of 4 to 6 bytes, which catch words with many endings."""
    found = word_hashes(data, _NOT_LETTERS, _PREFIXES)
    return np.unique(np.concatenate(found)).view(np.int64)


class Chain:
    """The fitted models: sorted feature hashes, and weights by category."""

    def __init__(self, names: list[str], chosen: np.ndarray, models: list[tuple[np.ndarray, np.ndarray, float]], threshold: float) -> None:
        self.names, self.chosen, self.models = names, chosen, models
        #: Beyond what a text without any of the features gets, so that a high base rate alone calls nothing toxic.
        self.threshold = max(threshold, float(np.nextafter(self.probabilities(np.empty(0, np.uint8))[-1], 2.0))) if models else threshold

    def probabilities(self, data: np.ndarray) -> list[float]:
        """The categories' probabilities for a text's UTF-8 bytes."""
        f = features(data)
        at = np.searchsorted(self.chosen, f)
        at = at[self.chosen[np.minimum(at, len(self.chosen) - 1)] == f] if len(self.chosen) else at[:0]
        out: list[float] = []
        for w, v, b in self.models:
            out.append(float(sigmoid(np.array(w[at].sum() + v @ np.array(out) + b))))
        return out


def choose(sampled: DataFrame, positive: int, negative: int, most: int = MAX_FEATURES) -> np.ndarray:
    """The features (at most ``most``) of (target, features) that are most above chance among the positive rows, sorted; none without both classes."""
    if not positive or not negative:
        return np.empty(0, np.int64)
    n = sampled.select("target", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("hits"))
    p, q = (F.col("hits") + 0.1) / (positive + 0.2), (F.col("n") - F.col("hits") + 0.1) / (negative + 0.2)
    z = F.abs(p - q) / F.sqrt((F.col("n") + 0.2) / (positive + negative) / min(positive, negative))
    rows = n.withColumn("z", z).where((F.col("hits") >= max(LEAST_HITS, LEAST_SHARE * positive)) & (F.col("hits") >= LEAST_PURITY * F.col("n")) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "feature").limit(most).collect()  # at most `most` rows
    return np.array(sorted(r.feature for r in rows), np.int64)


def kinds_of(columns: list[np.ndarray], width: int, n: int = KINDS, rounds: int = 12) -> np.ndarray:
    """A kind from 0, the largest first, for each row of feature numbers: k-means by the cosine, from the row with most features and the ones least like those before.  Rows without features have kind -1."""
    x = np.zeros((len(columns), width), np.float32)
    for k, c in enumerate(columns):
        x[k, c] = 1 / np.sqrt(max(len(c), 1))
    has = np.array([len(c) > 0 for c in columns], bool)
    if not has.any():
        return np.full(len(columns), -1)
    rows = x[has]
    seeds = [int(np.argmax([len(c) for c in columns if len(c)]))]
    while len(seeds) < n:
        seeds.append(int(np.argmin((rows @ rows[seeds].T).max(1))))
    centres = rows[seeds]
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(1)
        total = np.stack([rows[of == j].sum(0) if (of == j).any() else centres[j] for j in range(n)])
        centres = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    of = (rows @ centres.T).argmax(1)
    rank = np.argsort(np.argsort(-np.bincount(of, minlength=n), kind="stable"))
    out = np.full(len(columns), -1)
    out[has] = rank[of]
    return out


def fit_chain(columns: list[np.ndarray], chosen: np.ndarray, targets: dict[str, np.ndarray]) -> Chain:
    """Fits the chain on rows that hold the numbers of their features in ``chosen``.  Without rows every probability is one half and nothing is toxic."""
    n, names = len(columns), list(targets)
    owner, column = np.repeat(np.arange(n), [len(c) for c in columns]), np.concatenate([*columns, np.empty(0, np.int64)]).astype(np.int64)
    fold = np.arange(n) % FOLDS
    before, models = np.zeros((n, 0)), []
    for name in names:
        y = targets[name].astype(float)
        out = np.zeros(n)
        for k in range(FOLDS if n >= 2 * FOLDS else 0):
            train, test = fold != k, fold == k
            new = np.cumsum(train) - 1
            mine = train[owner]
            w, v, b = fit(new[owner[mine]], column[mine], before[train], y[train], len(chosen))
            z = np.bincount(owner, w[column], minlength=n) + before @ v + b
            out[test] = sigmoid(z)[test]
        models.append(fit(owner, column, before, y, len(chosen)))
        before = np.column_stack([before, out])
    return Chain(names, chosen, models, max(0.05, best_threshold(before[:, -1], targets[names[-1]].astype(float))) if n else 0.5)


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Chain:
    """Fits the chain on a bounded sample of the labelled documents (``doc_id``, ``toxic``).

    The sample of at most ``most`` rows is the only thing that reaches the
    driver.  Labels that are null, or whose document is missing, take no part.
    """
    sample = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("target")).groupBy("doc_id").agg(F.max("target").alias("target"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = [(r.doc_id, r.target) for r in sample.collect()]  # at most `most` rows
    spark = documents.sparkSession
    few = F.broadcast(spark.createDataFrame(ids, "doc_id long, target int"))
    # an id that repeats counts once, with the least of its texts
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(few, "doc_id").groupBy("doc_id", "target").agg(F.min("text").alias("text"))

    @F.arrow_udf("array<long>")
    def sparse(text: pa.Array) -> pa.Array:
        return pa.array([features(data) for data in texts(text)], pa.list_(pa.int64()))

    sampled = stored(found.select("doc_id", "target", sparse("text").alias("features")))
    base = sampled.drop("features").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    toxic = base["target"].to_numpy() == 1
    chosen = choose(sampled, int(toxic.sum()), int((~toxic).sum()))
    numbers = spark.createDataFrame([(int(f), k) for k, f in enumerate(chosen)], "feature long, number int")
    has = sampled.select("doc_id", F.explode("features").alias("feature")).join(F.broadcast(numbers), "feature")  # at most MAX_FEATURES numbers
    of = {r.doc_id: r.numbers for r in has.groupBy("doc_id").agg(F.array_sort(F.collect_list("number")).alias("numbers")).collect()}
    columns = [np.array(of.get(i, []), np.int64) for i in base["doc_id"].tolist()]
    kind = np.full(len(columns), -1)
    kind[toxic] = kinds_of([c for c, t in zip(columns, toxic) if t], len(chosen))
    return fit_chain(columns, chosen, {**{f"kind_{j + 1}": kind == j for j in range(KINDS)}, "toxic": toxic})


def classify(df: DataFrame, chain: Chain) -> DataFrame:
    """Appends ``p_<category>`` for each category, ``toxic``, and ``kept``, its opposite.

    Texts without letters, empty and null ones have no features; they get the
    models' base rates and stay.  Rows are independent: no shuffle, and ties,
    repeated rows and empty tables need no rule.  Columns of the input with
    these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("array<double>")
    def p(text: pa.Array) -> pa.Array:
        c = shared.value
        return pa.array([c.probabilities(data) for data in texts(text)], pa.list_(pa.float64()))

    names = [f"p_{c}" for c in chain.names]
    out = df.drop(*names, "toxic", "kept").withColumn("p_of_chain", p(F.col("text").cast("string")))
    out = out.withColumns({n: F.col("p_of_chain")[k] for k, n in enumerate(names)}).drop("p_of_chain")
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    toxic = has & (F.col(names[-1]) >= chain.threshold)
    return out.withColumns({"toxic": toxic, "kept": ~toxic})


def trained(spark: SparkSession, sf_dir: str) -> Chain:
    """The chain of the tables in ``sf_dir``."""
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
