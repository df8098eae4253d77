"""Line labelling with a linear-chain conditional random field, and the quality rules on top.

Each line of a text is content or boilerplate.  A text's lines are decoded
together (Viterbi); the share of words in content lines decides whether the
text stays, after the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.minhash import mix, word_hashes

#: Labelled documents that the field is fitted on, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 4_000
#: Lines in a row that the field is fitted on together, and such pieces of a document at most: of longer ones a seeded choice.
PIECE, MAX_PIECES = 48, 4
#: The least share of words in content lines of a text that stays.
LEAST_CONTENT = 0.5
#: Base rules: fewest words, and most words in repeated 3-word windows, in percent.
FEWEST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_BYTE_CLASS = np.zeros(256, np.int64)  # 0 other, 1 white space, 2 symbol, 3 upper, 4 digit, 5 mark
_BYTE_CLASS[[ord(c) for c in _SPACES]] = 1
_BYTE_CLASS[[ord(c) for c in SYMBOLS]] = 2
_BYTE_CLASS[65:91] = 3
_BYTE_CLASS[48:58] = 4
_BYTE_CLASS[[ord(c) for c in ".,;:!?-'\"()"]] = 5
FEATURES = 12


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    w = hashes[:n].copy()
    for k in range(1, width):
        w = mix(w) + hashes[k : n + k]
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : n + k] |= again
    return int(covered.sum())


def line_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: words, and features between 0 and 1 of its characters."""
    kinds = _BYTE_CLASS[data]
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.zeros((6, len(data) + 1))
    for k in range(6):
        np.cumsum(kinds == k, out=sums[k, 1:])
    by = sums[:, ends] - sums[:, starts]
    begins = (kinds != 1) & (np.concatenate(([1], kinds[:-1])) == 1)
    n_words = np.diff(np.concatenate(([0], np.cumsum(begins)))[np.stack([starts, ends])], axis=0)[0]
    live = n_words > 0
    by, n_words = by[:, live], n_words[live]
    if not len(n_words):
        return n_words, np.zeros((0, FEATURES))
    chars = by.sum(0) - by[1]
    share = by[[2, 3, 4, 5]] / chars
    last = data[np.maximum(ends[live] - 1, 0)]
    x = np.column_stack([
        np.ones(len(n_words)), *np.minimum(share * np.array([[4], [1], [2], [2]]), 1), n_words <= 2, n_words <= 8, n_words > 30,
        np.minimum(chars / n_words / 20, 1), np.isin(last, [46, 33, 63]), share[0] > 0.02, share[1] > 0.5,
    ]).astype(float)
    return n_words, x


class Field:
    """Weights: emission (2 x features) and transition (2 x 2); state 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def decode(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """The best labels of texts' lines (Viterbi): rows of features, text after text, and how many lines each has (all are one's without it).

        Texts go on together, line by line, the longest first.
        """
        lengths = np.array([len(x)]) if lengths is None else lengths[lengths > 0]
        order = np.argsort(-lengths, kind="stable")
        n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        score, back, out = x @ self.emit.T, np.zeros((len(x), 2), np.int8), np.zeros(len(x), np.int8)
        if not len(n):
            return out
        best = score[starts]
        steps = [(t, starts[: np.searchsorted(-n, -t)] + t) for t in range(1, n[0])]
        for _, at in steps:
            m = len(at)
            via = best[:m, :, None] + self.move[None]
            back[at] = via[:, 1] > via[:, 0]
            best[:m] = via.max(1) + score[at]
        out[starts + n - 1] = best[:, 1] > best[:, 0]
        for _, at in reversed(steps):
            out[at - 1] = back[at, out[at]]
        return out


def fit_field(texts: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, penalty: float = 1e-3, piece: int = PIECE) -> Field:
    """Maximum likelihood by gradient ascent over pieces of up to ``piece`` lines, all at once; forward and backward sums go line by line over all of them."""
    emit, move = np.zeros((2, FEATURES)), np.zeros((2, 2))
    texts, labels = [x[k : k + piece] for x in texts for k in range(0, len(x), piece)], [y[k : k + piece] for y in labels for k in range(0, len(y), piece)]
    if not texts:
        emit[1, 0] = 1.0
        return Field(emit, move)
    longest = max(map(len, texts))
    x, y, live = np.zeros((len(texts), longest, FEATURES)), np.zeros((len(texts), longest), int), np.zeros((len(texts), longest), bool)
    for k, (a, b) in enumerate(zip(texts, labels)):
        x[k, : len(a)], y[k, : len(b)], live[k, : len(a)] = a, b, True
    one = np.eye(2)[y] * live[..., None]
    n = live.sum()
    seen_move = np.einsum("kti,ktj->ij", one[:, :-1], one[:, 1:])
    seen_emit = np.einsum("kti,ktf->if", one, x)
    speed_e, speed_m = np.zeros_like(emit), np.zeros_like(move)
    pair = live[:, 1:]
    for _ in range(steps):
        e = np.exp(np.clip(x @ emit.T, -30, 30))
        m = np.exp(move)
        f, scale = np.zeros_like(e), np.ones((len(texts), longest))
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            v = (f[:, t - 1] @ m) * e[:, t]
            scale[:, t] = v.sum(1)
            f[:, t] = np.where(live[:, t, None], v / scale[:, t, None], f[:, t - 1])
        b = np.ones_like(e)
        for t in range(longest - 2, -1, -1):
            v = ((b[:, t + 1] * e[:, t + 1]) @ m.T) / scale[:, t + 1, None]
            b[:, t] = np.where(live[:, t + 1, None], v, 1.0)
        node = f * b
        node = node / node.sum(2, keepdims=True) * live[..., None]
        edge = f[:, :-1, :, None] * m[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        edge = edge / edge.sum((2, 3), keepdims=True) * pair[..., None, None]
        speed_e = 0.8 * speed_e + 2.0 * ((seen_emit - np.einsum("kti,ktf->if", node, x)) / n - penalty * emit)
        speed_m = 0.8 * speed_m + 1.0 * ((seen_move - edge.sum((0, 1))) / n - penalty * move)
        emit, move = emit + speed_e, move + speed_m
    return Field(emit, move)


def pieces(x: np.ndarray) -> np.ndarray:
    """The lines of ``MAX_PIECES`` pieces at most, in order."""
    n = -(-len(x) // PIECE)
    if n <= MAX_PIECES:
        return x
    chosen = np.sort(np.random.default_rng(len(x)).choice(n - 1, MAX_PIECES, replace=False))  # whole pieces, so that none runs into the next
    return np.concatenate([x[k * PIECE : (k + 1) * PIECE] for k in chosen])


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Field:
    """Fits the field on a bounded sample of labelled documents (``doc_id``, ``quality``).

    Lines of good documents count as content.  Of bad ones, lines whose features
    are rare among good documents' lines count as boilerplate: a logistic model
    of good against bad lines, fitted first, labels them.  Of a document with
    more lines than ``PIECE * MAX_PIECES`` a seeded choice of pieces counts, and of
    rows with one id the least text, so that what reaches the driver is bounded
    whatever the length of texts and however often rows repeat.
    """
    sample = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).groupBy("doc_id").agg(F.min("good").alias("good"))
    ids = [(r.doc_id, r.good) for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]  # at most `most` rows
    few = F.broadcast(documents.sparkSession.createDataFrame(ids, "doc_id long, good int"))

    @F.pandas_udf("array<double>")
    def lines(text: pd.Series) -> pd.Series:
        return pd.Series([pieces(line_features(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8))[1]).ravel() for t in text], dtype=object)

    # an id that repeats counts once, with the least of its texts
    once = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(few, "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    got = once.select("doc_id", "good", lines("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    pairs = [(np.asarray(x, float).reshape(-1, FEATURES), int(g)) for x, g in zip(got["x"], got["good"]) if len(x)]
    if not pairs:
        return fit_field([], [])
    all_x, all_y = np.concatenate([x for x, _ in pairs]), np.concatenate([np.full(len(x), g, float) for x, g in pairs])
    w, b = np.zeros(FEATURES), 0.0
    weight = np.where(all_y == 1, 0.5 / max(all_y.sum(), 1), 0.5 / max((1 - all_y).sum(), 1))
    for _ in range(400):
        e = (1 / (1 + np.exp(-np.clip(all_x @ w + b, -30, 30))) - all_y) * weight
        w, b = w - 3 * (e @ all_x + 1e-4 * w), b - 3 * e.sum()
    return fit_field([x for x, _ in pairs], [np.ones(len(x), int) if g else (x @ w + b > 0).astype(int) for x, g in pairs])


def measure(text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the words and features of the lines with a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    hashes = word_hashes(data, cased=True)[0]
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    counts = len(hashes), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes)
    return counts, *line_features(data)


def judge(df: DataFrame, field: Field, least_content: float = LEAST_CONTENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, the five measures, content_share, base_failed, kept), one row for each row.

    ``content_share`` is the share of words in content lines, 1 for a text
    without lines.  A null or empty text has no words, fails the base rules and
    goes.  Rows are independent: no shuffle, and ties, repeated rows and empty
    tables need no rule.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                counts, words, x = zip(*[measure(t) for t in part["text"]])
                lengths, words = np.array([len(w) for w in words]), np.concatenate(words)
                content = words * shared.value.decode(np.concatenate(x), lengths)
                of = np.repeat(np.arange(len(part)), lengths)
                inside, all_ = (np.bincount(of, v, len(part)) for v in (content, words))
                share = np.where(all_ > 0, inside / np.maximum(all_, 1), 1.0)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, **{n: [c[k] for c in counts] for k, n in enumerate(_NAMES[:-1])}, _NAMES[-1]: share})

    kinds = ", ".join(f"{n} {'double' if n == 'content_share' else 'long'}" for n in _NAMES)
    out = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id long, {kinds}")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least_content))


#: Texts whose lines are decoded together.
TOGETHER = 500
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share")
