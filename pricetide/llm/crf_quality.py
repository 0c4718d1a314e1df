"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets one of two labels, good or bad. A line's evidence is a linear score over
its own features and those of the lines before and after it; a two by two table of transition scores
ties neighbouring labels together. The forward-backward pass gives each line's probability of being
good, and their mean, weighted by line length, is the document's score. Features look at the text
alone.

Training: the labelled documents with the smallest id hashes, at most ``SAMPLE_DOCS`` of them, those of
them with at most ``SAMPLE_LINES`` lines; their lines take the document's label. Only the feature
rows of this sample reach the driver, where the field is fitted by gradient steps. Everything else,
scoring above all, sees every line of every text.

Defined results: lines without a word are left out, and a null text or one without any word is one
empty line; rows are scored each for itself; labels that are null are ignored; without labels the
score is 0.5 everywhere; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import in_small_batches

SAMPLE_DOCS = 4000
SAMPLE_LINES = 200
STEPS = 250
RATE = 0.05
RIDGE = 1e-3
THRESHOLD = 0.7
MANY = 60.0  # log odds beyond this are as good as certain

SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
POINTS = b".,;:!?'\"()-"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
ASCII_LETTERS = UPPER + bytes(range(97, 123))
N_FEATURES = 14


def line_features(line: bytes, times: int) -> list[float]:
    """Features of one line; ``times`` is how often the text holds it."""
    words, size = line.split(), max(1, len(line))
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (N_FEATURES - 1)

    def share(letters: bytes) -> float:
        return (len(line) - len(line.translate(None, letters))) / size

    letters = share(ASCII_LETTERS)
    return [
        1.0, math.log1p(n), math.log1p(size), size / n / 10, share(SYMBOLS), share(POINTS), share(DIGITS),
        share(UPPER) / letters if letters else 0.0, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        float(times > 1), float(line.rstrip()[-1:] in (b".", b"!", b"?")), line.count(b"!") / n,
        sum(len(w) == 1 for w in words) / n,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths) of a whole text."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()] or [b""]
    times: dict[bytes, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    return np.array([line_features(x, times[x]) for x in lines]), np.array([max(1, len(x)) for x in lines], dtype=float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, then the previous line's, then the next line's (zeros past the ends)."""
    nothing = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([nothing, x[:-1]]), np.vstack([x[1:], nothing])])


@dataclass
class Field:
    """``weights`` of the features for the label good; ``links[a, b]`` scores b after a (0 bad, 1 good)."""

    weights: np.ndarray
    links: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """The probability of good for each line, by the forward and backward log odds."""
        evidence = np.clip(with_neighbours(x) @ self.weights, -MANY, MANY).tolist()
        (t00, t01), (t10, t11) = np.exp(self.links).tolist()
        forward, odds = [], None
        for e in evidence:
            if odds is None:
                odds = e
            else:
                p = math.exp(odds)
                odds = e + math.log((p * t11 + t01) / (p * t10 + t00))
            odds = min(max(odds, -MANY), MANY)
            forward.append(odds)
        good, back = [0.0] * len(evidence), 0.0
        for i in range(len(evidence) - 1, -1, -1):
            good[i] = 1 / (1 + math.exp(-min(max(forward[i] + back, -MANY), MANY)))
            p = math.exp(min(max(evidence[i] + back, -MANY), MANY))
            back = math.log((p * t11 + t10) / (p * t01 + t00))
        return np.array(good)

    def score(self, text: str | None) -> float:
        x, lengths = features(text)
        return float(np.average(self.marginals(x), weights=lengths))


def loss_and_slope(theta: np.ndarray, batch: dict) -> tuple[float, np.ndarray]:
    """Mean over documents of the negative log likelihood per line, and its gradient.

    Documents are laid side by side, longest first; step i works on those that have a line i.
    """
    x, y, starts, sizes = batch["x"], batch["y"], batch["starts"], batch["sizes"]
    k = x.shape[1]
    w, links = theta[:k], theta[k:].reshape(2, 2)
    evidence = x @ w
    n, longest = len(sizes), int(sizes[0])
    alive = [int(np.searchsorted(-sizes, -i)) for i in range(longest)]  # documents with more than i lines
    alpha = np.zeros((len(x), 2))
    for i in range(longest):
        at = starts[: alive[i]] + i
        own = np.stack([np.zeros(len(at)), evidence[at]], axis=1)
        alpha[at] = own if i == 0 else own + np.logaddexp(
            alpha[at - 1][:, :1] + links[0], alpha[at - 1][:, 1:] + links[1])
    beta = np.zeros((len(x), 2))
    for i in range(longest - 2, -1, -1):
        at = starts[: alive[i + 1]] + i
        after = beta[at + 1].copy()
        after[:, 1] += evidence[at + 1]
        beta[at] = np.logaddexp(after[:, :1] + links[:, 0], after[:, 1:] + links[:, 1])
    whole = np.logaddexp.reduce(alpha[starts + sizes - 1], axis=1)
    of = np.repeat(np.arange(n), sizes)
    share = (1.0 / (sizes * n))[of]
    good = np.exp(alpha[:, 1] + beta[:, 1] - whole[of])
    slope_w = x.T @ ((good - y[of]) * share)
    inner = np.ones(len(x), dtype=bool)
    inner[starts] = False
    here = np.flatnonzero(inner)
    pairs = alpha[here - 1][:, :, None] + links + beta[here][:, None, :] - whole[of[here]][:, None, None]
    pairs[:, :, 1] += evidence[here][:, None]
    slope_links = np.einsum("nab,n->ab", np.exp(pairs), share[here])
    same = y[of[here]] * share[here]
    slope_links -= np.array([[(share[here]).sum() - same.sum(), 0.0], [0.0, same.sum()]])
    told = (evidence * y[of] * share).sum() + (same * links[1, 1] + (share[here] - same) * links[0, 0]).sum()
    loss = (whole / (sizes * n)).sum() - told
    return loss + RIDGE * theta @ theta / 2, np.concatenate([slope_w, slope_links.ravel()]) + RIDGE * theta


def fit(rows: list[tuple[np.ndarray, int]]) -> Field:
    """Fit the field to (features, label) of whole documents."""
    width = 3 * N_FEATURES
    if not rows:
        return Field(np.zeros(width), np.zeros((2, 2)))
    rows = sorted(rows, key=lambda r: -len(r[0]))
    x = np.vstack([with_neighbours(r[0]) for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    # constant columns (the own line's 1, to begin with) are left as they are
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[0], spread[spread < 1e-9] = 0.0, 1.0
    batch = {"x": (x - middle) / spread, "y": np.array([float(r[1]) for r in rows]),
             "starts": np.concatenate(([0], np.cumsum(sizes)[:-1])), "sizes": sizes}
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, slope = loss_and_slope(theta, batch)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = theta[:width] / spread
    weights[0] -= (middle * weights).sum()
    return Field(weights, theta[width:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, docs_at_most: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, int]]:
    """Features and labels of the training sample: by hash of the id, held-out rows left aside."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("id"), "quality").dropDuplicates(["id"]).orderBy(
        F.xxhash64("id"), "id").limit(docs_at_most)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t)[0].astype("f8").tobytes() for t in texts])

    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    # the sample's size is bounded, so it may be sent to all tasks
    texts = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where(
        lines <= SAMPLE_LINES).dropDuplicates(["doc_id"])
    rows = texts.select("doc_id", "quality", packed("text").alias("x")).collect()
    return [(np.frombuffer(r["x"]).reshape(-1, N_FEATURES), r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame, docs_at_most: int = SAMPLE_DOCS) -> Field:
    return fit(sample(docs, labels, docs_at_most))


def line_marginals(text: Column, field: Field) -> Column:
    """The probability of good of every line with a word (one empty line where there is none)."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([field.marginals(features(t)[0]).tolist() for t in texts])

    return run(text)


def score_column(text: Column, field: Field) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([field.score(t) for t in texts], dtype="float64")

    return run(text)


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """The input's rows with ``score`` and ``predicted`` (columns of these names are replaced)."""
    rows = in_small_batches(docs).withColumn("score", score_column(docs["text"], field))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
