"""Quality classifier trained without labels.

1. Heuristic labellers vote good, bad or nothing on each text, from statistics of
   its words. Votes overlap and err.
2. Expectation-maximisation over the counts of vote patterns of all documents
   (3 ** labellers at most) estimates how often each labeller votes how on good and
   on bad texts, and the posterior of every pattern.
3. The posteriors are the labels of a linear scorer over hashed word features,
   fitted on about ``SAMPLE`` documents chosen by a hash of id and text.
4. The scorer judges every document; a document is kept from ``KEEP`` upwards.

Counting and judging cover all documents. What reaches the driver is the pattern
counts and the sample's features, both bounded.

Defined results: a null text, or one without words, scores 0 and is not kept; rows
that repeat are judged alike; a null id is judged by the text; an empty table gives
an empty result; other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mix64, restored, span_hashes, text_bytes, words

FEATURES = 1 << 12
#: Documents the scorer is fitted on, about.
SAMPLE = 20_000
KEEP = 0.5
#: Added to a text's word count, so that a few words decide little.
FEW = 8
#: Bytes of texts that are looked at in one go, about: each takes some 50 bytes meanwhile.
PIECE = 1_000_000

_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"%&*#$!|<>{}[]\\^~=+_@")] = True
_MARK[list(b".!?")] = True
_CLASS = np.select(
    [_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, np.arange(256) >= 128], [1, 2, 3, 4, 5, 6], 0
).astype(np.uint64)


class Texts:
    """Word statistics of a piece of a text column."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.begins, self.ends, before = words(data, offsets)
        self.data, self.count = data, np.diff(before)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = span_hashes(data, self.begins, self.ends)
        self.again = np.zeros(len(self.begins), bool)
        if len(self.begins):
            self.again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.text[1:] == self.text[:-1])

    def per_word(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes in each word."""
        upto = np.append(0, np.cumsum(marks[self.data]))
        return upto[self.ends] - upto[self.begins]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, values, len(self.count))

    def votes(self) -> np.ndarray:
        """A row per text and a column per labeller: 1 good, -1 bad, 0 no vote."""
        n = np.maximum(self.count, 1)
        letters = self.per_text(self.per_word(_LETTER))
        upper = self.per_text(self.per_word(_UPPER)) / np.maximum(letters, 1)
        symbols = self.per_word(_SYMBOL)
        bars = (self.ends - self.begins == 1) & (symbols == 1)
        stops = _MARK[self.data[self.ends - 1]] if len(self.ends) else np.zeros(0)
        key = np.unique(np.stack([self.text.astype(np.uint64), self.hash]), axis=1)[0]
        distinct = np.bincount(key.astype(np.int64), minlength=len(self.count)) / n
        length = self.per_text(self.ends - self.begins) / n
        again, marked = self.per_text(self.again) / n, self.per_text(symbols > 0) / n
        table, stop = self.per_text(bars) / n, self.per_text(stops) / n

        def vote(bad, good, enough=1):
            return np.where(self.count < enough, 0, np.where(bad, -1, np.where(good, 1, 0)))

        return np.stack([
            vote(again > 0.2, again < 0.05, 4),
            vote(upper > 0.5, upper < 0.2, 3),
            vote(marked > 0.35, marked < 0.08),
            vote(table > 0.15, table < 0.03, 4),
            vote((stop > 0.4) | (stop < 0.01), (stop > 0.03) & (stop < 0.3), 40),
            vote(distinct < 0.15, distinct > 0.3, 30),
            vote((length < 2.2) | (length > 16), (length > 3) & (length < 11), 4),
        ], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hashed feature) of each word: its shape, its end and what came before."""
        if not len(self.begins):
            return self.text, np.zeros(0, np.int64)
        long = np.minimum(self.ends - self.begins, 15).astype(np.uint64)
        first, last = _CLASS[self.data[self.begins]], _CLASS[self.data[self.ends - 1]]
        caps = (self.per_word(_UPPER) > 1).astype(np.uint64)
        some = np.minimum(self.per_word(_SYMBOL), 3).astype(np.uint64)
        shape = np.zeros(len(long), np.uint64)
        for part in (long, first, last, caps, some, self.again.astype(np.uint64)):
            shape = shape * np.uint64(16) + part
        return self.text, (mix64(shape + np.uint64(1)) % np.uint64(FEATURES)).astype(np.int64)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_bytes(batch.column(0), PIECE):
            texts = Texts(data, offsets)
            votes = texts.votes()[texts.count > 0] + 1
            code = votes @ (3 ** np.arange(votes.shape[1]))
            patterns, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n)], ["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_bytes(batch.column(0), PIECE):
            texts = Texts(data, offsets)
            votes = texts.votes() + 1
            code = votes @ (3 ** np.arange(votes.shape[1]))
            text, feature = texts.features()
            pairs, n = np.unique(text * FEATURES + feature, return_counts=True)
            owner = pairs // FEATURES
            ends = np.searchsorted(owner, np.arange(len(code) + 1))
            weight = n / (texts.count + FEW)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), batch.column(1).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % FEATURES)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(weight))],
                ["pattern", "times", "features", "weights"],
            )


def _judge(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, _, data, offsets in text_bytes(batch.column(batch.schema.get_field_index("text")), PIECE):
                texts = Texts(data, offsets)
                text, feature = texts.features()
                total = np.bincount(text, weights[feature], len(texts.count)) / (texts.count + FEW)
                scores.append(np.where(texts.count > 0, 1 / (1 + np.exp(-(total + bias))), 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def labeller_rates(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, P(good vote | class) by labeller, posterior of each pattern).

    votes: 0 bad, 1 none, 2 good by pattern and labeller; n: texts of the pattern.
    Labellers are independent given the class; a missing vote says nothing. They
    start out as mostly right, and that belief keeps the weight of a hundredth of
    the texts: a labeller seldom calls good texts bad.
    """
    start = np.array([0.6, 0.98])
    held = 0.01 * n.sum()
    rates = np.tile(start, (votes.shape[1], 1))
    good = 0.8
    up, down = (votes == 2).astype(float), (votes == 0).astype(float)
    post = np.zeros(len(n))
    for _ in range(rounds):
        logs = up @ np.log(rates) + down @ np.log(1 - rates) + np.log([1 - good, good])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        share = np.stack([n * (1 - post), n * post], axis=1)
        ups, downs = up.T @ share, down.T @ share
        rates = (ups + held * start) / (ups + downs + held)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        good = float(np.clip(share[:, 1].sum() / max(n.sum(), 1), 0.01, 0.99))
    return good, rates, post


def fit_linear(row, feature, weight, target, times=None, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows and soft targets; times: how often each row counts."""
    n = len(target)
    part = np.full(n, 1 / n) if times is None else times / times.sum()
    w, rate = np.zeros(FEATURES + 1), 0.5
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[feature] * weight, n) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * part
        grad = np.append(np.bincount(feature, weight * miss[row], FEATURES), miss.sum()) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def chosen(docs: DataFrame, share: float) -> DataFrame:
    """``(text, times)``: a share of the rows, each of those that agree in id and text once.

    A row that stands c times counts c * share times, rounded up or down by a hash so
    that it does so on average. Rows of many copies are thus neither left out nor sent
    more than once, and no row decides about more than its share.
    """
    key = F.xxhash64(F.lit("fit"), F.col("doc_id").isNull(), *[F.col(c) for c in ("doc_id", "text")])
    keyed = docs.where(F.col("text").isNotNull()).select(key.alias("__key"), "text")
    want = F.col("n") * F.lit(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "__key"), 11) / F.lit(2.0**53)
    times = F.floor(want) + (draw < want - F.floor(want)).cast("bigint")
    counted = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    picked = counted.select("__key", times.alias("times")).where("times > 0")
    # About SAMPLE rows at most; copies fold before they are shuffled.
    found = keyed.join(F.broadcast(picked), "__key")
    return found.groupBy("__key", "text", "times").agg(F.count(F.lit(1)).alias("n")).select("text", "times")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer for these documents."""
    texts = docs.select("text")
    counts = texts.mapInArrow(_vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most 3 ** 7 rows
    if not found:
        return np.zeros(FEATURES), 0.0
    patterns = np.array([r["pattern"] for r in found])
    n = np.array([r["n"] for r in found], float)
    votes = patterns[:, None] // 3 ** np.arange(7) % 3
    _, _, post = labeller_rates(votes, n)
    label = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    share = min(1.0, sample / n.sum())
    rows = chosen(docs, share).mapInArrow(
        _sampled, "pattern bigint, times bigint, features array<bigint>, weights array<double>"
    ).collect()
    rows = [r for r in rows if r["features"]]
    if not rows:
        return np.zeros(FEATURES), 0.0
    row = np.repeat(np.arange(len(rows)), [len(r["features"]) for r in rows])
    feature = np.array([x for r in rows for x in r["features"]])
    weight = np.array([x for r in rows for x in r["weights"]])
    times = np.array([r["times"] for r in rows], float)
    return fit_linear(row, feature, weight, np.array([label[r["pattern"]] for r in rows]), times)


def judged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs``, a ``score`` from 0 to 1, and whether it is ``kept``.

    Columns of these two names are replaced.
    """
    weights, bias = fit(docs, sample)
    own = docs.select([c for c in docs.columns if c not in ("score", "kept")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    scored = own.mapInArrow(_judge(weights, bias), f"{fields}, score double")
    return scored.withColumn("kept", F.col("score") >= KEEP)


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Only the documents that the classifier keeps, with their columns."""
    own = ("doc_id", "text")
    return restored(judged(carried(docs, *own), sample).where("kept"), docs.columns, *own)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "score", "kept")
