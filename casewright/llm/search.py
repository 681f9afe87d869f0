"""Ranked lexical search of items in documents, scored by classes of equal bags.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII,
with A-Z in lower case. Documents are restricted to the vocabulary of the items:
what is left of one is its bag, the terms it shares with any item and how often it
holds them. Documents whose bags and lengths ``m`` agree score alike for every item.
They form a class: Spark groups by a hash of the key and verifies the key itself.
Each class is scored once, in blocks of classes and items with integers only. A task
keeps the ``k`` best classes of each item, those of equal scores by their smallest
document. No document outside the ``k`` best classes of an item can be among its
``k`` best documents. Members of these classes follow by ascending document id.

Items are worked on in blocks of about ``BLOCK_BYTES`` of text, which bounds what is
sent to the tasks; a block reads the documents once and stores their bags.

Defined results: a null or empty text has no terms and is no document to N and L; an
item without terms, or whose terms no document holds, has no rows; every row of a table
is a document or item of its own, so repeated rows get results of their own, at
ranks of their own; null document ids come last among equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lowered, text_bytes
from .tokens import TERM_BYTES, coded, spans

#: Text of the items that are searched in one pass over the documents.
BLOCK_BYTES = 8_000_000
#: Classes and items whose scores a task holds at a time.
CLASSES, ITEMS = 2048, 1024
LAST = 2**63 - 1


def text_terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    data = lowered(np.frombuffer((text or "").encode(), np.uint8))
    begins, lengths, _ = spans(TERM_BYTES[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a : a + n] for a, n in zip(begins.tolist(), lengths.tolist())]


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(id, n, terms, tfs)`` of each document with terms.

    ``n`` counts all its terms, ``terms`` are the places in the vocabulary of those
    found there, in ascending order, and ``tfs`` how often each occurs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_binary())
        size = max(1, len(known))
        for batch in batches:
            for row, end, data, offsets in text_bytes(batch.column(1)):
                low = lowered(data)
                inside = TERM_BYTES[low]
                _, lengths, before = spans(inside, offsets)
                n = np.diff(before)
                codes, distinct = coded(low[inside], lengths)
                place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy()
                place = place[codes] if len(codes) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(end - row), n)[place >= 0]
                keys, tfs = np.unique(text * size + place[place >= 0], return_counts=True)
                at = np.searchsorted(keys, np.arange(end - row + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (keys % size, tfs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(n), *lists], ["id", "n", "terms", "tfs"]
                ).filter(pa.array(n > 0))

    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text")
    return keyed.mapInArrow(restrict, "id bigint, n bigint, terms array<int>, tfs array<int>")


class Best:
    """The ``k`` best classes of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)

    def add(self, scores: np.ndarray, first_item: int, ids: np.ndarray, hashes: np.ndarray) -> None:
        """Scores of classes (rows) for items (columns) from ``first_item`` on."""
        row, item = np.nonzero(scores >= self.floor[first_item : first_item + scores.shape[1]])
        if not len(row):
            return
        new = np.stack([item + first_item, scores[row, item], ids[row], hashes[row]])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        begins = np.searchsorted(rows[0], np.arange(len(self.floor)))
        rank = np.arange(rows.shape[1]) - begins[rows[0]]
        self.floor[rows[0][rank == self.k - 1]] = rows[1][rank == self.k - 1]
        self.rows = rows[:, rank < self.k]


def best_classes(classes: DataFrame, weights: np.ndarray, items: list[Counter], k: int) -> DataFrame:
    """``(item, score, id, hash)``: of each task's classes the ``k`` best per item.

    ``items`` count places in the vocabulary. Equal scores go to the smaller ``id``.
    """
    by_term = sorted((t, i, n) for i, counts in enumerate(items) for t, n in counts.items())
    index = np.array(by_term, np.int64).reshape(-1, 3)
    sent = classes.sparkSession.sparkContext.broadcast((index, weights, len(items)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, n_items = sent.value
        best = Best(n_items, k)
        chunks = []
        for low in range(0, n_items, ITEMS):
            part = index[(index[:, 1] >= low) & (index[:, 1] < low + ITEMS)]
            chunks.append((low, part, np.searchsorted(part[:, 0], np.arange(len(weights) + 1))))
        for batch in batches:
            for at in range(0, batch.num_rows, CLASSES):
                ids, hashes, m, terms, tfs = batch.slice(at, CLASSES).columns
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy())
                terms, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
                value = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m.to_numpy()[row]))
                order = np.argsort(terms, kind="stable")
                row, value, terms = row[order], value[order], terms[order]
                begins = np.flatnonzero(np.diff(terms, prepend=-1))
                ends = np.append(begins[1:], len(terms))
                for low, part, places in chunks:
                    scores = np.zeros((len(ids), min(ITEMS, n_items - low)), np.int64)
                    for a, b, t in zip(begins.tolist(), ends.tolist(), terms[begins].tolist()):
                        its = part[places[t] : places[t + 1]]
                        if len(its):
                            scores[row[a:b, None], its[:, 1] - low] += value[a:b, None] * its[:, 2]
                    best.add(scores, low, ids.to_numpy(), hashes.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows], ["item", "score", "id", "hash"])

    columns = classes.select("id", "hash", "m", "terms", "tfs")
    return columns.mapInArrow(score, "item bigint, score bigint, id bigint, hash bigint")


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for a block of items."""
    spark = docs.sparkSession
    counted = [Counter(text_terms(r["text"])) for r in rows]
    vocabulary = sorted(set().union(*counted))
    place = {t: i for i, t in enumerate(vocabulary)}
    stored = checkpointed(bags(docs, vocabulary))
    n_docs, n_terms = stored.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most a row per term of the block.
    df = (
        stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("t").alias("df"))
        .select("t", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
    )
    weights = np.zeros(len(vocabulary), np.int64)
    for t, w in df:
        weights[t] = w
    # Decimals, for 75 * n * N can be beyond 64 bits.
    m = F.expr(f"25 + (75 * cast(n as decimal(18, 0)) * {n_docs}BD) div {max(n_terms, 1)}BD").cast("bigint")
    bag = ["m", "terms", "tfs"]
    members = stored.where(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64(*bag))
    classes = checkpointed(members.groupBy("hash", *bag).agg(F.min("id").alias("id")))
    items = [Counter({place[t]: n for t, n in c.items()}) for c in counted]
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "id", "hash")
    won = checkpointed(
        best_classes(classes, weights, items, k)
        .withColumn("__rank", F.row_number().over(ahead)).where(F.col("__rank") <= k).drop("__rank")
    )
    # The best classes' bags, then their members by document, as many as can count.
    heads = won.select("hash", F.col("id").alias("head")).distinct()
    named = classes.withColumnRenamed("id", "head").join(heads, ["hash", "head"])
    # A large class gives no more than k rows of each task to the shuffle.
    inside = Window.partitionBy("hash", *bag).orderBy("id")
    first = members.select("id", "hash", *bag).withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= k)
    expanded = first.join(named, ["hash", *bag]).select("hash", "head", "id")
    found = won.select("item", "score", "hash", F.col("id").alias("head")).join(expanded, ["hash", "head"])
    final = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item bigint, item_id bigint")
    return (
        found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).join(names, "item")
        .select("item_id", "rank", F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "score")
    )


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    numbered = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("b"))
    result = None
    for b in range(blocks):
        # Bounded: a block's share of the items' text.
        part = _block(docs, numbered.where(F.col("b") == b).collect(), k)
        result = part if result is None else result.unionByName(part)
    return result


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""WITH held AS (
  SELECT doc_id, unnest({_TERMS}) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL
)
SELECT * FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0) WHERE rank <= 10
"""
