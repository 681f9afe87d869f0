"""Near-duplicate texts by circulant MinHash, banding and exact verification.

A text's set holds the hashes of its distinct word shingles. Two permutations of
the 32-bit numbers give the whole signature: the first places the set, the second
is applied after shifting by 0, 1, 2, ... around the circle, and the minima are
the coordinates. Texts that agree on a band are compared on their full sets:

* Texts with equal sets (equal size and 128-bit digest) become one class.
* In every band bucket, all classes are compared with the bucket's smallest id,
  its pivot. What is kept of a comparison is the difference to the pivot's set.
* Links between two members of a bucket follow from their differences to the
  shared pivot, |x ^ y| = |dx ^ dy|, which are short for near copies. Where some
  member is not linked with the pivot, the members are compared in square tiles;
  a tile returns which members hang together, never a row per pair.

So no link that a band proposes is lost, and nothing grows with the square of a
group but the work inside tiles. With 32 bands of 6 rows a pair at the limit of
0.85 shares a band with probability 1 - 3e-7, at 0.8 with 1 - 6e-5.

Defined results: null and empty texts have an empty set and no links; a text
shorter than a shingle is one shingle; rows sharing an id are one node that has
the links of each of them; a null id has no links; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, mix64, rolling, text_bytes, word_hashes

BANDS, ROWS = 32, 6
#: Members of a star are compared in tiles of so many by so many.
TILE = 512


def shingle_sets(data, offsets, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end, and where each begins."""
    hashes, counts = word_hashes(data, offsets, lower=True)
    n = np.diff(counts)
    runs = rolling(hashes, width)
    # Runs that begin and end in the same text; short texts are one run.
    text = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(text[: len(runs)] == text[width - 1 :]) if len(runs) else np.zeros(0, int)
    values, owners = [runs[whole]], [text[whole]]
    for k in np.flatnonzero((n > 0) & (n < width)):
        values.append(rolling(hashes[counts[k] : counts[k + 1]], n[k]) ^ np.uint64(n[k]))
        owners.append(np.array([k]))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[fresh], owners[fresh]
    return values, np.searchsorted(owners, np.arange(len(n) + 1))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, on 32-bit numbers and in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(values: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Circulant signatures, one column per text; all texts must be non-empty."""
    placed = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(begins) - 1), np.uint32)
    for shift in range(size):
        out[shift] = np.minimum.reduceat(_second(placed + np.uint32(shift)), begins[:-1])
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in text_bytes(batch.column(1), 1_000_000):
                values, begins = shingle_sets(data, offsets, width)
                sizes = np.diff(begins)
                full = np.flatnonzero(sizes)
                n = len(sizes)
                digest = np.zeros((2, n), np.uint64)
                keys = np.zeros((n, bands), np.uint64)
                if len(full):
                    heads = begins[:-1][full]
                    digest[0, full] = np.add.reduceat(mix64(values), heads)
                    digest[1, full] = np.bitwise_xor.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), heads)
                    signed = signatures(values, np.append(heads, len(values)), bands * rows).astype(np.uint64)
                    for b in range(bands):
                        keys[full, b] = rolling(signed[b * rows : (b + 1) * rows], rows)[0] + np.uint64(b)
                ends = np.append(0, np.cumsum(sizes > 0) * bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(keys[full].ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), pa.array(sizes.astype(np.int64)),
                     pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists],
                    ["doc_id", "n", "d1", "d2", "bands"],
                )

    return run


def _list_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_bytes(batch.column(1)):
                values, begins = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row),
                     pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values.view(np.int64)))],
                    ["id", "items"],
                )

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n members over the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile(percent: int):
    """Which members of two blocks of a star hang together."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["x"].to_numpy()
        n = rows["n"].to_numpy().astype(np.int64)
        linked = rows["linked"].to_numpy().astype(bool)
        diffs = rows["diff"].to_list()
        d = np.array([len(x) for x in diffs])
        member = np.repeat(np.arange(len(ids)), d)
        _, items = np.unique(np.concatenate([np.zeros(0, np.int64), *diffs]), return_inverse=True)
        # Items that only one member has change no overlap.
        shared = np.bincount(items)[items] > 1 if len(items) else np.zeros(0, bool)
        member, items = member[shared], items[shared]
        _, items = np.unique(items, return_inverse=True)
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(items, kind="stable")
        member, items = member[order], items[order]
        width, step = int(items.max()) + 1 if len(items) else 0, 8192
        for low in range(0, width, step):
            a, b = np.searchsorted(items, [low, low + step])
            part = np.zeros((len(ids), min(step, width - low)), np.float32)
            part[member[a:b], items[a:b] - low] = 1
            both += part @ part.T
        apart = d[:, None] + d[None, :] - 2 * both.astype(np.int64)
        common = (n[:, None] + n[None, :] - apart) // 2
        # Members linked with the pivot are together already.
        near = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        near &= ~(linked[:, None] & linked[None, :])
        left, right = np.nonzero(np.triu(near, 1))
        root = _roots(len(ids), left, right)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]})

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for ``docs (doc_id, text)``.

    Texts are linked where 100 * |intersection| >= percent * |union|.
    """
    texts = docs.select("doc_id", "text")
    signed = checkpointed(
        texts.mapInArrow(
            _sign(width, bands, rows), "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"
        )
    )
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(
        known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    )
    banded = classes.select("id", F.explode("bands").alias("key"))
    pivots = checkpointed(
        banded.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p < last").select("key", "p")
    )
    stars = checkpointed(
        banded.join(pivots, "key").where("id <> p").select("p", F.col("id").alias("x")).distinct()
    )
    wanted = stars.select(F.col("x").alias("doc_id")).union(stars.select("p")).distinct()
    sets = checkpointed(
        texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_list_sets(width), "id bigint, items array<bigint>")
    )
    compared = (
        stars.join(sets.select(F.col("id").alias("x"), F.col("items").alias("xs")), "x")
        .join(sets.select(F.col("id").alias("p"), F.col("items").alias("ps")), "p")
        .select(
            "p", "x", F.size("xs").alias("n"), F.size("ps").alias("m"),
            F.concat(F.array_except("xs", "ps"), F.array_except("ps", "xs")).alias("diff"),
        )
    )
    common = F.expr("(n + m - size(diff)) DIV 2")
    compared = checkpointed(
        compared.withColumn("common", common).withColumn(
            "linked", F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent
        )
    )
    direct = compared.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    links = direct.union(_within_stars(compared, percent))
    same_id = known.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high")
    joined = components(links.union(_repeated_ids(known, classes, same_id)), "a", "b")
    found = (
        signed.join(classes.select("n", "d1", "d2", "id"), ["n", "d1", "d2"], "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
    )
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _repeated_ids(known: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids used for several texts link the classes of all of them."""
    rows = known.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "d1", "d2")
    return rows.join(classes.select("n", "d1", "d2", "id"), ["n", "d1", "d2"]).select(
        F.col("doc_id").alias("a"), F.col("id").alias("b")
    )


def _within_stars(compared: DataFrame, percent: int) -> DataFrame:
    """Links between members of stars that have a member not linked with the pivot."""
    loose = checkpointed(
        compared.groupBy("p")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("linked")).alias("free"))
        .where("free > 0 AND size > 1")
        .select("p", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    )
    members = compared.join(loose, "p").withColumn(
        "block", F.pmod(F.xxhash64("x"), "blocks").cast("int")
    )
    # A member meets every block once: tiles are unordered pairs of blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = members.select("p", "x", "n", "diff", "linked", "block", other).select(
        "p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "x", "n", "diff", "linked",
    )
    # By all three keys: the rows come dealt by pivot, which keeps a star in one task.
    dealt = tiles.repartition("p", "i", "j")
    return dealt.groupBy("p", "i", "j").applyInPandas(_tile(percent), "a bigint, b bigint")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM worded WHERE len(w) > 0)
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM overlap o JOIN sized x ON o.a = x.doc_id JOIN sized y ON o.b = y.doc_id
  WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sized s ON d.doc_id = s.doc_id LEFT JOIN least_id c ON d.doc_id = c.doc_id
"""
