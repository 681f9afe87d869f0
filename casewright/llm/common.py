"""Helpers shared by the operators: checkpoints, components, hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import checkpointed, shuffle_partitions

__all__ = [
    "WORD", "carried", "checkpointed", "components", "computed", "document_key", "lowered", "mix64", "numbered",
    "restored", "rolling", "shuffle_partitions", "span_hashes", "text_bytes", "word_hashes", "words",
]

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def document_key() -> list[Column]:
    """Columns that identify a row of ``documents`` by its id and text.

    Ids may be null or repeated. Rows that agree in both columns are one
    document to the operators, and every copy of such a row gets its result.
    """
    return [
        F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("__id"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("__th"),
    ]


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` as the named columns and, in ``__rest``, whatever else it has.

    An operator that adds columns can then not clash with theirs.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(F.lit(0).alias("__"), *rest).alias("__rest"))


def restored(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The columns that were carried along, in their order."""
    return df.select(*[F.col(c) if c in names else F.col("__rest")[c].alias(c) for c in columns])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns by a generator, so that they are computed once per row.

    An array that other expressions use inside a lambda has to be a column in its own
    right: were its expression merged into theirs, as happens to plain projections
    below a filter, it would be computed again for every element.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a row number over the whole of ``df`` without sorting in one task.

    Rows are range-partitioned, numbered inside each partition and shifted by
    the sizes of the partitions before (one row per partition).
    """
    parts = shuffle_partitions(df.sparkSession)
    placed = checkpointed(
        df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        placed.withColumn("__rn", F.row_number().over(inside))
        # At most as many rows as there are shuffle partitions.
        .join(F.broadcast(shifts), "__part")
        .withColumn(name, F.col("__before") + F.col("__rn"))
        .drop("__part", "__rn", "__before")
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``.

    The component is the smallest node id. Nodes are those that occur in
    ``edges``. Each round lowers every node's label to the smallest label next to
    it, hooks the labels themselves in the same way, and shortens label chains,
    so long chains need a logarithmic number of rounds. Tables are checkpointed
    between rounds; joins on a hub's id have bare exchanges on both sides, so
    adaptive execution can split them.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = checkpointed(pairs.union(pairs.select("v", "u")).distinct())
    labels = checkpointed(
        both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("f"))
    )
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("f").alias("fv"))
        near = both.join(seen, "v").groupBy(F.col("u").alias("node")).agg(F.min("fv").alias("m"))
        state = checkpointed(labels.join(near, "node"))
        lower = state.where("m < f")
        if lower.isEmpty():
            return labels.withColumnRenamed("f", "component")
        hooks = lower.groupBy(F.col("f").alias("node")).agg(F.min("m").alias("h"))
        hooked = checkpointed(
            state.join(hooks, "node", "left").select("node", F.least("f", "m", "h").alias("f"))
        )
        roots = hooked.select(F.col("node").alias("f"), F.col("f").alias("ff"))
        labels = checkpointed(hooked.join(roots, "f").select("node", F.col("ff").alias("f")))


# --- words as numbers, inside tasks ------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ROOT) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_STEP = 1 << 16
_IN_WORD = _powers(0xD1342543DE82EF95, _STEP)


def text_bytes(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column as bytes: (first row, end row, bytes, offsets).

    A piece has about ``most`` bytes, but always whole texts. Null is empty.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word, and the words before each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = inside[1:] & ~inside[:-1]
    # A text's first byte begins a word even if the text before ended in one.
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads + 1]
    last = inside[1:-1] & ~inside[2:]
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = inside[offsets[1:][offsets[1:] > offsets[:-1]]]
    begins = np.flatnonzero(first[: len(data)])
    ends = np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the number of words before each text."""
    begins, ends, counts = words(data, offsets)
    return span_hashes(lowered(data) if lower else data, begins, ends), counts


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


#: Bytes of spans that are hashed at once, about: each takes some 40 bytes meanwhile.
_BLOCK = 1 << 18


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, none of them empty."""
    out = np.zeros(len(begins), np.uint64)
    upto = np.append(0, np.cumsum(ends - begins))
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + _BLOCK, "right")) - 1)
        out[a:b] = _block_hashes(data, begins[a:b], ends[a:b])
        a = b
    return out


def _block_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - begins
    # Bytes of the spans only, each times a power of its place in the span.
    stops = np.cumsum(lengths)
    at = np.arange(stops[-1]) - np.repeat(stops - lengths, lengths)
    values = _BYTE[data[at + np.repeat(begins, lengths)]]
    if lengths.max() <= _STEP:
        values *= _IN_WORD[at]
    else:
        blocks = (at >> 16).astype(np.uint64)
        values *= _IN_WORD[at & (_STEP - 1)] * (mix64(blocks * _ROOT) | np.uint64(1))
    sums = np.add.reduceat(values, stops - lengths)
    return mix64(sums + lengths.astype(np.uint64) * _ROOT)


_WIDE = 0xA3B195354A39B70D


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive numbers along the first axis."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros((n, *hashes.shape[1:]), np.uint64)
    factor = 1
    for i in range(width):
        factor = factor * _WIDE % 2**64
        total += hashes[i : i + n] * np.uint64(factor)
    return mix64(total)
