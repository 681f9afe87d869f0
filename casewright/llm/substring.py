"""Remove repeated substrings by hashed windows in prefix groups.

This stands in for prefix-partitioned suffix trees and builds none: see the README. A
window of ``width`` words begins at every word that has so many after it. Windows are
split by a hash of their first two words into cells, and a cell that is too large for
a task's memory is split by the hash of the whole window. Cells are packed into groups
of bounded size from exact counts, and one task sorts the window hashes of a group.
Equal neighbours are the leaves that a suffix tree has below one node of that depth.
The first leaf stays; the windows at all others are covered by an earlier copy, and
their words go. Longer repeats are covered by their windows; they are not listed.

A task of the scan first folds the suffixes it has itself: of equal windows only
the first one travels, the others are decided on the spot. A passage that a third
of all documents share thus costs a suffix per task and not per document. Suffixes
travel packed, some nine bytes each.

Windows are taken as equal if their prefix groups are and 56 bits of a hash. In a
corpus of n windows and g groups, which grow with n, about n * n / (g * 1.4e17) pairs
agree by chance: 0.002 for 128 million windows in 64 groups.

Defined results: windows are judged on the input; a null text has no words and
gives an empty text; null ids come after all others; rows that agree in id and
text are one document and get the same result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    document_key, mix64, rolling, shuffle_partitions, text_bytes, word_hashes,
)

WIDTH = 20
#: Prefix cells: so many bits of a hash of the first words.
CELL_BITS = 12
#: Suffixes whose hashes one task sorts at a time.
GROUP = 2_000_000
#: Bytes of text folded together before suffixes travel.
FOLD = 8_000_000


def _suffixes(data, offsets, width):
    """(text, place, window hash, cell) of every full window, in text order."""
    hashes, counts = word_hashes(data, offsets)
    runs = rolling(hashes, width)
    if not len(runs):
        none = np.zeros(0, np.int32)
        return none, none, runs, none.astype(np.int16)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    at = np.flatnonzero(text[: len(runs)] == text[width - 1 :])
    cell = rolling(hashes, 2)[at] >> np.uint64(64 - CELL_BITS)
    place = (at - counts[text[at]]).astype(np.int32)
    return text[at].astype(np.int32), place, runs[at], cell.astype(np.int16)


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_bytes(batch.column(0)):
                total += np.bincount(_suffixes(data, offsets, width)[3], minlength=1 << CELL_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(1 << CELL_BITS)), pa.array(total)], ["cell", "n"]
        )

    return run


def plan_groups(counts: np.ndarray, group: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells packed into groups of about equal size: (first group, groups of the cell, all).

    A cell of several groups is one whose prefix is lengthened to the window.
    """
    size = max(1, min(group, -(-int(counts.sum()) // least)))
    spread = np.maximum(1, -(-counts // size))
    first = np.zeros(len(counts), np.int64)
    large = np.flatnonzero(spread > 1)
    first[large] = np.cumsum(spread[large]) - spread[large]
    used = int(spread[large].sum())
    small = np.flatnonzero(spread == 1)
    before = np.cumsum(counts[small]) - counts[small]
    first[small] = used + before // size
    return first, spread, used + int(counts[small].sum() // size) + 1


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def _packed(hashes, ids, texts, at) -> bytes:
    """Suffixes in text order: seven bytes of each hash, and the rest as small steps."""
    short = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7]
    steps = [np.diff(x.astype(np.int64), prepend=0) for x in (ids, texts, at)]
    return len(hashes).to_bytes(8, "little") + short.tobytes() + _PACK.compress(np.concatenate(steps).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:8], "little")
    hashes = np.zeros((n, 8), np.uint8)
    hashes[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 8).reshape(n, 7)
    rest = np.frombuffer(_UNPACK.decompress(blob[8 + 7 * n :]), np.int64).reshape(3, n)
    return (hashes.view(np.uint64).ravel(), *np.cumsum(rest, axis=1))


def _firsts(hashes: np.ndarray) -> np.ndarray:
    """For each entry the smallest index with the same hash."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    out = np.empty(len(order), np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    out[order] = np.repeat(np.minimum.reduceat(order, starts), sizes) if len(order) else order
    return out


def _runs(ids, texts, at) -> np.ndarray:
    """Window starts in order as runs: columns of (id, text, first, last) start."""
    new = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (at[1:] > at[:-1] + 1))
    heads = np.flatnonzero(new) if len(at) else np.zeros(0, int)
    tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    return np.stack([x.astype(np.int64) for x in (ids[heads], texts[heads], at[heads], at[tails])])


def _pack_runs(runs: np.ndarray) -> bytes:
    return _PACK.compress(np.ascontiguousarray(np.diff(runs, axis=1, prepend=0)).tobytes())


def _unpack_runs(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_UNPACK.decompress(blob), np.int64).reshape(4, -1), axis=1)


def _fold(width: int, first: np.ndarray, spread: np.ndarray, groups: int):
    """Suffixes of the documents of a task, folded and packed for the groups."""

    def one(batch: pa.RecordBatch, turn: int) -> pa.RecordBatch:
        table = pa.Table.from_batches([batch]).sort_by([("__id", "ascending"), ("__th", "ascending")])
        ids, texts = (table.column(c).to_numpy() for c in ("__id", "__th"))
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))
        ids, texts = ids[fresh], texts[fresh]
        column = table.column("text").filter(pa.array(fresh)).combine_chunks()
        parts = []
        for row, _, data, offsets in text_bytes(column):
            document, at, hashes, cell = _suffixes(data, offsets, width)
            parts.append((document + np.int32(row), at, hashes, cell))
        document, at, hashes, cell = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Entries are in order of id and place, so the first index is the first start.
        head = _firsts(hashes)
        owner = ids[document]
        later = (owner > owner[head]) | ((owner == owner[head]) & (at > at[head]))
        gone = np.flatnonzero(later)
        known = _runs(owner[gone], texts[document[gone]], at[gone])
        rows = [(turn % groups, False, _pack_runs(known))] if known.shape[1] else []
        stay = np.flatnonzero(~later)
        cell, hashes = cell[stay], hashes[stay]
        group = first[cell] + ((mix64(hashes) >> np.uint64(1)).astype(np.int64) % spread[cell])
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[g] : cuts[g + 1]]
            doc = document[stay[mine]]
            rows.append((g, True, _packed(hashes[mine], ids[doc], texts[doc], at[stay[mine]])))
        group, packed, blobs = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(group, pa.int64()), pa.array(packed, pa.bool_()), pa.array(blobs, pa.binary())],
            ["group", "packed", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy())
            low = 0
            while low < len(ends):
                turn = batch.column(1)[0].as_py() if turn is None else turn + 1
                most = FOLD + (ends[low - 1] if low else 0)
                high = max(low + 1, int(np.searchsorted(ends, most, "right")))
                yield one(batch.slice(low, high - low), turn)
                low = high

    return run


def _later(buckets: int):
    """The later occurrences among the suffixes of a group, packed by document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        packed = rows["packed"].to_numpy().astype(bool)
        runs = [_unpack_runs(x) for x in rows.loc[~packed, "blob"]]
        parts = [_unpacked(x) for x in rows.loc[packed, "blob"]]
        if parts:
            hashes, ids, texts, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes)
            ordered = hashes[order]
            same = np.append(False, ordered[1:] == ordered[:-1])
            shared = order[same | np.append(same[1:], False)]
            hashes, ids, texts, at = (x[shared] for x in (hashes, ids, texts, at))
            order = np.lexsort((at, texts, ids))
            hashes, ids, texts, at = (x[order] for x in (hashes, ids, texts, at))
            head = _firsts(hashes)
            gone = np.flatnonzero((ids > ids[head]) | ((ids == ids[head]) & (at > at[head])))
            runs.append(_runs(ids[gone], texts[gone], at[gone]))
        found = np.concatenate(runs, axis=1)
        bucket = (mix64(found[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((found[2], found[1], found[0], bucket))
        found, bucket = found[:, order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts)).tolist()
        return pd.DataFrame({
            "bucket": np.array(used, np.int64),
            "blob": [_pack_runs(found[:, cuts[k] : cuts[k + 1]]) for k in used],
        })

    return run


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per document with its covered starts, as packed (first, last) pairs."""
    ids, texts, first, last = np.concatenate([_unpack_runs(x) for x in rows["blob"]], axis=1)
    order = np.lexsort((first, texts, ids))
    ids, texts, first, last = (x[order] for x in (ids, texts, first, last))
    document = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))
    # Runs of different groups touch but do not overlap.
    heads = np.flatnonzero(document | np.append(True, first[1:] > last[:-1] + 1))
    tails = np.append(heads[1:], len(first)) - 1
    pairs = np.stack([first[heads], last[tails]], axis=1).astype(np.int32)
    cuts = np.flatnonzero(document[heads])
    ends = np.append(cuts[1:], len(heads)).tolist()
    return pd.DataFrame({
        "__id": ids[heads[cuts]], "__th": texts[heads[cuts]],
        "covers": [pairs[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)],
    })


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, texts = [], [], []
            for text, covers in zip(batch.column(1), batch.column(2), strict=True):
                parts = (text.as_py() or "").encode().split()
                totals.append(len(parts))
                if covers.is_valid:
                    runs = np.frombuffer(covers.as_py(), np.int32).reshape(-1, 2)
                    step = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(step, runs[:, 0], 1)
                    np.add.at(step, runs[:, 1] + width, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    parts = [parts[i] for i in np.flatnonzero(keep).tolist()]
                removed.append(totals[-1] - len(parts))
                texts.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``; text: the kept words, one space apart."""
    number, digest = document_key()
    # Ids tell documents apart; the digest does so for rows that share one.
    keyed = docs.select("doc_id", number, F.pmod(digest, F.lit(2**32)).alias("__th"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    # One row per cell: 4,096 at most.
    tally = keyed.select("text").mapInArrow(_count(width), "cell bigint, n bigint")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for cell, n in tally.groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    plan = plan_groups(counts, group, parts)
    suffixes = keyed.select("__id", "__th", "text").mapInArrow(
        _fold(width, *plan), "group bigint, packed boolean, blob binary"
    )
    later = suffixes.groupBy("group").applyInPandas(_later(parts), "bucket bigint, blob binary")
    merged = later.groupBy("bucket").applyInPandas(_by_document, "__id bigint, __th bigint, covers binary")
    return (
        keyed.join(merged.hint("shuffle_hash"), ["__id", "__th"], "left")
        .select("doc_id", "text", "covers")
        .mapInArrow(_cut(width), "doc_id bigint, n_words bigint, n_removed bigint, text string")
    )


def op8(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM worded)
), later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest(range(20)) AS k)
), worded_rows AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM worded
), kept AS (
  SELECT a.doc_id, count(*) AS n_words, count(b.p) AS n_removed,
         coalesce(string_agg(a.word, ' ' ORDER BY a.p) FILTER (b.p IS NULL), '') AS text
  FROM worded_rows a LEFT JOIN covered b ON a.doc_id = b.doc_id AND a.p = b.p GROUP BY a.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
