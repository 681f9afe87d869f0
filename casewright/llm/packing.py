"""Pack documents into fixed windows, in order, by dynamic programming.

The documents of a partition form one stream of token ids. It is cut into windows
of at most ``size`` ids. A cut may lie at a document's end, after a sentence, or,
inside very long sentences, after every ``GRAIN`` ids; the last two cost a
penalty. The cheapest cuts minimise padding plus penalties: the cost of ending a
window at a place is the least of (cost at its start + start) over all starts
within reach, a sliding minimum that a monotone queue keeps in constant time.

The stream is solved in spans of ``SPAN`` windows; the last windows of a span are
solved again with the next, so memory stays bounded and only the end of a
partition leaves a short window. That one is cut into windows whose lengths are
powers of two, which need no padding. Partitions are packed independently and
without a shuffle: a lost task repeats its own partition, with the same result.

Defined results: a null or empty text is its end id alone; rows are packed in the
order in which they are stored, repeated rows each by themselves; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lowered, span_hashes, text_bytes, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SIZE, END = 4096, 2
#: Costs, in padded ids, of cutting a document after a sentence and elsewhere.
SENTENCE, INSIDE = 24, 48
GRAIN = 64
SPAN = 256
#: Word parts whose ids a worker remembers, some 40 bytes each.
MEMORY = 1_000_000
#: New parts that are tokenized in one go: the tokenizer's answers take some kB each.
AT_ONCE = 10_000

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_MARK = _STOP.copy()
_MARK[list(b",;:")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


class Vocabulary:
    """Token ids of texts, put together from the ids of their parts.

    The vocabulary ignores case and splits at white space, and between a letter
    and a punctuation mark, before anything else. So the ids of a text are those
    of such parts in a row. Parts are remembered by their hash, in plain arrays: a
    worker keeps them beside what other stages need.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        # Hashes in ascending order, and the place of each one's ids.
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Remember parts; hashes ascend."""
        ids, lengths = [self.ids], []
        for a in range(0, len(hashes), AT_ONCE):
            spans = zip(begins[a : a + AT_ONCE].tolist(), ends[a : a + AT_ONCE].tolist(), strict=True)
            found = self.tokenizer.encode_batch_fast(
                [data[b:e].tobytes().decode() for b, e in spans], add_special_tokens=False
            )
            lists = [x.ids for x in found]
            lengths.extend(map(len, lists))
            ids.append(np.array([i for x in lists for i in x], np.uint32))
        at = np.searchsorted(self.known, hashes)
        self.place = np.insert(self.place, at, len(self.known) + np.arange(len(hashes)))
        self.known = np.insert(self.known, at, hashes)
        self.begins = np.append(self.begins, self.begins[-1] + np.cumsum(lengths))
        self.ids = np.concatenate(ids)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends, _ = words(data, offsets)
        mark = _MARK[data]
        mark[:1] = False
        after = np.zeros(len(data), bool)
        after[1:] = _LETTER[data[:-1]]
        # Letters of two bytes from U+00C0 to U+00FF.
        after[2:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        mark &= after
        mark[begins] = False
        inner = np.flatnonzero(mark)
        return np.sort(np.append(begins, inner)), np.sort(np.append(ends, inner))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids up to and with each part, whether it ends a sentence, parts before each text)."""
        begins, ends = self.parts(data, offsets)
        hashes, where, which = np.unique(
            span_hashes(lowered(data), begins, ends), return_index=True, return_inverse=True
        )
        if len(self.known) > MEMORY:
            self._forget()
        new = np.searchsorted(self.known, hashes) == np.searchsorted(self.known, hashes, "right")
        if new.any():
            self._learn(hashes[new], data, begins[where[new]], ends[where[new]])
        rows = self.place[np.searchsorted(self.known, hashes)][which]
        first = self.begins[rows]
        lengths = self.begins[rows + 1] - first
        up_to = np.cumsum(lengths)
        total = int(up_to[-1]) if len(up_to) else 0
        ids = self.ids[np.arange(total) + np.repeat(first - (up_to - lengths), lengths)]
        return ids, up_to, _STOP[data[begins]] if len(begins) else np.zeros(0, bool), np.searchsorted(begins, offsets)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


#: What parts can't be cut at: special tokens, and control characters that are
#: white space to some and not to others.
ODD = r"<\||[\x1c-\x1f]"


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, which serves many tasks."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def tokenized(voc: Vocabulary, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of a text column as (ids, ends of texts, ends of sentences).

    Every text is followed by the end id; ends count ids from the stretch's start.
    """
    odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, ODD), False).to_numpy(zero_copy_only=False))
    start = 0
    for stop_at in [*odd.tolist(), len(column)]:
        for row, end, data, offsets in text_bytes(column.slice(start, stop_at - start), 2_000_000):
            ids, up_to, stop, before = voc(data, offsets)
            text = np.repeat(np.arange(end - row), np.diff(before))
            own = np.append(0, up_to)[before[1:]]
            yield np.insert(ids, own, END), own + np.arange(1, end - row + 1), (up_to + text)[stop]
        if stop_at < len(column):
            ids = np.append(voc.whole(column[stop_at].as_py()), np.uint32(END))
            yield ids, np.array([len(ids)]), np.zeros(0, np.int64)
        start = stop_at + 1


def cut_places(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and what each costs."""
    at = np.unique(np.concatenate([ends, sentences]))
    cost = np.where(np.isin(at, ends), 0, SENTENCE)
    borders = np.append(0, at)
    wide = np.flatnonzero(np.diff(borders) > 4 * GRAIN)
    if len(wide):
        extra = np.concatenate([np.arange(borders[i] + GRAIN, borders[i + 1], GRAIN) for i in wide])
        at, cost = np.append(at, extra), np.append(cost, np.full(len(extra), INSIDE))
        order = np.argsort(at)
        at, cost = at[order], cost[order]
    return at, cost


def best_cuts(at: list[int], cost: list[int], size: int = SIZE) -> list[int]:
    """Window ends of least padding plus cost from 0 to the last place.

    The cost of a place is dp[j] = min(dp[i] + pad) + cost[j] with pad = size -
    (at[j] - at[i]) over all i with at[j] - at[i] <= size. As at[j] is fixed, the
    best i has the least dp[i] + at[i], kept by a monotone queue. A window that
    ends with the stream is not charged for padding.
    """
    places = [0, *at]
    costs = [0, *cost]
    value = [0] * len(places)
    come = [0] * len(places)
    queue = deque([0])
    last = len(places) - 1
    for j in range(1, len(places)):
        here = places[j]
        while places[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best = value[i] + places[i] - here + size
        if j == last:
            best = min((value[k], k) for k in queue)
            value[j], come[j] = best
            break
        value[j] = best + costs[j]
        come[j] = i
        key = value[j] + here
        while queue and value[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out = []
    j = last
    while j:
        out.append(places[j])
        j = come[j]
    return out[::-1]


def tail_cuts(length: int, size: int = SIZE) -> list[int]:
    """Window lengths for what is left: powers of two, or one padded window."""
    parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if size - length > INSIDE * len(parts) else [length]


def _pack(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc = vocabulary(path)
        base = TaskContext.get().partitionId() << 33
        pieces: deque = deque()  # (doc, its ids, ids of it already dealt)
        at: list[int] = []
        cost: list[int] = []
        total = done = windows = 0

        def deal(ends: list[int]) -> pa.RecordBatch:
            """Windows that end at the given places of the stream."""
            nonlocal windows, done
            rows = []
            for end in ends:
                offset = 0
                while done < end:
                    doc, ids, start = pieces[0]
                    length = min(len(ids) // 4 - start, end - done)
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + windows, offset))
                    offset += length
                    done += length
                    if start + length == len(ids) // 4:
                        pieces.popleft()
                    else:
                        pieces[0] = (doc, ids, start + length)
                windows += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def solve() -> list[int]:
            return [done + x for x in best_cuts([x - done for x in at], cost, size)]

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for ids, ends, sentences in tokenized(voc, batch.column(1)):
                places, costs = cut_places(ends, sentences)
                at.extend((places + total).tolist())
                cost.extend(costs.tolist())
                total += len(ids)
                for own in np.split(ids, ends[:-1]):
                    pieces.append((next(names), own.tobytes(), 0))
                if total - done > SPAN * size:
                    # The last windows may still change with what follows.
                    yield deal(solve()[: -SPAN // 8])
                    past = int(np.searchsorted(np.array(at), done, "right"))
                    del at[:past], cost[:past]
        if total > done:
            ends = solve()
            before = ends[-2] if len(ends) > 1 else done
            tail = np.cumsum(tail_cuts(ends[-1] - before, size)) + before
            yield deal(ends[:-1] + tail.tolist())

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.

    ``ids`` holds the piece's ids as unsigned little-endian 32-bit numbers.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _pack(tokenizer, size),
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def op3(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
