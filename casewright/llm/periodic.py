"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at
least ``max(6, 4 * q)`` that neither neighbour extends. Each word of a run occurs at
least four times in it. So a word that occurs fewer times within a segment is in no
run there and splits the segment; parts of fewer than six words go. This is repeated
on the parts until nothing splits. Rounds take all segments of a few megabytes of
text at a time; segments from which rounds take little are split one by one, counting
the smaller parts anew and taking them off the counts of the largest, so that long
chains of splits take no more than n log n steps.

Surviving segments are scanned lag by lag. Of a run of period ``q``, words at four
consecutive multiples of ``q`` are equal; only these are looked at, n / q of them,
and a run is followed to both ends from there. A place inside a run of a smaller
period is passed over, as nothing new can begin there.

A text's result depends on that text alone, so nothing is shuffled. Words are compared
as numbers of a dictionary of the texts at hand, never by hash.

Defined results: a null or empty text has no words and no runs; repeated rows each get
the result of their text; null ids stay null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, computed, text_bytes
from .tokens import WORD_BYTES, coded, spans

#: Words of a run at least, and periods it holds at least.
SHORTEST, PERIODS = 6, 4

Segments = list[tuple[int, int]]


def _split_rounds(codes: np.ndarray, before: np.ndarray) -> Segments:
    """Segments, as first and end word, in which every word occurs often enough.

    ``before`` has the number of words before each text.
    """
    sizes = np.diff(before)
    size = int(codes.max(initial=0)) + 1
    at = np.arange(len(codes))
    segment = np.repeat(np.arange(len(sizes)), sizes)
    settled: Segments = []
    while len(at):
        _, inverse, count = np.unique(segment * size + codes[at], return_inverse=True, return_counts=True)
        rare = count[inverse] < PERIODS
        begins = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(begins[1:], len(at))
        changed = np.logical_or.reduceat(rare, begins)
        settled += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(begins[~changed], ends[~changed])]
        keep = ~rare & np.repeat(changed, ends - begins)
        left, owner = at[keep], segment[keep]
        if not len(left):
            break
        parts = np.cumsum((np.diff(left, prepend=-1) != 1) | (np.diff(owner, prepend=-1) != 0)) - 1
        long = np.bincount(parts)[parts] >= SHORTEST
        shrunk = long.sum() < 0.75 * len(at)
        at, segment = left[long], parts[long]
        if not shrunk:
            begins = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, b in zip(begins, np.append(begins[1:], len(at))):
                settled += _split_alone(codes, int(at[a]), int(at[b - 1]) + 1)
            break
    return settled


def _split_alone(codes: np.ndarray, start: int, end: int) -> Segments:
    """The same for one segment whose splits follow from one another."""
    own = codes[start:end]
    order = np.argsort(own, kind="stable")
    places = {int(c): p + start for c, p in zip(
        np.unique(own), np.split(order, np.flatnonzero(np.diff(own[order])) + 1))}
    counts = Counter({c: len(p) for c, p in places.items()})
    work = [(start, end, counts, [c for c, n in counts.items() if n < PERIODS])]
    settled: Segments = []
    while work:
        low, high, counts, rare = work.pop()
        if not rare:
            settled.append((low, high))
            continue
        cuts = [low - 1, high]
        for c in rare:
            p = places[c]
            cuts += p[np.searchsorted(p, low) : np.searchsorted(p, high)].tolist()
        cuts.sort()
        parts = [(a + 1, b) for a, b in zip(cuts, cuts[1:])]
        big = max(parts, key=lambda s: s[1] - s[0])
        for a, b in parts:
            if (a, b) != big and b - a >= SHORTEST:
                few = Counter(codes[a:b].tolist())
                work.append((a, b, few, [c for c, n in few.items() if n < PERIODS]))
        if big[1] - big[0] >= SHORTEST:
            gone = Counter(codes[low : big[0]].tolist())
            gone.update(codes[big[1] : high].tolist())
            counts.subtract(gone)
            work.append((*big, counts, [c for c in gone if 0 < counts[c] < PERIODS]))
    return settled


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading numbers agree."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differs = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, step * 2
    return n


def _scan(c: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in numbers that hold no segment beyond ``longest``."""
    n, runs = len(c), []
    reach = np.zeros(n, np.int64)  # end of the farthest run over a place
    for q in range(1, longest // PERIODS + 1):
        anchors = c[::q]
        same = anchors[1:] == anchors[:-1]
        places = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        places = places[reach[places] <= places + 3 * q]
        for probe in (1, 2, q // 2, q + q // 2, 2 * q - 1):
            places = places[c[places + probe] == c[places + probe + q]] if q > 1 and len(places) else places
        for j in places.tolist():
            if reach[j] > j + 3 * q:
                continue
            ahead = _agreeing(c[j:], c[j + q :])
            if ahead <= 2 * q:
                continue
            start = j - _agreeing(c[:j][::-1], c[: j + q][::-1])
            end = j + q + ahead
            if end - start >= max(SHORTEST, PERIODS * q):
                runs.append((start, end - start, q))
                reach[start:end] = np.maximum(reach[start:end], end)
    return runs


def runs_of(codes: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of numbered words, ordered by start and period."""
    segments = _split_rounds(codes, before)
    runs = []
    # Segments of like lengths are laid end to end, with numbers between that occur once.
    by_size: dict[int, Segments] = {}
    for a, b in segments:
        by_size.setdefault((b - a).bit_length(), []).append((a, b))
    for group in by_size.values():
        for k in range(0, len(group), 4096):
            part = group[k : k + 4096]
            lengths = np.array([b - a + 1 for a, b in part])
            heads = np.cumsum(lengths) - lengths
            joined = np.concatenate([np.append(codes[a:b], -1 - i) for i, (a, b) in enumerate(part)])
            for start, length, q in _scan(joined, int(lengths.max()) - 1):
                i = int(np.searchsorted(heads, start, "right")) - 1
                runs.append((part[i][0] + start - int(heads[i]), length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _collapsed(spaced: bytes, at: np.ndarray, first: int, end: int, gone: np.ndarray | None) -> bytes:
    """Words from ``first`` to ``end`` but for those that are gone, joined by a space."""
    if gone is None:
        return spaced[at[first] : max(at[first], at[end] - 1)]
    kept = np.flatnonzero(~gone) + first
    if not len(kept):
        return b""
    cut = np.flatnonzero(np.diff(kept) != 1)
    begins, ends = kept[np.append(0, cut + 1)], kept[np.append(cut, len(kept) - 1)] + 1
    return b"".join(spaced[at[a] : at[b]] for a, b in zip(begins, ends))[:-1]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _texts(texts: pa.Array) -> Iterator[tuple[int, list, list]]:
    """(first row, runs of each text, collapsed texts) of pieces of a column."""
    # With a space at its end every word is followed by one.
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    for row, end, data, offsets in text_bytes(ended):
        inside = WORD_BYTES[data]
        begins, lengths, before = spans(inside, offsets)
        codes, _ = coded(data[inside], lengths)
        spaces = begins + lengths
        data = data.copy()
        data[spaces] = 0x20
        inside[spaces] = True
        spaced = data[inside].tobytes()
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        runs = runs_of(codes, before)
        owner = np.searchsorted(before, [r[0] for r in runs], "right") - 1
        edges = np.searchsorted(owner, np.arange(end - row + 1))
        found, texts = [], []
        for i in range(end - row):
            first = int(before[i])
            own = [(s - first, n, q) for s, n, q in runs[edges[i] : edges[i + 1]]]
            gone = np.zeros(int(before[i + 1]) - first, bool) if own else None
            for s, n, q in own:
                gone[s + q : s + n] = True
            found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            texts.append(_collapsed(spaced, at, first, int(before[i + 1]), gone))
        yield row, found, texts


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, found, texts in _texts(batch.column(1)):
            ids = batch.column(0).slice(row, len(found))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, runs, collapsed)``: runs by start and period, and the text without them.

    ``collapsed`` has every word but those that some run holds after its first
    ``period`` words, joined by single spaces.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _find, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the CRC of its id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    split = computed(docs.select("doc_id", "text", F.floor(h / 10).alias("__g")), __w=words)
    n = F.size("__w")
    a = F.col("__g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8))
    placed = computed(split.withColumn("__n", n), __a=F.when(F.col("__n") > 0, a), __p=F.when(F.col("__n") > 0, p))
    text = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.col("__n") - 1),
            lambda i: F.get(
                "__w",
                F.when(i >= F.col("__a"), F.col("__a") + (i - F.col("__a")) % F.col("__p")).otherwise(i).cast("int"),
            ),
        ),
        " ",
    )
    return placed.select("doc_id", F.when(F.col("__n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    )
    # Greatest length first, then smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    derived = computed(found, __b=best)
    return derived.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("__b.s")).alias("start"),
        F.col("__b.l").alias("length"),
        (-F.col("__b.p")).alias("period"),
        F.floor(1000 * F.col("__b.l") / -F.col("__b.p")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table
), placed AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, (h // 10) % greatest(len(w), 1) AS a,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p
  FROM split
), texts AS (
  SELECT doc_id, n, CASE WHEN made
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
  FROM placed
), word AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM texts
), lag AS (
  -- Periods for which words at four multiples of the period agree.
  SELECT DISTINCT doc_id, q FROM (
    SELECT t.doc_id, q, unnest(range(0, n - 3 * q, q)) AS i, t.w
    FROM (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM texts WHERE n >= 6) t)
  WHERE w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1] AND w[i + 2 * q + 1] = w[i + 3 * q + 1]
), same AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM (
    SELECT doc_id, q, unnest(range(n - q)) AS i, w FROM lag JOIN texts USING (doc_id))
  WHERE w[i + 1] = w[i + q + 1]
), stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY doc_id, q, island
), run AS (
  SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first({'s': s, 'l': len, 'q': q} ORDER BY len DESC, s, q) AS best
  FROM run GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
