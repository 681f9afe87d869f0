"""Remove lines covered by three-line windows that occur earlier in the corpus.

Every run of three consecutive lines is a window, hashed from its lines. A window
whose lines also start earlier (smaller document id, or the same document and an
earlier line) is a later occurrence; the lines that later occurrences cover are
removed. Windows are judged on the input, not on what is left. Only DataFrame
functions are used.

Defined results: lines end at ``\\n``; lines of white space alone are in no window
and always stay; texts of fewer than three other lines keep all lines; a null text
stays null with no lines; null ids come after all others; rows that agree in id
and text are one document and all keep the same lines; an empty table gives an
empty result; other columns pass through, but for those of the names it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, computed, document_key

WINDOW = 3


def _solid(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n")


def window_starts(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(__id, __th, at, h1, h2)``: every window and a 128-bit hash of its lines.

    ``at`` counts a document's non-blank lines from zero.
    """
    lines = F.filter(_lines(), _solid)
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    keyed = docs.select(*document_key(), hashes.alias("__l"))
    last = F.size("__l") - width
    windows = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.get("__l", i + k)["a"] for k in range(width)]).alias("h1"),
            F.xxhash64(*[F.get("__l", i + k)["b"] for k in range(width)]).alias("h2"),
        ),
    )
    return keyed.select("__id", "__th", F.inline(windows))


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that also occur earlier.

    First occurrences are found with a minimum, combined before the shuffle, so a
    line block that a third of all documents share costs a row per task. Those
    of repeated windows are written down; the join back to the windows then has
    bare exchanges on both sides, which adaptive execution can split.
    """
    place = F.struct("__id", "at")
    first = checkpointed(
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .select("h1", "h2", "first")
    )
    return windows.join(first, ["h1", "h2"]).where(place > F.col("first"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` reduced, and the columns ``n_lines`` and ``n_removed``."""
    cover = (
        later_windows(window_starts(docs, width))
        .groupBy("__id", "__th")
        .agg(F.array_sort(F.collect_set("at")).alias("__starts"))
    )
    keyed = docs.select("*", *document_key())
    lines = keyed.join(cover.hint("shuffle_hash"), ["__id", "__th"], "left")
    covered = F.array_distinct(
        F.flatten(F.transform("__starts", lambda i: F.sequence(i, i + (width - 1))))
    )
    # Places of non-blank lines; those not covered are kept along with blank ones.
    everything = F.sequence(F.lit(0), F.size("__l") - 1)
    solid = F.filter(everything, lambda i: _solid(F.get("__l", i)))
    split = computed(lines, __l=_lines())
    cut = computed(split, __cover=covered, __solid=F.when(F.col("__starts").isNotNull(), solid))
    gone = F.transform("__cover", lambda i: F.get("__solid", i))
    kept = F.array_except(everything, gone)
    text = F.when(F.col("__starts").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__l", i)), "\n")
    )
    lost = F.coalesce(F.size("__cover"), F.lit(0))
    return (
        cut.withColumn("n_lines", F.coalesce(F.size("__l"), F.lit(0)))
        .withColumn("n_removed", F.when(F.col("__starts").isNull(), 0).otherwise(lost))
        .withColumn("text", text)
        .select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
    )


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


LINES_SQL = r"""
lined AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos
  FROM lined WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT * FROM (
    SELECT doc_id, pos, line AS l0, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2
    FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY place)) WHERE l2 IS NOT NULL
), later AS (
  SELECT doc_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)
), marked AS (
  SELECT l.doc_id, l.line, l.place, c.pos IS NOT NULL AS gone
  FROM lined l LEFT JOIN solid s ON l.doc_id = s.doc_id AND l.place = s.place
  LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.pos = c.pos
), cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)"""

OP1_SQL = f"""WITH {LINES_SQL}
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       coalesce(c.n_lines, 0)::INTEGER AS n_lines, coalesce(c.n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
