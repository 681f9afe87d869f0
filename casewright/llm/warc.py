"""WARC archives of pages, and a two-level index of their captures.

Pages are written where they lie, a gzip member per record, so that each record can be
read by its range; no page text is shuffled unless very many payloads repeat. A payload
of at least ``REVISIT_BYTES`` that another page has under a smaller id becomes a
revisit record, which holds headers only and names the page it repeats.

The index is sorted by key, the URL with its host reversed, and page id. Captures are
range-partitioned; each part is a file of compressed blocks of ``BLOCK`` lines followed by
its sparse directory, which has the first key of every block. The first keys of the
parts, at most one per shuffle partition, are what a lookup sends to its tasks. A
lookup sorts the wanted keys, searches part and block by bisection, reads the blocks'
ranges, and searches inside them. Records are then read by ranges of the archives,
neighbours in one go.

Archives, index and the table of parts lie in one folder that all executors reach,
on any store that Arrow's file systems open. A task writes files under names of
its own and reports what is in them, so a lost or repeated task leaves a file that
nothing refers to.

Defined results: a null html is an empty payload; rows of the smallest page id with a
payload are all responses, others revisit it; null page ids come after all others and
are read back as null; a null URL has an empty key; URLs that differ in scheme, user,
default port, fragment or white space alone share a key; repeated rows have a record
each; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import ensure_checkpoint_dir
from .common import shuffle_partitions

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Captures of a block of the index.
BLOCK = 2048
#: Bytes of an archive before the next is begun, and of records read in one go.
ARCHIVE_BYTES, READ_BYTES = 1 << 30, 4 << 20
#: Records between two wanted ones that are read along with them.
GAP_BYTES = 64 << 10
#: Pages have no time of capture of their own.
DATE = "1970-01-01T00:00:00Z"
#: Wanted keys of one block that go to one task.
TURN = 8192
NO_ID = 2**63 - 1

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?([^#]*)"
_END = b"\r\n\r\n"


def url_key(url: Column) -> Column:
    """A URL with its host reversed, as in ``org,example,www)/path?query``."""
    whole = F.coalesce(url, F.lit(""))
    host, port, rest = (F.regexp_extract(whole, _URL, i) for i in (1, 2, 3))
    turned = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    key = F.when(whole.rlike(_URL), F.concat(turned, port, F.lit(")"), path)).otherwise(whole)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]+", "%20")


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and the folder's path there."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# --- records ------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, digest: str, payload: bytes, first: tuple | None) -> bytes:
    """A response record, or a revisit of ``first`` (page id, URL)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if first:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first[0]}>",
        ]
        if first[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header(first[1])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _header(url: str) -> str:
    """A URL that fits into a line of a header, with white space as in its key."""
    return re.sub(r"[\x00-\x20\x7F]+", "%20", url)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parsed(record: bytes) -> dict:
    """What a record holds. A revisit has no payload, but its size and digest."""
    head, rest = record.split(_END, 1)
    fields = _fields(head)
    size = int(fields["content-length"])
    if rest[size:] != _END:
        raise ValueError(f"record {fields.get('warc-record-id')} does not end where it says")
    http, payload = rest[:size].split(_END, 1)
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": _number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": _number(fields.get("warc-refers-to")),
        "refers_to_url": fields.get("warc-refers-to-target-uri"),
        "stated_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "stated_bytes": int(_fields(http)["content-length"]),
        "payload": None if revisit else payload,
    }


RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, refers_to_url string, "
    "stated_digest string, stated_bytes bigint, payload binary"
)
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("refers_to_url", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()),
    ("payload", pa.binary()),
])


# --- archives -----------------------------------------------------------------

CAPTURE = "key string, id bigint, file string, at bigint, size bigint"
_CAPTURE = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _file_name(kind: str) -> str:
    return f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; ``(key, id, file, at, size)`` of each, stored in the folder."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "url", payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    # The first page of each payload that other pages repeat; combined before the shuffle.
    repeated = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last")).where("first.id < last")
        .select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # As a table its size is known, so that a small one is broadcast and a large one is not.
    repeated.write.parquet(f"{folder}/repeated")
    marked = rows.join(spark.read.parquet(f"{folder}/repeated"), "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        store.create_dir(f"{path}/archives", recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            kept = []
            payloads = batch.column(0)
            narrow = zip(*[c.to_pylist() for c in batch.columns[1:]])
            for i, (key, page, url, digest, first_id, first_url) in enumerate(narrow):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = _file_name("pages") + ".warc.gz", 0
                    out = store.open_output_stream(f"{path}/archives/{name}", compression=None)
                first = (first_id, first_url) if first_id is not None and first_id < page else None
                record = record_bytes(None if page == NO_ID else page, url, digest, payloads[i].as_py(), first)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                kept.append((key, page, name, at, len(member)))
                at += len(member)
            yield _batch(kept, _CAPTURE)
        if out is not None:
            out.close()

    columns = marked.select("payload", url_key(F.col("url")).alias("key"), "id", "url", "digest", "first_id", "first_url")
    columns.mapInArrow(write, CAPTURE).write.parquet(f"{folder}/captures")
    return spark.read.parquet(f"{folder}/captures")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the given places of the archives, see ``RECORD``.

    Records that lie near to each other are read in one range of a file.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        near: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*[c.to_pylist() for c in batch.columns]):
                if near and (
                    place[0] != near[0][0]
                    or place[1] - near[-1][1] - near[-1][2] > GAP_BYTES
                    or place[1] + place[2] - near[0][1] > READ_BYTES
                ):
                    yield near
                    near = []
                near.append(place)
        if near:
            yield near

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        for name, groups in itertools.groupby(ranges(batches), key=lambda near: near[0][0]):
            with store.open_input_file(f"{path}/archives/{name}") as file:
                for near in groups:
                    begin = near[0][1]
                    data = file.read_at(near[-1][1] + near[-1][2] - begin, begin)
                    found = [parsed(zlib.decompress(data[a - begin : a - begin + n], 31)) for _, a, n in near]
                    yield pa.RecordBatch.from_pylist(found, _RECORD)

    stretch = F.floor(F.col("at") / (8 * READ_BYTES))
    placed = captures.select("file", "at", "size").repartition(shuffle_partitions(captures.sparkSession), "file", stretch)
    return placed.sortWithinPartitions("file", "at").mapInArrow(read, RECORD)


# --- index --------------------------------------------------------------------

_DIRECTORY = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
_PART = pa.schema([
    ("key", pa.binary()), ("id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()),
])


def _lines(data: bytes) -> list[tuple[bytes, int, str, int, int]]:
    """The captures of a block."""
    rows = (line.split(b"\t") for line in zlib.decompress(data, 31).split(b"\n")[:-1])
    return [(key, int(page), file.decode(), int(at), int(size)) for key, page, file, at, size in rows]


@dataclass
class CaptureIndex:
    """A stored index: its folder, and for each part its first capture and directory.

    ``parts`` has (key, page id, file, place and size of the directory), in order;
    no more of them than there were shuffle partitions.
    """

    folder: str
    parts: list[tuple[bytes, int, str, int, int]]

    def directory(self, store: fs.FileSystem, path: str, part: int) -> list[tuple[bytes, int, int, int]]:
        """(first key, first page id, place, size) of a part's blocks."""
        _, _, name, at, size = self.parts[part]
        with store.open_input_file(f"{path}/index/{name}") as file:
            table = pa.ipc.open_stream(file.read_at(size, at)).read_all()
        return list(zip(*[c.to_pylist() for c in table.columns]))

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (key, low, high) with each block that may hold them."""
        sent = wanted.sparkSession.sparkContext.broadcast(self)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            store, path = _opened(index.folder)
            heads = [p[:2] for p in index.parts]
            part, blocks, starts = -1, [], []
            last, turn, taken = None, 0, 0
            for batch in batches:
                rows = []
                for key, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                    raw = key.encode()
                    # Captures like the first of a part can be at the end of the one before.
                    p = max(0, bisect.bisect_left(heads, (raw, low)) - 1)
                    while p < len(heads) and (heads[p] <= (raw, high)):
                        if p != part:
                            part, blocks = p, index.directory(store, path, p)
                            starts = [b[:2] for b in blocks]
                        b = max(0, bisect.bisect_left(starts, (raw, low)) - 1)
                        while b < len(blocks) and starts[b] <= (raw, high):
                            block = (index.parts[p][2], blocks[b][2])
                            # So many wanted keys of a block go to one task, the next to another.
                            if block != last:
                                last, taken, turn = block, 0, TaskContext.get().partitionId() << 32
                            elif taken == TURN:
                                taken, turn = 0, turn + 1
                            taken += 1
                            rows.append((*block, blocks[b][3], turn, key, low, high))
                            b += 1
                        p += 1
                yield _batch(rows, _WANTED)

        parts = shuffle_partitions(wanted.sparkSession)
        ordered = wanted.repartitionByRange(parts, "key", "low").sortWithinPartitions("key", "low")
        return ordered.mapInArrow(search, "file string, at bigint, size bigint, turn bigint, key string, low bigint, high bigint")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Captures ``(key, id, file, at, size)`` of the keys in ``wanted``.

        ``wanted`` has ``key`` (see ``url_key``) and may have ``low`` and ``high``,
        which bound the page id. Equal rows count once.
        """
        if "low" not in wanted.columns:
            wanted = wanted.select("key", F.lit(-(2**63)).alias("low"), F.lit(NO_ID).alias("high"))
        wanted = wanted.select("key", "low", "high").where(F.col("key").isNotNull()).distinct()
        sent = wanted.sparkSession.sparkContext.broadcast(self)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            store, path = _opened(index.folder)
            block, lines, places = None, [], []
            for batch in batches:
                rows = []
                for name, at, size, _, key, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                    if (name, at) != block:
                        with store.open_input_file(f"{path}/index/{name}") as file:
                            lines = _lines(file.read_at(size, at))
                        block, places = (name, at), [line[:2] for line in lines]
                    raw = key.encode()
                    a, b = bisect.bisect_left(places, (raw, low)), bisect.bisect_right(places, (raw, high))
                    rows += [(key, *line[1:]) for line in lines[a:b]]
                yield _batch(rows, _CAPTURE)

        parts = shuffle_partitions(wanted.sparkSession)
        dealt = self.blocks(wanted).repartition(parts, "file", "at", "turn")
        return dealt.sortWithinPartitions("file", "at", "key", "low").mapInArrow(fetch, CAPTURE)


_WANTED = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("turn", pa.int64()),
    ("key", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
])


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> CaptureIndex:
    """Sort captures into blocks and store them, their directories and the table of parts."""
    spark = captures.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        store.create_dir(f"{path}/index", recursive=True)
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out, at, blocks = None, 0, []
        while lines := list(itertools.islice(rows, block)):
            if out is None:
                name = _file_name("index") + ".cdx.gz"
                out = store.open_output_stream(f"{path}/index/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            text = "".join("\t".join(map(str, line)) + "\n" for line in lines).encode()
            packed = packer.compress(text) + packer.flush()
            out.write(packed)
            blocks.append({"key": lines[0][0].encode(), "id": lines[0][1], "at": at, "size": len(packed)})
            at += len(packed)
        if out is None:
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DIRECTORY) as stream:
            stream.write_table(pa.Table.from_pylist(blocks, _DIRECTORY))
        out.write(sink.getvalue())
        out.close()
        part = {"key": blocks[0]["key"], "id": blocks[0]["id"], "file": name, "at": at, "size": sink.getvalue().size}
        yield pa.RecordBatch.from_pylist([part], _PART)

    order = ("key", "id", "file", "at")
    sorted_captures = captures.select(*order, "size").repartitionByRange(shuffle_partitions(spark), *order)
    parts = sorted_captures.sortWithinPartitions(*order).mapInArrow(
        write, "key binary, id bigint, file string, at bigint, size bigint"
    )
    parts.write.parquet(f"{folder}/parts")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> CaptureIndex:
    """An index that ``build_index`` stored; reads a row per part."""
    rows = spark.read.parquet(f"{folder}/parts").collect()
    return CaptureIndex(folder, sorted((bytes(r["key"]), r["id"], r["file"], r["at"], r["size"]) for r in rows))


def archive_pages(pages: DataFrame, folder: str, block: int = BLOCK) -> CaptureIndex:
    """Write the archives of ``pages`` and their index into a new folder."""
    return build_index(write_archives(pages, folder), folder, block)


def op11(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/captures-{uuid.uuid4()}"
    index = archive_pages(pages, folder)
    page = F.coalesce("page_id", F.lit(NO_ID))
    wanted = pages.select(url_key(F.col("url")).alias("key"), page.alias("low"), page.alias("high"))
    records = read_records(index.lookup(wanted), folder)
    # What is there is measured; of a revisit there is only what its headers say.
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("bigint"), "stated_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "stated_digest").alias("payload_digest"),
        "record_type", "refers_to",
    )


OP11_SQL = """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), firsts AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY body) END AS first FROM payloads
)
SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts
"""
