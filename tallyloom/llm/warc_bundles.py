"""WARC archives as seekable Zstandard bundles: independent frames, a seek table as footer, and an index by record."""

import base64
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import if_small, keep, shared_path, small_batches

#: Numbers of the public seekable format (fixed values): the skippable frame's, and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("frame_at", T.LongType()),
    T.StructField("frame_bytes", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def _open(path: str):
    """The file system that holds a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _name(record_id) -> str:
    return "<urn:page:>" if record_id is None else f"<urn:page:{quote(str(record_id), safe='')}>"


def record(record_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or where it refers to another record a revisit without."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _name(record_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head["X-Payload-Length"] = str(len(payload))
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head["Content-Type"] = "application/http; msgtype=response"
    else:
        block = b""
        head |= {"WARC-Refers-To": _name(refers_to), "WARC-Profile": REVISIT}
    head["Content-Length"] = str(len(block))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: memoryview) -> Iterator[dict]:
    """The records of a frame's contents, as written by ``record``; payloads are None for revisits."""
    import hashlib

    at, whole = 0, bytes(raw)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in whole[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block, at = whole[end + 4 : end + 4 + size], end + 4 + size + 4
        name = lambda k: unquote(head[k][10:-1]) if k in head and head[k] != "<urn:page:>" else None
        kept = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
        payload = None
        if head["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(payload).hexdigest() != kept:
                raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
        url = unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
        yield {"record_id": name("WARC-Record-ID"), "record_type": head["WARC-Type"], "refers_to": name("WARC-Refers-To"), "url": url, "payload_bytes": int(head["X-Payload-Length"]) if payload is None else len(payload), "payload_digest": kept, "payload": payload}


class Bundle:
    """A file of frames under way; each frame is compressed alone, and ``close`` appends the seek table."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.path, (system, inner) = path, _open(path)
        self.out, self.packer = system.open_output_stream(inner, compression=None), zstandard.ZstdCompressor(level=level)
        self.at, self.sizes = 0, []

    def frame(self, raw: bytes) -> tuple[int, int, int]:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw)))
        self.at += len(packed)
        return len(self.sizes) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, bytes, bytes unpacked) of each frame of an open bundle, from its footer."""
    file.seek(file.size() - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width, out, at = 12 if flags & 0x80 else 8, [], 0
    file.seek(file.size() - 9 - width * frames)
    table = file.read(width * frames)
    for n in range(frames):
        packed, raw = struct.unpack_from("<II", table, n * width)
        out.append((at, packed, raw))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a WARC record into bundles under ``folder``; gives the index: where each record is.

    Of records with equal payloads of ``revisit_from`` bytes or more the one with the largest
    id holds the payload, the others are revisits that refer to it. Each partition writes its
    own bundles, named by task attempt: a bundle that no index row names is of a lost attempt
    and no part of the archive. A frame closes at ``frame_bytes``, a bundle at ``bundle_bytes``.

    Nulls: a null page is an empty payload, a null URL is left out, a null id makes a record
    without a name, never referred to. Rows that repeat are all written; those that bear the
    largest id of their group are all responses. An empty table writes nothing.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "same": F.when(F.octet_length("payload") >= revisit_from, F.sha2("payload", 256))})
    groups = keep(rows.filter("same is not null").groupBy("same").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("same", "first"), "payloads")
    groups = if_small(groups)  # beyond its size pages are shuffled to the groups
    rows = rows.join(groups, "same", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    arrow = to_arrow_schema(INDEX)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, bundle = TaskContext.get(), 0, None
        held: list[tuple[str, bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal bundle, count, held
            if bundle is None:
                bundle, count = Bundle(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst"), count + 1
            frame, start, size = bundle.frame(b"".join(x for _, x in held))
            out, at = [], 0
            for name, x in held:
                out.append((name, bundle.path, frame, start, size, at, len(x)))
                at += len(x)
            held = []
            if bundle.at >= bundle_bytes:
                bundle.close()
                bundle = None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        waiting = 0
        for batch in batches:
            for id_, url, body, digest, refers_to in zip(*batch.to_pydict().values(), strict=True):
                held.append((None if id_ is None else str(id_), record(id_, url, body, digest, refers_to, date)))
                waiting += len(held[-1][1])
                if waiting >= frame_bytes:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()
        if bundle is not None:
            bundle.close()

    with small_batches(pages.sparkSession):
        return keep(rows.mapInArrow(step, INDEX), "warc-index")


def read_bundles(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that the index names, frame by frame, each payload checked against its digest."""
    arrow, n = to_arrow_schema(RECORDS), index.rdd.getNumPartitions()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _open(path)
                with system.open_input_file(inner) as file:
                    for start, packed, raw in seek_table(file):
                        file.seek(start)
                        found = list(parse(memoryview(zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw))))
                        yield pa.RecordBatch.from_pylist(found if with_payload else [r | {"payload": None} for r in found], schema=arrow)

    return index.select("bundle").distinct().repartition(max(1, n)).mapInArrow(step, RECORDS)


def fetch_records(index: DataFrame) -> DataFrame:
    """The records of some index rows: each task seeks to the frames its rows name, and unpacks no others."""
    arrow = to_arrow_schema(RECORDS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                system, inner = _open(row["bundle"])
                with system.open_input_file(inner) as file:
                    file.seek(row["frame_at"])
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(row["frame_bytes"]))
                yield pa.RecordBatch.from_pylist(list(parse(memoryview(raw)[row["offset"] : row["offset"] + row["length"]])), schema=arrow)

    return index.mapInArrow(step, RECORDS)


def archive_digest(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back, and tell what each record says."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    system, inner = _open(folder)
    system.create_dir(inner, recursive=True)
    index = write_bundles(pages, folder, id_col, **options)
    kind = pages.schema[id_col].dataType
    found = read_bundles(spark, index, with_payload=False)
    return found.select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
