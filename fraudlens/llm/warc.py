"""WARC archives: a shard writer with revisits and a splittable reader
(operator 10).

Writing: of records with equal payloads of at least ``min_revisit`` bytes the
one with the largest id is a response and the others revisit it; smaller
payloads are always responses. Each record is one gzip member. A task streams
its rows into one archive and renames it into place when it is whole, so a
repeated task replaces its own archive and a lost one leaves nothing that the
manifest names.

Reading: archives are cut into byte ranges of ``split_bytes``. The task of a
range scans it for gzip magic, validates a candidate by inflating its first
bytes and finding a WARC header, and owns every record that starts inside the
range, reading past the range's end where the last record does. Inside an
archive the next candidate is looked for after the member just read.

Files are opened with pyarrow's file systems by the URI of the shared folder,
so that folder may be any store that these reach. Only the folder that this
module writes is opened so; input tables are read by Spark.

Defined results: null payloads are empty; null ids are written as ``-`` and
read as null; repeated rows are separate records (rows that share the largest
id are all responses); archives with no records are empty files and read as
no rows.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm.common import ship, written
from fraudlens.session import scratch_path

ship(__name__)

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Archive bytes of a reading task once there are more ranges than
#: ``spark.sql.shuffle.partitions``.
TASK_BYTES = 128 << 20
#: Enough of a member to inflate the version line.
PROBE = 512


def store(uri: str):
    """(file system, path) of a URI or a plain local path."""
    from pyarrow import fs
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """One row per page: page_id, url, payload, payload_digest, refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    big = F.octet_length("payload") >= min_revisit
    # digests alone are shuffled; the rows meet the list of repeated ones, which
    # is small where repeats are few and joined by digest where it is not
    copied = written(rows.where(big).groupBy("payload_digest", F.octet_length("payload").alias("size"))
                     .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
                     .where((F.col("n") > 1) & F.col("holder").isNotNull()).drop("n")
                     .withColumnRenamed("payload_digest", "digest"), "repeated")
    paired = join_small(rows, copied, "payload_digest", "digest", "size")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    return paired.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"),
                         F.octet_length("payload").cast("long").alias("payload_bytes"),
                         "payload_digest", refers.alias("refers_to"))


#: Repeated digests up to which their list goes to every task (8 MB).
SMALL_ROWS, SALTS = 100_000, 64


def join_small(rows: DataFrame, copied: DataFrame, mine: str, digest: str, size: str) -> DataFrame:
    """Rows left-joined to the counted list of repeated digests: broadcast up
    to ``SMALL_ROWS``, so payloads stay where they are; beyond that by digest,
    a digest's rows dealt over salts, as one body may be a third of the rows."""
    same = (F.col(mine) == F.col(digest)) & (F.octet_length("payload") == F.col(size))
    if copied.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(copied), same, "left")
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("own_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("own_salt") == F.col("salt")), "left")


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda n: f"<urn:page:{'-' if n is None else n}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", name(page_id)),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Full-Payload-Length", str(size))]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = payload or b""
    head.append(("Content-Length", str(len(body))))
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(text + body + b"\r\n\r\n") + member.flush()


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task; the manifest (path, records, bytes)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, base = store(folder)
        path = f"{base}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{path}.{task.taskAttemptId()}"
        n = size = 0
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    member = record(row["page_id"], row["url"], row["payload"],
                                    row["payload_bytes"], row["payload_digest"], row["refers_to"])
                    out.write(member)
                    n, size = n + 1, size + len(member)
        fs.move(draft, path)
        yield pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": [n],
                                          "bytes": [size]})

    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    return written(plan.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def splits(manifest: DataFrame, split_bytes: int) -> DataFrame:
    """(path, start, end) of every byte range, dealt over as many tasks as there
    are ranges, or as ``TASK_BYTES`` asks for if that is fewer. The number is
    given, as Spark would put rows of a few bytes into one task."""
    cut = (manifest.where(F.col("bytes") > 0)
           .select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1,
                                                         F.lit(split_bytes).cast("long"))).alias("start"))
           .select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end")))
    total, found = manifest.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / split_bytes))).first()
    least = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(int(found or 0), max(least, (total or 0) // TASK_BYTES)))
    return cut.repartitionByRange(tasks, "path", "start")


class Window:
    """A view of a file that moves forward, held as one bounded buffer."""

    def __init__(self, file, size: int, chunk: int):
        self.file, self.size, self.chunk = file, size, chunk
        self.data, self.at = b"", 0

    def need(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes from the absolute offset."""
        if not self.at <= offset <= offset + n <= self.at + len(self.data):
            if self.at + len(self.data) < self.size or offset < self.at:
                self.file.seek(offset)
                self.data, self.at = self.file.read(max(self.chunk, n)), offset
        skip = offset - self.at
        return self.data[skip:skip + n]


def members(file, size: int, start: int, end: int, piece_bytes: int = 1 << 14,
            chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that start in [start, end)."""
    view, at = Window(file, size, chunk), start
    while at < end:
        seen = view.need(at, piece_bytes)
        hit = seen.find(MAGIC)
        if hit < 0:
            if len(seen) < len(MAGIC) or at + len(seen) >= size:
                return
            at += len(seen) - len(MAGIC) + 1
            continue
        at += hit
        if at >= end:
            return
        try:
            valid = zlib.decompressobj(31).decompress(view.need(at, PROBE), len(VERSION)) == VERSION
        except zlib.error:
            valid = False
        if not valid:
            at += 1
            continue
        inflate, parts, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            piece = view.need(pos, piece_bytes)
            if not piece:
                raise OSError(f"archive ends inside the record at {at}")
            parts.append(inflate.decompress(piece))
            pos += len(piece)
        yield at, b"".join(parts)
        at = pos - len(inflate.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


RECORD = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, path string, position long")


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = 8 << 20,
                  payloads: bool = True) -> DataFrame:
    """One row per record. For responses, length and digest are those of the
    payload as read, for revisits those that the record tells."""
    def ident(urn: str | None):
        return None if urn in (None, "<urn:page:->") else int(urn[len("<urn:page:"):-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("path", pa.string()), ("position", pa.int64())])
        rows, held = [], 0
        for batch in batches:
            for cut in batch.to_pylist():
                name = f"{base}/{cut['path']}"
                size = fs.get_file_info(name).size
                with fs.open_input_file(name) as file:
                    for at, data in members(file, size, cut["start"], cut["end"]):
                        f, body = parse(data)
                        whole = f["WARC-Type"] != "revisit"
                        rows.append({
                            "page_id": ident(f["WARC-Record-ID"]), "url": f.get("WARC-Target-URI"),
                            "payload": body if payloads and whole else None,
                            "payload_bytes": len(body) if whole else int(f["WARC-Full-Payload-Length"]),
                            "payload_digest": hashlib.sha1(body).hexdigest() if whole
                            else f["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "record_type": f["WARC-Type"], "refers_to": ident(f.get("WARC-Refers-To")),
                            "path": cut["path"], "position": at})
                        held += len(body) if payloads else 0
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return splits(manifest, split_bytes).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
               min_revisit: int = 1000, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Pages written as archives to the shared folder and read back."""
    spark: SparkSession = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(plan_records(pages, id_col, payload_col, min_revisit), folder)
    return read_archives(manifest, folder, split_bytes, payloads)
