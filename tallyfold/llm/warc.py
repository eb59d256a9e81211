"""Operator 1: a deterministic, sharded WARC writer and its reader.

Records are range-sorted by page_id and digest and dealt to shards at bounds that follow from exact
counts of payload bytes (no sampling), so the shards, and all bytes of the archive, follow from the
rows alone, whatever the partitions are. Each shard has its own files, rolled by compressed size;
every record is a gzip member of its own, with headers and digests regenerated from the payload. A file is written under a temporary name that carries the attempt and takes its
final name when it is whole; a retried or speculative task writes the same bytes to the same final
name. The manifest (one row per file: name, records, bytes, SHA-256) is written last and is what
readers go by, so files of a lost attempt are never read.

Defined results: null html is an empty payload; payloads below `least` bytes are never revisits;
of equal payloads the smallest page_id is the response (null ids sort first in the files; rows with
a null id are all responses when the group has no other id, since nothing can refer to them); repeated rows with one id and payload are one response and
revisits after it; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, table

#: Payloads of fewer bytes are always written out.
LEAST = 100
LEVEL = 4
#: A table has about SPREAD shards, each of between the two sizes in payload bytes, until SHARDS of the larger don't hold it.
SPREAD, LEAST_SHARD, SHARD_BYTES, SHARDS = 64, 1 << 20, 64 << 20, 16_384
#: A file is closed once its compressed size reaches this part of its shard's payload bytes, but not below the least.
ROLLS, LEAST_ROLL = 16, 64 << 10
#: Bins of one step of the search for the shards' bounds.
BINS = 1024
#: Headers carry a fixed date: the bytes of an archive follow from its input alone.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, first_id long, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def filesystem(path: str):
    """pyarrow's filesystem for any URI or local path, with the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}") if "file:///" not in path else (fs.LocalFileSystem(), path.removeprefix("file://"))


def _line(text: object) -> str:
    return "" if text is None else "".join(" " if c in "\r\n" else c for c in str(text))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block but the digest of the payload it refers to."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    block = b"" if revisit else payload
    name = f"{page_id}-{digest}" + f"-{refers_to}" * revisit
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """The open file of a shard."""

    def __init__(self, base: str, shard: str, attempt: int, roll_bytes: int):
        self.fs, self.root = filesystem(base)
        self.shard, self.attempt, self.roll = shard, attempt, roll_bytes
        self.index, self.out = 0, None

    def add(self, page_id: int | None, raw: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard}-{self.index:05d}.warc.gz"
            self.temp = f"{self.root}/_tmp-{self.attempt}-{self.name}"
            self.out, self.sha, self.n, self.size, self.first = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, page_id
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.n, self.size = self.n + 1, self.size + len(member)
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            yield self.name, self.first, self.n, self.size, self.sha.hexdigest()
            self.index, self.out = self.index + 1, None


def _writer(base: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        roller, now = None, None
        done: list[tuple] = []
        mark: tuple | None = None  # (page_id, digest, refers_to) of the marker before its rows
        for batch in batches:
            for shard, page_id, url, html, digest, refers, kind in batch.itertuples(index=False, name=None):
                if shard != now:
                    if roller is not None:
                        done += roller.close()
                    now, roller, mark = shard, _Roller(base, shard, context.taskAttemptId(), roll_bytes), None
                page_id = None if pd.isna(page_id) else int(page_id)
                if kind == 0:
                    mark = (page_id, digest, None if pd.isna(refers) else int(refers))
                    continue
                target, first = None, False
                if mark is not None and mark[:2] == (page_id, digest):
                    first = mark[2] == page_id or mark[2] is None
                    target = None if first else mark[2]
                    if first:  # later rows with this id and payload revisit it
                        mark = (page_id, digest, page_id) if page_id is None else (page_id, digest, -1 - page_id)
                    elif mark[2] is not None and page_id is not None and mark[2] == -1 - page_id:
                        target = page_id
                done += roller.add(page_id, record(page_id, url, html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b"", target))
        if roller is not None:
            done += roller.close()
        yield pd.DataFrame(done, columns=["file", "first_id", "records", "bytes", "sha256"]).astype({"first_id": "Int64"})

    return write


def shard_cuts(sizes: DataFrame, shard_bytes: int) -> tuple[int, int, list[list[int]], list[tuple[int | None, int]]]:
    """lowest id, width of a bin, cuts in each of up to BINS bins, and (id, sub-shards) of ids above a shard's bytes; of sizes (page_id, size).

    Exact counts by bins of ids; bins above the size are counted again in BINS finer ones. What the
    driver gets is a count for each bin: BINS, and as many again for each bin above a shard's bytes.
    """
    known = sizes.where("page_id IS NOT NULL")
    low, high = known.agg(F.min("page_id"), F.max("page_id")).first()
    nulls = sizes.where("page_id IS NULL").agg(F.sum("size")).first()[0] or 0
    hot = [(None, -(-nulls // shard_bytes))] if nulls > shard_bytes else []
    if low is None:
        return 0, 1, [[]], hot
    whole = high - low + 1
    first = -(-whole // BINS)
    open_, leaves = [low], {}
    while open_:
        width = -(-whole // BINS)
        starts = "array(" + ", ".join(f"{x}L" for x in sorted(open_)) + ")"
        within = known.withColumn("s", F.expr(f"get({starts}, size(filter({starts}, x -> x <= page_id)) - 1)").cast("decimal(20,0)"))
        within = within.where(f"s IS NOT NULL AND CAST(page_id AS decimal(20,0)) - s < {whole}")
        got = within.groupBy(F.expr(f"CAST(s + floor((CAST(page_id AS decimal(20,0)) - s) / {width}) * {width} AS bigint)").alias("b")).agg(F.sum("size").alias("n")).collect()
        over = {r[0]: r[1] for r in got if r[1] > shard_bytes}
        if width == 1:
            hot += [(k, -(-n // shard_bytes)) for k, n in sorted(over.items())]
            over = {}
        leaves |= {r[0]: r[1] for r in got if r[0] not in over}
        open_, whole = list(over), width
    cuts: list[list[int]] = [[] for _ in range(-(-(high - low + 1) // first))]
    held = 0
    for k, n in sorted(leaves.items()):
        if held and held + n > shard_bytes:
            cuts[(k - low) // first].append(k)
            held = 0
        held += n
    return low, first, cuts, hot


def sizes_for(total: int) -> tuple[int, int]:
    """Payload bytes of a shard and compressed bytes of a file, of a table's payload bytes alone: nothing of the cluster enters."""
    shard = max(min(SHARD_BYTES, max(LEAST_SHARD, total // SPREAD)), -(-total // SHARDS))
    return shard, max(LEAST_ROLL, shard // ROLLS)


def with_shard(rows: DataFrame, low: int, width: int, cuts: list[list[int]], hot: list[tuple[int | None, int]]) -> DataFrame:
    """rows with their shard, as text that sorts like the ids; null ids come first.

    The bounds are a table of at most BINS rows, one for each bin with its cuts, the ids with
    several shards another; both hold about SHARDS numbers at most and are broadcast.
    """
    spark = rows.sparkSession
    before, n = [], 1
    for c in cuts:
        before.append(n)
        n += len(c)
    bounds = spark.createDataFrame(list(zip(range(len(cuts)), before, cuts, strict=True)), "_bin int, _before int, _cuts array<bigint>")
    crowded = spark.createDataFrame([(k, min(m, 4096)) for k, m in hot], "_hot long, _parts int")
    place = F.expr(f"CAST(floor((CAST(page_id AS decimal(20,0)) - {low}) / {width}) AS int)")
    placed = rows.join(F.broadcast(bounds), place == F.col("_bin"), "left").join(F.broadcast(crowded), F.col("page_id").eqNullSafe(F.col("_hot")) & F.col("_parts").isNotNull(), "left")
    number = F.expr("CASE WHEN page_id IS NULL THEN 0 ELSE _before + size(filter(_cuts, c -> c <= page_id)) END")
    sub = F.expr("CAST(floor(CAST(conv(substr(digest, 1, 3), 16, 10) AS int) * coalesce(_parts, 1) / 4096) AS int)")
    return placed.withColumn("shard", F.format_string("%06d-%04d", number, sub)).select(*rows.columns, "shard")


def write_warc(
    pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, roll_bytes: int | None = None, shard_bytes: int | None = None
) -> DataFrame:
    """Writes the archive below base and returns its manifest, which is written there as well.

    Only (id, digest) pairs meet in the search for copies; markers of the groups with several rows
    then travel beside the payloads, which are shuffled once, by shard. A hot digest is reduced on
    the map side and its join can be split by AQE; an id with more than a shard's bytes is spread by
    digest. Sizes that aren't given follow from the table's bytes. There are as many tasks as shards.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    keys = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = keys.join(groups, "digest").groupBy("page_id", "digest").agg(F.max("refers").alias("refers"))
    marked = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers", F.lit(0).alias("kind"))
    full = rows.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers"), F.lit(1).alias("kind"))
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)
    sizes = rows.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + 500).cast("long").alias("size"))
    own = sizes_for(sizes.agg(F.sum("size")).first()[0] or 0)
    shard_bytes, roll_bytes = shard_bytes or own[0], roll_bytes or own[1]
    low, width, cuts, hot = shard_cuts(sizes, shard_bytes)
    tasks = min(SHARDS, 1 + sum(map(len, cuts)) + sum(min(m, 4096) for _, m in hot))
    sorted_rows = (
        with_shard(marked.unionByName(full), low, width, cuts, hot)
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .select("shard", "page_id", "url", "html", "digest", "refers", "kind")
    )
    sorted_rows.mapInPandas(_writer(base, roll_bytes), MANIFEST).write.mode("overwrite").parquet(f"{base}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    return headers, rest[: int(headers["content-length"])]


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        data = data or stream.read(size)


def _reader(base: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(base)
        for batch in batches:
            for name in batch["file"]:
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        h, block = parse(raw)
                        digest, revisit = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"] == "revisit"
                        if not revisit and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload doesn't have its digest")
                        rows.append((h.get("x-page-id"), h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], h.get("x-refers-to-page-id")))
                        if len(rows) >= 5000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([None if v is None else int(v) for v in out[c]], "Int64")
    return out.astype({"payload_bytes": "int64"})


def read_warc(spark: SparkSession, base: str) -> DataFrame:
    """The records of the files that the manifest of base names; payloads are checked against their digests."""
    files = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest").select("file")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000)).mapInPandas(_reader(base), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Scratch(spark, "warc").path
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), base)
    return read_warc(spark, base)


SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY h)
SELECT p.page_id, p.url, octet_length(p.b) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN g.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first_id < p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
