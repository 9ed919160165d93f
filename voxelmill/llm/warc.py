"""Deterministic sharded WARC writer and reader.

Records are ordered by id and, within one, by a hash of their content; a shard is a range of that order with about
``shard_bytes`` of payload, cut at exact running sums, so what it holds, and every file's bytes, follow from the rows
alone and not from the cluster. Sparse ids share shards, and a null or repeated id is cut like any other; only rows that
are equal throughout stay together. The sums are taken over ids, hashes and sizes; the cuts (two numbers for each
``shard_bytes``) go to all tasks. One shuffle brings a shard's rows together; inside it they are sorted and written as one
gzip member each, with regenerated HTTP and WARC headers and digests; a file is closed once its compressed size reaches
``roll_bytes``. Files are written under temporary names and moved to their own, the shard's manifest last; a retried or
doubled task makes the same bytes again and leaves those that stand. The list of files is the job's result, written as the
whole archive's manifest. Each write has a version's folder of its own, numbered on from those that are there: readers
take the last version whose manifest is whole, and only then do the folders before it go.

Equal payloads of at least ``min_revisit_bytes`` are stored once: the least id is the response, others revisit it (rows
that share that least id are responses all). Payloads are compared by SHA-1, found by a partial aggregate and a join
over ids and digests alone, which adaptive execution can split at a hot digest.

Null html is an empty payload, a null url a urn of the record. Rows without an id come first and never name a response.
Ids are whole numbers (others fail when they are cast). Repeated rows are written each. An empty table writes no file and
reads as no rows; what a folder held before goes. Further columns are ignored. The folder must be one
that ``pyarrow.fs`` opens from every executor: a shared mount, S3, GCS, or HDFS with its native library.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.session import materialize

SHARD_BYTES, ROLL_BYTES, LEVEL, DATE, READ_BYTES, PIECE = 32 << 20, 64 << 20, 6, "1970-01-01T00:00:00Z", 16 << 20, 16 << 10
FILES = "shard long, path string, records long, bytes long, sha1 string"
_LINES = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(key.encode()).digest(), version=3)}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or the revisit of another record's payload."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = _LINES.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    headers = [("WARC-Record-ID", record_id(f"{page_id} {own}")), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + own)]
    if page_id is not None:
        headers.append(("WARC-X-Page-ID", str(page_id)))
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"{refers_to} {own}")), ("WARC-X-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", headers, http)


class _ShardWriter:
    """Rolling files of one shard, each moved to its name when whole."""

    def __init__(self, root: str, version: str, shard: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.root, self.version = f"{self.root}/{version}", version
        self.shard, self.roll_bytes, self.done, self.out = shard, roll_bytes, [], None
        self.attempt = uuid.uuid4().hex
        for d in ("data", "manifest", "_tmp"):
            self.fs.create_dir(f"{self.root}/{d}", recursive=True)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:010d}-{len(self.done):05d}.warc.gz"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(f"{self.root}/_tmp/{self.attempt}-{self.name}", compression=None), 0, 0, hashlib.sha1()
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: voxelmill\r\nformat: WARC File Format 1.1\r\n"))
        self._put(raw)
        self.n += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, raw: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self._settle(f"{self.root}/_tmp/{self.attempt}-{self.name}", f"{self.root}/data/{self.name}")
            self.done.append({"shard": self.shard, "path": f"{self.version}/data/{self.name}", "records": self.n, "bytes": self.size, "sha1": self.sha.hexdigest()})

    def commit(self) -> list[dict]:
        self.close()
        tmp = f"{self.root}/_tmp/{self.attempt}.json"
        with self.fs.open_output_stream(tmp) as f:
            f.write("".join(json.dumps(x) + "\n" for x in self.done).encode())
        self._settle(tmp, f"{self.root}/manifest/shard-{self.shard:010d}.json")
        return self.done

    def _settle(self, tmp: str, name: str) -> None:
        """Move to the own name. Some file systems refuse where another attempt's file stands: it has the same bytes."""
        try:
            self.fs.move(tmp, name)
        except OSError:
            if self.fs.get_file_info(name).size != self.fs.get_file_info(tmp).size:
                raise
            self.fs.delete_file(tmp)


def versions(root: str) -> tuple[list[str], list[str]]:
    """All versions below ``root``, and those whose manifest is whole, ascending."""
    fs, base = pafs.FileSystem.from_uri(root)
    listed = lambda d: sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(d, allow_not_found=True)) if f.base_name.startswith("version-"))
    known = listed(f"{base}/_manifest")
    return sorted({*listed(base), *known}), [v for v in known if fs.get_file_info(f"{base}/_manifest/{v}/_SUCCESS").type == pafs.FileType.File]


def shard_cuts(light: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First (id, tie) of every shard but the first, from rows ``id, tie, size``: exact running sums over range partitions."""
    keys = light.groupBy("id", "tie").agg(F.sum("size").alias("size"))
    ranged = materialize(keys.repartitionByRange("id", "tie").withColumn("part", F.spark_partition_id()), "warc-keys")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("whole"))
    before = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("before"))  # a row a partition
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("id", "tie")) + F.col("before")
    summed = ranged.join(F.broadcast(before), "part").withColumn("upto", upto)
    shard = lambda c: F.floor(c / shard_bytes)
    crossed = summed.withColumn("n", shard(F.col("upto") - F.col("size"))).withColumn("last", F.lag("n").over(Window.partitionBy("part").orderBy("id", "tie")))
    first = F.coalesce(F.col("last"), shard(F.col("before") - F.lit(1)))
    cuts = crossed.filter((F.col("n") > first) & (F.col("upto") > F.col("size"))).select("id", "tie").orderBy("id", "tie").toArrow()
    return cuts["id"].to_numpy(), cuts["tie"].to_numpy()


def shard_column(id: Column, tie: Column, cuts: tuple[np.ndarray, np.ndarray]) -> Column:
    """Number of cuts at or before (id, tie)."""
    at_id, at_tie = cuts

    @F.arrow_udf("long")
    def warc_shard(ids: pa.Array, ties: pa.Array) -> pa.Array:
        i, t = ids.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(at_id, i, "left"), np.searchsorted(at_id, i, "right")
        for k in np.flatnonzero(high > low):
            low[k] += np.searchsorted(at_tie[low[k] : high[k]], t[k], "right")
        return pa.array(low, pa.int64())

    return warc_shard(id, tie)


def write_archives(df: DataFrame, root: str, page_id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``df`` below ``root`` (a URI) and return the manifest: one row per file. Runs the job. One writer a root at a time."""
    spark = df.sparkSession
    before = versions(root)[0]
    version = f"version-{int(before[-1].rpartition('-')[2]) + 1 if before else 1:010d}"
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    place, tie = F.coalesce(F.col("id"), F.lit(-(1 << 63)).cast("long")), F.xxhash64(F.col(url), F.col(html))
    base = df.select(F.col(page_id).cast("long").alias("id"), tie.alias("tie"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # ids, hashes and sizes alone; the payloads are read once more, to be written
    light = materialize(df.select(F.col(page_id).cast("long").alias("id"), tie.alias("tie"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size")), "warc-light")
    cuts = shard_cuts(light.select(place.alias("id"), "tie", (F.col("size") + 512).alias("size")), shard_bytes)
    shard = shard_column(place, F.col("tie"), cuts).alias("shard")
    rows = base.select("id", "url", "html", shard)
    marks = light.filter(F.col("size") >= min_revisit_bytes)
    firsts = marks.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    again = marks.join(firsts, "sha").filter("first is not null and (id is null or id > first)").select(shard, "id", "sha", "first")

    def write(key, pages: pa.Table, revisits: pa.Table) -> pa.Table:
        refers = {(i, s): f for i, s, f in zip(*(revisits[c].to_pylist() for c in ("id", "sha", "first")))}
        ids, urls = pages["id"].to_pylist(), pages["url"].to_pylist()
        text = pages["html"].combine_chunks() if pages["html"].num_chunks != 1 else pages["html"].chunk(0)
        ties = len(set(ids)) < len(ids)
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, *((urls[k] or "", text[k].as_py()) if ties else ())))
        out = _ShardWriter(root, version, key[0].as_py(), roll_bytes)
        for k in order:
            data = text[k].as_py().encode()
            out.add(page_record(ids[k], urls[k], data, refers.get((ids[k], hashlib.sha1(data).hexdigest()))))
        files = out.commit() if order else []
        return pa.Table.from_pylist(files, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    files = rows.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(write, FILES)
    files.write.json(f"{root}/_manifest/{version}")
    fs, folder = pafs.FileSystem.from_uri(root)
    for gone in (*(f"{folder}/{kind}{v}" for v in before for kind in ("_manifest/", "")), f"{folder}/{version}/_tmp"):
        if fs.get_file_info(gone).type == pafs.FileType.Directory:
            fs.delete_dir(gone)
    return spark.read.schema(FILES).json(f"{root}/_manifest/{version}")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of a file, member by member."""
    rest, start = memoryview(data), 0
    while start < len(rest):
        # piece by piece: what lies behind a member is copied when it ends
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if start >= len(rest):
                raise ValueError("a member of the archive ends early")
            piece = rest[start : start + PIECE]
            parts.append(z.decompress(piece))
            start += len(piece) - len(z.unused_data)
        raw, at = b"".join(parts), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode().split("\r\n")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers["content-length"])
            yield headers, raw[end + 4 : end + 4 + size]
            at = end + 8 + size


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the committed files: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, html`` (null for
    revisits). Blocks and payloads are held against their digests."""

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])

    def row(h: dict[str, str], block: bytes) -> dict:
        if h["warc-block-digest"] != "sha1:" + digest(block):
            raise ValueError(f"{h['warc-record-id']}: the block does not have its digest")
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        whole = h["warc-type"] == "response"
        if whole and (len(payload) != length or h["warc-payload-digest"] != "sha1:" + digest(payload)):
            raise ValueError(f"{h['warc-record-id']}: the payload does not have its digest")
        number = lambda k: int(h[k]) if k in h else None
        return {"page_id": number("warc-x-page-id"), "url": h["warc-target-uri"], "record_type": h["warc-type"], "refers_to": number("warc-x-refers-to-page-id"), "payload_bytes": length, "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "html": payload.decode() if whole else None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                out, held = [], 0
                for h, block in parse_records(data.as_py()):
                    if h["warc-type"] != "warcinfo":
                        out.append(row(h, block))
                        held += len(block)
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, kinds)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    whole = versions(root)[1]
    if not whole:
        raise FileNotFoundError(f"{root} holds no whole archive")
    paths = [f"{root}/{r.path}" for r in spark.read.schema(FILES).json(f"{root}/_manifest/{whole[-1]}").select("path").collect()]  # as many as files that Spark lists
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(read, schema)


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda k: f"substr('{alphabet}', ((v >> {15 - 5 * k}) & 31)::int + 1, 1)"
    chars = " || ".join(part(k) for k in range(4))
    groups = " || ".join(f"(select {chars} from (select ('0x' || substr(sha, {1 + 5 * k}, 5))::bigint as v))" for k in range(8))
    return (
        "with p as materialized (select page_id, sha1(coalesce(html, '')) as sha, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),"
        " f as (select *, min(page_id) over (partition by sha) as first from p)"
        f" select page_id, payload_bytes, {groups} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to from f"
    )
