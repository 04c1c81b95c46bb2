"""Operator 6, a deterministic sharded WARC writer, and the reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import cut, exact_groups, fresh_dir, small_batches, table

#: The date of all records, so that equal pages give equal bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part string, file string, records long, bytes long, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    """The same identifier whenever a page is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record with new headers. A revisit has the HTTP headers of its payload, but not the payload."""
    uri = "".join(c for c in url if c > " " and c != "\x7f") or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Page-ID", str(page_id)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # no name and no time in the header
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, at: str, roll_bytes: int = 32 << 20, min_revisit_bytes: int = 0, level: int = 6, partitions: int | None = None) -> DataFrame:
    """Writes one record per page below `at` (a folder URI that all executors share) and returns the manifest's rows.

    Payload groups come from hashes of the payloads alone; a revisit's payload doesn't move. Records are range-sorted by page_id, then
    payload hash; each task writes its range in order and begins a new file when the compressed one would exceed `roll_bytes`. A file is
    written under a temporary name of its attempt; a task that is tried again leaves other temporary names, never a half file under a final
    name. The tasks' rows, once checkpointed, are the manifest; the driver then gives the files of exactly these rows their final names,
    and writes MANIFEST.jsonl last: without it the folder isn't an archive. Bounded: the manifest has a row per file.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("hash"))
    keys = cut(base.select("page_id", "hash", F.octet_length("payload").cast("long").alias("size")))
    grouped = exact_groups(keys.filter(F.col("size") >= min_revisit_bytes).select("page_id", "hash"), "page_id", "hash")
    # Where a record refers is known from a row of its own that travels to the same range just before it: payloads move once.
    marks = grouped.filter((F.col("page_id") != F.col("keep_id"))).select("page_id", "hash", F.lit(0).alias("kind"), F.col("keep_id").alias("refers_to")).distinct()
    rows = base.select("page_id", "hash", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload").unionByName(marks, allowMissingColumns=True)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, "page_id", "hash").sortWithinPartitions("page_id", "hash", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(at)
        part, out, k = f"{ctx.partitionId():06d}", [], 0
        sink = name = None
        refers: tuple = ()
        n_rec = n_bytes = 0
        seen = hashlib.sha256()

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                out.append((part, name, n_rec, n_bytes, seen.hexdigest()))
                sink = None

        for b in batches:
            for r in b.itertuples(index=False):
                page = None if pd.isna(r.page_id) else int(r.page_id)
                if r.kind == 0:
                    refers = (page, r.hash, int(r.refers_to))
                    continue
                ref = refers[2] if refers[:2] == (page, r.hash) else None
                data = _gzip(record(page, r.url, r.payload, len(r.payload), base32_sha1(r.payload), ref), level)
                if sink is not None and n_bytes + len(data) > roll_bytes:
                    close()
                if sink is None:
                    name, k = f"tmp-{uuid.uuid4().hex}-pages-{part}-{k:05d}.warc.gz", k + 1
                    sink, n_rec, n_bytes, seen = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, hashlib.sha256()
                sink.write(data)
                seen.update(data)
                n_rec, n_bytes = n_rec + 1, n_bytes + len(data)
        close()
        yield pd.DataFrame(out, columns=["part", "file", "records", "bytes", "sha256"])

    fs_, root = fs.FileSystem.from_uri(at)
    fs_.create_dir(root, recursive=True)
    # Checkpointed: the files named here are those of the tasks that succeeded.
    done = sorted(cut(ranged.mapInPandas(run, MANIFEST)).collect())
    rows = []
    for r in done:
        final = r["file"].split("-", 2)[2]
        fs_.move(f"{root}/{r['file']}", f"{root}/{final}")
        rows.append((r["part"], final, r["records"], r["bytes"], r["sha256"]))
    with fs_.open_output_stream(f"{root}/tmp-MANIFEST.jsonl", compression=None) as f:
        f.write("".join(json.dumps(dict(zip(("part", "file", "records", "bytes", "sha256"), r, strict=True))) + "\n" for r in rows).encode())
    fs_.move(f"{root}/tmp-MANIFEST.jsonl", f"{root}/MANIFEST.jsonl")
    for info in fs_.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith("tmp-"):
            fs_.delete_file(info.path)
    return spark.createDataFrame(rows, MANIFEST)


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    z, parts, buf = zlib.decompressobj(31), [], b""
    while True:
        buf = buf or stream.read(block)
        if not buf:
            break
        parts.append(z.decompress(buf))
        buf = b""
        if z.eof:
            yield b"".join(parts)
            buf, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict:
    """Headers and block of one record; digests are held against the bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"headers": headers, "payload": payload, "size": size}


def read_archives(spark: SparkSession, at: str, with_payload: bool = False) -> DataFrame:
    """All records of a committed folder: page_id, payload_bytes, payload_digest, record_type, refers_to (url and payload where asked for)."""
    store, root = fs.FileSystem.from_uri(at)
    with store.open_input_stream(f"{root}/MANIFEST.jsonl", compression=None) as f:
        files = [json.loads(x)["file"] for x in f.read().decode().splitlines()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, top = fs.FileSystem.from_uri(at)
        number = lambda x: None if x in (None, "None") else int(x)
        for b in batches:
            for name in b["file"]:
                rows: list[tuple] = []
                with here.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for data in members(f):
                        r = parse(data)
                        h = r["headers"]
                        rows.append((
                            number(h["X-Page-ID"]), r["size"], h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number(h.get("X-Refers-To-Page-ID")),
                            *([h["WARC-Target-URI"], r["payload"]] if with_payload else []),
                        ))
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.createDataFrame([(x,) for x in files], "file string")
    return listed.repartition(max(1, len(files))).mapInPandas(run, schema)


def warc_round_trip(pages: DataFrame, at: str, roll_bytes: int = 32 << 20, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives below `at` and returns their records as read back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload, null urls become
    urn:page: identifiers. Of equal payloads of at least `min_revisit_bytes` the largest page_id is the response. Pages with null
    ids are responses. Rows that repeat a page_id and payload are written each and share a type. An empty table gives an archive without files.
    """
    write_archives(pages, at, roll_bytes, min_revisit_bytes)
    return read_archives(pages.sparkSession, at)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc_round_trip(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))


#: The digest in base32: five hexadecimal digits are four characters.
OP6_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as keeper from pages
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
       if(page_id = keeper, 'response', 'revisit') as record_type, if(page_id = keeper, null, keeper) as refers_to
from p
"""
