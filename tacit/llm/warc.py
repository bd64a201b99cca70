"""WARC archives: writing pages with revisits, and reading with boundary-chain verification.

A reader that starts in the middle of a file finds records by their magic, but a payload may hold
the magic too.  So every task lists candidates, each with the offset at which the next record
must begin if it is real.  Pointer jumping from the start of a file keeps the candidates that the
chain of real records reaches.  Tasks first shorten the chains inside their own block, so the
number of rounds grows with the logarithm of the blocks of a file, not of its records.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tacit.scratch import materialize, release, scope, scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
# Bytes of file per join bucket when payloads are gathered.
BUCKET = 1 << 20
ID = "urn:page:"
_END = re.compile(rb"\r\n\r\n")

CANDIDATE = (
    "file string, block long, rel long, size long, valid boolean, complete boolean, "
    "length long, type string, page_id long, refers_to long, uri string, "
    "payload_bytes long, payload_digest string"
)
FIELDS = [part.split()[0] for part in CANDIDATE.split(", ")]
TYPES = {
    "string": pa.string(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
}
ARROW = pa.schema([(n, TYPES[t]) for n, t in (part.split() for part in CANDIDATE.split(", "))])


def write(
    pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT, date: str = DATE
) -> str:
    """Write a record per row of ``(page_id, url, html)``; returns the folder.

    Of equal payloads of at least ``least`` bytes, rows with the largest page_id become response
    records and the others revisits of it (a null id is the smallest).  Null html is an empty
    payload, a null url gives no target.  Repeated rows become records each.  Only revisits are
    looked up while writing, so payloads are not shuffled unless there are very many of them.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    with scope() as made:
        _write(pages, path, least, date)
    release(made)
    return path


def _write(pages: DataFrame, path: str, least: int, date: str) -> None:
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    sized = rows.select(
        "*",
        F.sha1("payload").alias("sha"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    # A second, unrelated hash, as SHA-1 alone can be made to collide.
    key = ["sha", "bytes", "hash"]
    narrow = sized.where(F.col("bytes") >= least).select(
        "page_id", "sha", "bytes", F.xxhash64("payload").alias("hash")
    )
    groups = materialize(
        narrow.groupBy(*key)
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-groups",
    )
    revisits = materialize(
        narrow.join(groups, key)
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to")
        .distinct(),
        "warc-revisits",
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha"))
    _records(sized.join(revisits, same, "left"), date).write.option("lineSep", GAP).text(path)


def _records(rows: DataFrame, date: str) -> DataFrame:
    """A record per row as text; the writer puts the gap behind each."""
    revisit = F.col("_sha").isNotNull()
    page = F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    # With its line end such a url would be the magic; readers strip the space.
    uri = F.when(uri.endswith(MAGIC.strip()), F.concat(uri, F.lit(" "))).otherwise(uri)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(GAP),
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        page,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha"),
        F.coalesce(
            F.concat(
                F.lit(f"\r\nWARC-Refers-To: <{ID}"),
                F.col("refers_to").cast("string"),
                F.lit(
                    ">\r\nWARC-Profile: "
                    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                ),
            ),
            F.lit(""),
        ),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(GAP),
        http,
    )
    # Bytes stay as they are in a cast from binary, whatever they encode.
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    return rows.select(F.concat(head, body).alias("value"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in file order within each block, with file and block."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _walk(batches):
    """(file, block, offset relative to the block's first chunk, chunk); None at a file's head."""
    place, at = None, 0
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2)
        for row, here in enumerate(zip(files, blocks)):
            if here != place:
                place, at = here, 0
            chunk = memoryview(values[row].as_buffer())
            # Bytes ahead of the first magic belong to no record.
            yield here[0], here[1], at, chunk, here[1] == 0 and at == 0
            at += len(chunk) + len(MAGIC)


def parse_head(chunk: bytes | memoryview) -> tuple[dict[str, str], int] | None:
    """Header fields of a record that begins behind its magic, and their length with the gap.

    The whole chunk is searched for the end of the header, as fields have no greatest length.
    """
    end = _END.search(chunk)
    if end is None:
        return None
    fields = {}
    for line in bytes(chunk[: end.start()]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal():
        return None
    return fields, end.end()


def _page(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(ID)
    return int(digits) if digits.lstrip("-").isdecimal() else None


def _payload(block: memoryview) -> tuple[dict[str, str], memoryview]:
    """HTTP fields and payload of a record block."""
    end = _END.search(block)
    if end is None:
        return {}, block[len(block) :]
    head = bytes(block[: end.start()])
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    fields = {a.strip().lower().decode("latin-1"): b.strip().decode("latin-1") for a, _, b in lines}
    return fields, block[end.end() :]


def _content(fields: dict[str, str], block: memoryview) -> tuple[int | None, str | None]:
    """Length and digest of the full payload: of a revisit as stated, else of the bytes read."""
    http, payload = _payload(block)
    if fields.get("warc-type") == "revisit":
        stated = http.get("content-length", "")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        return int(stated) if stated.isdecimal() else None, digest or None
    return len(payload), hashlib.sha1(payload).hexdigest()


def _candidates(batches):
    rows: list[tuple] = []
    held = 0
    for file, block, at, chunk, outside in _walk(batches):
        parsed = None if outside else parse_head(chunk)
        row = [file, block, at - len(MAGIC), len(chunk) + len(MAGIC)]
        if parsed is None:
            row += [False, False, *[None] * 7]
        else:
            fields, skip = parsed
            size = int(fields["content-length"])
            complete = len(chunk) >= skip + size
            row += [
                True,
                complete,
                len(MAGIC) + skip + size + len(GAP),
                fields.get("warc-type"),
                _page(fields.get("warc-record-id")),
                _page(fields.get("warc-refers-to")),
                fields.get("warc-target-uri"),
                *(_content(fields, chunk[skip : skip + size]) if complete else (None, None)),
            ]
        rows.append(tuple(row))
        held += 1
        if held == 5000:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in ARROW]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _bases(candidates: DataFrame) -> DataFrame:
    """Where the chunks of each block begin and end in their file: they follow without holes."""
    sums = candidates.groupBy("file", "block").agg(F.sum("size").alias("_sum"))
    over = Window.partitionBy("file").orderBy("block")
    sums = sums.withColumn("_past", F.sum("_sum").over(over))
    return sums.select("file", "block", (F.col("_past") - F.col("_sum")).alias("_base"), "_past")


def records(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The verified records of all archives in a folder.

    ``(file, start, length, type, page_id, refers_to, uri, payload_bytes, payload_digest)``: type
    is response or revisit; bytes and digest (bare lower-case hex) are of the full payload.  The
    chain begins at offset 0 of a file and ends at its end or where no record follows; what lies
    behind such a break is not returned, nor is a last record cut short.  Empty files have no
    records.  With ``whole``, as for archives that ``write`` made, a chain that ends elsewhere
    than its file raises an error.
    """
    with scope() as made:
        found = _records_of(spark, path, whole)
    release(made, found)
    return found


def _check_ends(real: DataFrame, bases: DataFrame) -> None:
    """Raise an error unless the last record of each file ends where the file does."""
    # Places count from the first magic, which ends the first, empty chunk.
    ends = bases.groupBy("file").agg((F.max("_past") - len(MAGIC)).alias("_end"))
    last = real.groupBy("file").agg(F.max(F.col("start") + F.col("length")).alias("_last"))
    broken = ends.join(last, "file", "left").where(~F.col("_end").eqNullSafe(F.col("_last"))).first()
    if broken is not None:
        raise ValueError(
            f"records of {broken['file']} end at byte {broken['_last'] or 0} of {broken['_end']}"
        )


def _records_of(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    found = materialize(_chunks(spark, path).mapInArrow(_candidates, CANDIDATE), "warc-candidates")
    bases = materialize(_bases(found), "warc-blocks")
    placed = (
        found.join(bases, ["file", "block"])
        .withColumn("start", F.col("_base") + F.col("rel"))
        .where("valid")
        .withColumn("next", F.col("start") + F.col("length"))
        .drop("_base", "_past", "rel", "valid")
    )
    links = placed.select("file", "block", "start", "next")
    entries = materialize(_reached(links, bases), "warc-entries")
    kept = links.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(
        _mark, "file string, start long"
    )
    real = placed.join(kept, ["file", "start"])
    columns = ["file", "start", "length", "type", "page_id", "refers_to", "uri"]
    columns += ["payload_bytes", "payload_digest"]
    real = materialize(real.select(*columns, "complete"), "warc-records")
    if whole:
        _check_ends(real, bases)
    complete = real.where("complete").select(*columns)
    split = real.where("not complete")
    if split.isEmpty():
        return complete
    return complete.unionByName(_rejoined(spark, path, split, bases).select(*columns))


def _exits(table):
    """Candidates of a block with the offset at which their chain leaves it."""
    start = table.column("start").to_numpy()
    order = np.argsort(start)
    start = start[order]
    onward = table.column("next").to_numpy()[order]
    at = np.searchsorted(start, onward)
    inside = (at < len(start)) & (start[np.minimum(at, len(start) - 1)] == onward)
    jump = np.where(inside, at, np.arange(len(start)))
    while True:  # pointer jumping to the last candidate of each chain
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return pa.table(
        {
            "file": table.column("file").take(pa.array(order)),
            "start": pa.array(start),
            "next": pa.array(onward[jump]),
        }
    )


def _reached(links: DataFrame, bases: DataFrame) -> DataFrame:
    """Where the chain of each file enters its blocks, by pointer jumping over blocks."""
    schema = "file string, start long, next long"
    jumps = materialize(links.groupBy("file", "block").applyInArrow(_exits, schema), "warc-jumps")
    blocks = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = links.where("start = 0").select("file", "start")
    span = 1
    while span < blocks:
        step = reached.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = materialize(reached.unionByName(step).distinct(), "warc-reached")
        span *= 2
        if span < blocks:
            far = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("_far"))
            jumps = materialize(
                jumps.join(far, ["file", "next"], "left").select(
                    "file", "start", F.coalesce("_far", "next").alias("next")
                ),
                "warc-jumps",
            )
    return links.join(reached, ["file", "start"]).select("file", "block", "start")


def _mark(links, entries):
    """The candidates that the chain visits in one block."""
    if not entries.num_rows or not links.num_rows:
        return pa.table({"file": pa.array([], pa.string()), "start": pa.array([], pa.int64())})
    onward = dict(zip(links.column("start").to_pylist(), links.column("next").to_pylist()))
    at, seen = min(entries.column("start").to_pylist()), []
    while at in onward:
        seen.append(at)
        at = onward[at]
    file = links.column("file")[0].as_py()
    return pa.table({"file": pa.array([file] * len(seen), pa.string()), "start": pa.array(seen)})


def _rejoined(spark: SparkSession, path: str, split: DataFrame, bases: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their chunks are gathered and read as one."""
    schema = "file string, block long, rel long, chunk binary"

    def work(batches):
        for file, block, at, chunk, _ in _walk(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file]),
                    pa.array([block], pa.int64()),
                    pa.array([at - len(MAGIC)], pa.int64()),
                    pa.array([bytes(chunk)], pa.binary()),
                ],
                names=["file", "block", "rel", "chunk"],
            )

    chunks = (
        _chunks(spark, path)
        .mapInArrow(work, schema)
        .join(bases, ["file", "block"])
        .select("file", (F.col("_base") + F.col("rel")).alias("_at"), "chunk")
        .withColumn("_bucket", F.floor(F.col("_at") / BUCKET))
    )
    end = F.col("start") + F.col("length")
    spans = split.select(
        *split.columns,
        F.explode(
            F.sequence(F.floor(F.col("start") / BUCKET), F.floor((end - 1) / BUCKET))
        ).alias("_bucket"),
    )
    parts = spans.join(chunks, ["file", "_bucket"]).where(
        (F.col("_at") >= F.col("start")) & (F.col("_at") < end)
    )
    keys = ["file", "start", "length", "type", "page_id", "refers_to", "uri"]
    fields = ", ".join(p for p in CANDIDATE.split(", ") if p.split()[0] in (*keys, "file"))
    types = dict(part.split() for part in fields.split(", "))
    out = ", ".join(f"{k} {types.get(k, 'long')}" for k in keys)

    def join(table):
        table = table.sort_by("_at")
        chunk = MAGIC.encode().join(bytes(c.as_buffer()) for c in table.column("chunk"))
        length = table.column("length")[0].as_py()
        parsed = parse_head(chunk)
        if len(MAGIC) + len(chunk) < length - len(GAP) or parsed is None:
            size, digest = None, None
        else:
            head, skip = parsed
            body = memoryview(chunk)[skip : length - len(MAGIC) - len(GAP)]
            size, digest = _content(head, body)
        made = table.select(keys).slice(0, 1)
        made = made.append_column("payload_bytes", pa.array([size], pa.int64()))
        return made.append_column("payload_digest", pa.array([digest], pa.string()))

    whole = parts.groupBy("file", "start").applyInArrow(
        join, f"{out}, payload_bytes long, payload_digest string"
    )
    # A record that its file cuts short has no payload.
    return whole.where(F.col("payload_digest").isNotNull())
