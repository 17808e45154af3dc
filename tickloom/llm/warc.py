"""WARC files: write and read records, and a Merkle audit of replicas: hash records and ordered offset ranges, compare
roots, go down where they differ."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, quoted, read_table, scratch
from .word_hashes import turns

#: Children of a node.
FANOUT = 16
#: Records of a segment file, about; a segment is one tree.
SEGMENT_RECORDS = 1024
_CHUNK, _HEAD = 1 << 20, 1 << 14
_MAGIC = b"\x1f\x8b\x08"
_ID = re.compile(rb"\r\nWARC-Record-ID: *<urn:page:([^>\r]*)>", re.I)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, record binary): each page as a WARC/1.0 resource record.

    Null url or body count as empty, and a null id is written as "null".
    """
    body = F.coalesce(quoted(body_col), F.lit("")).cast("binary")
    ident = F.coalesce(quoted(id_col).cast("string"), F.lit("null"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(quoted(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(quoted(id_col).alias("id"), F.coalesce(quoted(url_col), F.lit("")).alias("url"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def write_warc(records: DataFrame, folder: str, segments: int) -> DataFrame:
    """Write records(id, record) as files of gzip members, a record each, in `folder`; (segment, path, n_records) of them.

    Records go to segments by the hash of their bytes, so no host or key makes a segment large. In a segment they lie in
    the order of (id, hash), null ids first. A task writes its segments one after another, as streams, each under a name of its
    own that is then changed: a task that runs again leaves whole files. The folder must be one that executors share.
    """
    rows = records.select("id", "record", F.sha2("record", 256).alias("hash")).withColumn("segment", _segment(segments))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                made = pa.array([_member(x.as_py()) for x in batch.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2), batch.column(3)], names=batch.schema.names)

    # compressed, records take less of the shuffle, too
    rows = rows.mapInArrow(squeeze, rows.schema).repartition(max(1, min(segments, max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments // 64))), "segment")
    rows = rows.sortWithinPartitions("segment", F.col("id").asc_nulls_first(), "hash").select("segment", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        attempt, now, out, made = TaskContext.get().taskAttemptId(), None, None, []

        def end() -> None:
            if out is not None:
                out.close()
                system.move(f"{base}/{_name(now)}.{attempt}.tmp", f"{base}/{_name(now)}")

        for batch in batches:
            for segment, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    end()
                    now, out = segment, system.open_output_stream(f"{base}/{_name(segment)}.{attempt}.tmp", compression=None)
                    made.append([segment, f"{folder}/{_name(segment)}", 0])
                out.write(record.as_py())
                made[-1][2] += 1
        end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["segment", "path", "n_records"])

    return cut(rows.mapInArrow(run, "segment int, path string, n_records long"))


def _segment(segments: int) -> Column:
    return F.pmod(_number("hash", 1), F.lit(segments)).cast("int")


def _name(segment: int) -> str:
    return f"segment-{segment:09d}.warc.gz"


def _member(record: bytes) -> bytes:
    made = zlib.compressobj(4, wbits=31)
    return made.compress(record) + made.flush()


class Member:
    """A record as it was read: where it starts in the file, its first bytes, its length and hash."""

    __slots__ = ("at", "head", "length", "digest", "parts")

    def __init__(self, at: int):
        self.at, self.head, self.length, self.digest, self.parts = at, b"", 0, hashlib.sha256(), []


def members(source, keep: bool = False) -> Iterator[Member]:
    """The records of an open file of gzip members, streamed; with keep, their bytes too. Of a member that is spoilt as far as can be
    read; then the next start of a record is looked for."""
    data, read = b"", 0

    def more() -> bytes:
        nonlocal read
        got = source.read(_CHUNK)
        read += len(got)
        return got

    data = more()
    if data and not data.startswith(_MAGIC) and data.startswith(b"WARC/"):
        raise ValueError("a WARC file that isn't compressed record by record")
    while data or (data := more()):
        one, unpack = Member(read - len(data)), zlib.decompressobj(31)
        try:
            while not unpack.eof:
                if not data and not (data := more()):
                    raise zlib.error("ends early")
                out = unpack.decompress(data, _CHUNK)
                data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                one.digest.update(out)
                one.length += len(out)
                if len(one.head) < _HEAD:
                    one.head += out[: _HEAD - len(one.head)]
                if keep:
                    one.parts.append(out)
        except zlib.error:
            at = one.at + 1 - (read - len(data))
            at = max(at, 1 if read - len(data) == one.at else 0)
            while not _starts(data, at := data.find(_MAGIC, at)):
                if at < 0:
                    if not (got := more()):
                        data = b""
                        break
                    data = data[-2:] + got
                    at = 0
                else:
                    at += 1
            else:
                data = data[at:]
        yield one


def _starts(data: bytes, at: int) -> bool:
    """Whether a record starts there."""
    if at < 0:
        return False
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/"
    except zlib.error:
        return False


def read_warc(files: DataFrame) -> DataFrame:
    """(segment, ordinal, id, offset, length, hash, file_offset) of every record of files(segment, path).

    offset and length count a record's own bytes, hash is their SHA-256; file_offset is where the compressed record starts.
    A task reads a file as a stream, and no record is held whole. id is the number of 64 bits that the record's name holds, or null. Files are
    gzip members of a record each, as write_warc() makes them; a file that starts otherwise raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = filesystem(path)
                rows, offset = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for n, one in enumerate(members(source)):
                        found = _ID.search(one.head.split(b"\r\n\r\n", 1)[0])
                        ident = int(found[1]) if found and re.fullmatch(rb"-?[0-9]{1,19}", found[1]) else None
                        ident = ident if ident is not None and -(1 << 63) <= ident < 1 << 63 else None
                        rows.append((segment, n, ident, offset, one.length, one.digest.hexdigest(), one.at))
                        offset += one.length
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return files.select("segment", "path").mapInArrow(run, "segment int, ordinal int, id long, offset long, length long, hash string, file_offset long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["segment", "ordinal", "id", "offset", "length", "hash", "file_offset"])


def spoilt_copy(files: DataFrame, folder: str) -> DataFrame:
    """Copies of files(segment, path) with damage, to try an audit on: about one record in 199, told by its hash, is lost, and in one
    in 61 the last bit of the middle byte is turned over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for segment, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/{_name(segment)}.{TaskContext.get().taskAttemptId()}.tmp"
                here, name = filesystem(path)
                with here.open_input_stream(name, compression=None) as source, system.open_output_stream(part, compression=None) as out:
                    for one in members(source, keep=True):
                        digest, record = one.digest.hexdigest(), bytearray(b"".join(one.parts))
                        if int(digest[16:24], 16) % 199 == 0:
                            continue
                        if int(digest[8:16], 16) % 61 == 0:
                            record[len(record) // 2 - 1] ^= 1
                        out.write(_member(bytes(record)))
                system.move(part, f"{base}/{_name(segment)}")
                yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "path": [f"{folder}/{_name(segment)}"]})

    return cut(files.select("segment", "path").mapInArrow(run, "segment int, path string"))


def place_records(hashed: DataFrame, *, segments: int) -> DataFrame:
    """hashed(id, length, hash, ...) with segment, ordinal and offset: where each record lies.

    Records go to segments by the hash of their bytes, so no host or key makes a segment large. In a
    segment they lie in the order of (id, hash), null ids first. Only ids, lengths and hashes move.
    """
    base = hashed.withColumn("segment", _segment(segments))
    w = Window.partitionBy("segment").orderBy(F.col("id").asc_nulls_first(), "hash")
    return base.withColumns({"ordinal": F.row_number().over(w) - 1, "offset": F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))})


def _number(digest: str, at: int) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def _node(children: Column) -> Column:
    return F.sha2(children.cast("binary"), 256)


def merkle_levels(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """The trees of leaves(segment, ordinal, offset, length, hash) as rows (segment, level, node,
    start, end, hash).

    A level-0 hash covers offset, length and content of a record; a node's hash covers its children's in
    order with the range of bytes they span. One small group per node; a level is an aggregate of the one
    below, and the last has one node for each segment: its root.
    """
    leaf = F.sha2(F.concat_ws(":", F.col("offset"), F.col("length"), "hash").cast("binary"), 256)
    level = leaves.select("segment", F.lit(0).alias("level"), F.col("ordinal").cast("long").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash"))
    all_levels, k = level, 0
    while k < depth:  # the depth is logarithmic in the largest segment's records
        kids = F.sort_array(F.collect_list(F.struct("node", "hash")))
        k += 1
        level = level.groupBy("segment", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.min("start").alias("start"), F.max("end").alias("end"), kids.alias("kids"))
        level = level.select("segment", F.lit(k).alias("level"), F.col("parent").alias("node"), "start", "end", _node(F.concat_ws(":", F.col("start"), F.col("end"), F.array_join(F.col("kids.hash"), ","))).alias("hash"))
        all_levels = all_levels.unionByName(level)
    return all_levels


def depth_for(most: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node covers `most` leaves."""
    depth, span = 1, fanout
    while span < most:
        depth, span = depth + 1, span * fanout
    return depth


def audit(here: DataFrame, there: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas differ: (segment, ordinal, id, offset, length, hash, other_ordinal, other_hash, status).

    here, there: (segment, ordinal, id, offset, length, hash) as read_warc and place_records give them. The roots of
    all segments are compared; only children of nodes that differ are joined on the level below,
    down to the records; each level is written before the next. Records of ranges that differ are paired in their segment: by id and content first,
    then by id, then by offset. status: "damaged" (another hash), "moved" (the same content in
    another range), "missing" or "added" (without a partner; an added record has null ordinal and hash).
    Both trees have the same depth, that of the largest segment.
    Equal replicas give no row, as do empty ones. A segment that only one side has differs at its root. Null ids are ids.
    """
    most = here.unionByName(there, allowMissingColumns=True).agg(F.max("ordinal")).first()[0]
    depth = depth_for((most or 0) + 1, fanout)
    trees = [cut(merkle_levels(x, depth, fanout)) for x in (here, there)]
    a, b = trees
    names = lambda t, s: t.select("segment", "node", F.col("hash").alias(s))
    differs = None
    for k in range(depth, -1, -1):
        x, y = (names(t.where(F.col("level") == k), s) for t, s in ((a, "h1"), (b, "h2")))
        if differs is not None:
            up = differs.select("segment", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(up, ["segment", "up"], "left_semi").drop("up") for t in (x, y))
        differs = cut(x.join(y, ["segment", "node"], "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select("segment", "node"))
    bad = differs.select("segment", F.col("node").cast("int").alias("ordinal"))
    fields = ("segment", "ordinal", "id", "offset", "length", "hash")
    left, right = (cut(t.select(*fields).join(bad, ["segment", "ordinal"], "left_semi")) for t in (here, there))
    pairs = []
    for by in (("id", "hash"), ("id",), ("offset",)):
        x, y = (t.withColumn("nth", F.row_number().over(Window.partitionBy("segment", *by).orderBy("ordinal"))) for t in (left, right))
        y = y.select(*(F.col(c).alias(f"other_{c}") for c in (*fields, "nth")))
        same = [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in ("segment", *by, "nth")]
        one = same[0]
        for c in same[1:]:
            one = one & c
        found = cut(x.join(y, one).drop("nth", "other_nth"))
        pairs.append(found)
        left = cut(left.join(found.select("segment", "ordinal"), ["segment", "ordinal"], "left_anti"))
        right = cut(right.join(found.select("segment", F.col("other_ordinal").alias("ordinal")), ["segment", "ordinal"], "left_anti"))
    both = pairs[0].unionByName(pairs[1]).unionByName(pairs[2])
    status = F.when(F.col("hash") == F.col("other_hash"), "moved").otherwise("damaged")
    shown = both.select(*fields, "other_ordinal", "other_hash", status.alias("status"))
    none = F.lit(None)
    lost = left.select(*fields, none.cast("int").alias("other_ordinal"), none.cast("string").alias("other_hash"), F.lit("missing").alias("status"))
    new = right.select("segment", none.cast("int").alias("ordinal"), "id", "offset", "length", none.cast("string").alias("hash"), F.col("ordinal").alias("other_ordinal"), F.col("hash").alias("other_hash"), F.lit("added").alias("status"))
    return shown.unionByName(lost).unionByName(new)


def op9_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files, which are audited against a replica with damage (spoilt_copy); both are read back from their
    files. A row for each page."""
    records = warc_records(read_table(spark, sf_dir, "pages"))
    segments = max(1, -(-records.count() // SEGMENT_RECORDS))
    files = write_warc(records, scratch(spark, "warc"), segments)
    replica = spoilt_copy(files, scratch(spark, "replica"))
    here, there = cut(read_warc(files)), cut(read_warc(replica))
    found = audit(here, there).where(F.col("ordinal").isNotNull()).select("segment", "ordinal", "status", "other_hash")
    out = here.join(found, ["segment", "ordinal"], "left")
    other = F.when(F.col("status").isNull(), F.col("hash")).otherwise(F.col("other_hash"))
    return out.select(F.col("id").alias("page_id"), "segment", "ordinal", "offset", "length", F.col("hash").alias("record_sha256"), other.alias("replica_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


OP9_SQL = r"""
WITH made AS (
  SELECT page_id, hex(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS h
  FROM pages
), hashed AS (
  SELECT page_id, h, length(h) // 2 AS length, length(h) // 4 AS middle, sha256(unhex(h)) AS record_sha256 FROM made
), placed AS (
  SELECT *, (('0x' || substr(record_sha256, 1, 8))::BIGINT % greatest(1, (SELECT (count(*) + 1023) // 1024 FROM pages)))::INTEGER AS segment,
    ('0x' || substr(record_sha256, 17, 8))::BIGINT % 199 = 0 AS lost,
    CASE WHEN ('0x' || substr(record_sha256, 9, 8))::BIGINT % 61 = 0
         THEN sha256(unhex(substr(h, 1, 2 * middle - 1) || translate(substr(h, 2 * middle, 1), '0123456789ABCDEF', '1032547698BADCFE') || substr(h, 2 * middle + 1)))
         ELSE record_sha256 END AS replica_sha256
  FROM hashed
)
SELECT page_id, segment,
  (row_number() OVER w - 1)::INTEGER AS ordinal,
  coalesce(sum(length) OVER (PARTITION BY segment ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, record_sha256, CASE WHEN NOT lost THEN replica_sha256 END AS replica_sha256,
  CASE WHEN lost THEN 'missing' WHEN record_sha256 <> replica_sha256 THEN 'damaged'
       WHEN coalesce(bool_or(lost) OVER (PARTITION BY segment ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'moved' ELSE 'intact' END AS status
FROM placed WINDOW w AS (PARTITION BY segment ORDER BY page_id NULLS FIRST, record_sha256)
"""
