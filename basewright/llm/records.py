"""Token ids as length-delimited binary records, with an offset index beside them.

A record is the public TFRecord framing: length of the payload (8 bytes), masked CRC-32C
of those bytes (4), payload, masked CRC-32C of the payload (4); all little-endian. The
payload is the document's ids, 2 bytes each where the vocabulary has up to 65,536
entries, else 4.

Texts are encoded where they are read, and their ids written as a step; only ids, about two
bytes a token, are sampled for the ranges, sent to them and sorted there. Each task then
writes one file in the shared folder, under a name of its own attempt, and returns one
index row per record. The index is written through Spark, which keeps the
rows of one attempt per task: files of failed attempts are never referred to, and a
lost executor takes nothing with it. Records are in ascending order of id (nulls first,
equal ids by text) over the files' numbers. `read_records` fetches the records of any
index rows, in any order, and checks both checksums.

Defined results: a null or empty text has the closing id only; repeated rows have a
record each; empty tables give an empty index and no file. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import new_path, written
from .frames import map_batches
from .pieces import id_encoder

#: Fixed values of the framing.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 64
HEADER, FOOTER = 12, 4
#: Rows encoded together at most; texts stay in Arrow there, and go by bytes (`pieces.BYTES_AT_ONCE`).
ROWS_ENCODED = 8192

INDEX = "id long, file int, path string, at long, n_bytes long, width int, n_tokens long, tokens_before long"


def _tables():
    """Byte tables: step of the CRC by one byte, and for each k shifts by 2^k zero bytes."""
    import numpy as np

    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(CASTAGNOLI), byte >> 1).astype(np.uint32)
    shifts = [np.stack([_step(byte, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])]
    for _ in range(47):
        shifts.append(np.stack([_shift(shifts[-1], shifts[-1][b]) for b in range(4)]))
    return byte, shifts


def _step(byte, crc):
    return byte[crc & 0xFF] ^ (crc >> 8)


def _shift(table, crc):
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


_cached_tables = cache(_tables)


def _shifted(shifts, crc, by):
    """Each CRC after as many zero bytes as `by` says."""
    import numpy as np

    k = 0
    while len(by) and (by >> k).any():
        crc = np.where((by >> k) & 1, _shift(shifts[k], crc), crc)
        k += 1
    return crc


def masked_crcs(parts: list[bytes]) -> list[int]:
    """Masked CRC-32C of each part, computed for all parts at once.

    Parts are cut into blocks, led by zeros, which leave a CRC that starts at 0
    unchanged. Block CRCs are moved by what follows them and joined by exclusive or.
    """
    import numpy as np

    if not parts:
        return []
    byte, shifts = _cached_tables()
    sizes = np.array([len(p) for p in parts], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(blocks)
    buffer = bytearray(int(ends[-1]) * BLOCK)
    for part, end, size in zip(parts, (ends * BLOCK).tolist(), sizes.tolist(), strict=True):
        buffer[end - size : end] = part
    grid = np.frombuffer(buffer, np.uint8).reshape(-1, BLOCK)
    crc = np.zeros(len(grid), np.uint32)
    for column in np.ascontiguousarray(grid.T):
        crc = _step(byte, crc ^ column)
    after = (np.repeat(ends, blocks) - 1 - np.arange(len(grid))) * BLOCK
    whole = np.bitwise_xor.reduceat(_shifted(shifts, crc, after), ends - blocks)
    whole ^= _shifted(shifts, np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes) ^ np.uint32(0xFFFFFFFF)
    rotated = (whole >> np.uint32(15)) | (whole << np.uint32(17))
    return ((rotated.astype(np.uint64) + MASK_DELTA) & 0xFFFFFFFF).tolist()


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    crcs = masked_crcs(lengths + payloads)
    n = len(payloads)
    return [
        length + struct.pack("<I", a) + payload + struct.pack("<I", b)
        for length, a, payload, b in zip(lengths, crcs[:n], payloads, crcs[n:], strict=True)
    ]


def unframed(records: list[bytes]) -> list[bytes]:
    """Payloads of whole records; a wrong length or checksum raises."""
    payloads = [r[HEADER:-FOOTER] for r in records]
    lengths = [r[:8] for r in records]
    crcs = masked_crcs(lengths + payloads)
    for i, r in enumerate(records):
        said = (struct.unpack("<I", r[8:HEADER])[0], struct.unpack("<I", r[-FOOTER:])[0])
        if struct.unpack("<Q", lengths[i])[0] != len(payloads[i]) or said != (crcs[i], crcs[len(records) + i]):
            raise ValueError(f"record {i} of the batch is damaged")
    return payloads


def _uri(path: str) -> str:
    """`path` by the scheme that pyarrow knows the store under."""
    scheme, sep, rest = path.partition("://")
    return f"s3://{rest}" if sep and scheme.lower() in ("s3a", "s3n") else path


def _filesystem(path: str):
    """The store a path is in, and the path there; plain paths are shared mounts."""
    from pyarrow import fs

    path = _uri(path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """`id`, `h` (a hash of the text), `width` and the payload `ids` of rows of `id`, `text`."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = id_encoder(vocabulary)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            ids = [x + end for x in encoder.encode_column(batch.column("text"))]
            rows = {"id": batch.column("id"), "h": batch.column("h"), "width": pa.array([width] * len(ids), pa.int32())}
            yield pa.RecordBatch.from_pydict(rows | {"ids": pa.array(ids, pa.binary())})

    return map_batches(docs.select("id", F.xxhash64("text").alias("h"), "text"), run, "id long, h long, width int, ids binary", ROWS_ENCODED)


def _writer(folder: str) -> Callable:
    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        task = TaskContext.get().partitionId()
        path = f"{folder}/part-{task:06d}-{uuid.uuid4().hex}.records"
        out, at, before = None, 0, 0
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    store, place = _filesystem(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                records = framed(batch.column("ids").to_pylist())
                sizes = np.array([len(r) for r in records], np.int64)
                tokens = (sizes - HEADER - FOOTER) // batch.column("width").to_numpy()
                out.write(b"".join(records))
                n, rows = len(records), {"id": batch.column("id")}
                rows |= {"file": pa.array([task] * n, pa.int32()), "path": pa.array([path] * n)}
                rows |= {"at": at + np.cumsum(sizes) - sizes, "n_bytes": sizes, "width": batch.column("width")}
                rows |= {"n_tokens": tokens, "tokens_before": before + np.cumsum(tokens) - tokens}
                at, before = at + int(sizes.sum()), before + int(tokens.sum())
                yield pa.RecordBatch.from_pydict(rows)
        finally:
            if out is not None:
                out.close()

    return write


def write_records(docs: DataFrame, vocabulary: str, end_id: int, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every document's ids and return the index, itself a written table.

    Index columns: `id`, `file` (number, in order), `path`, `at` and `n_bytes` (place of
    the whole record), `width` (bytes an id), `n_tokens`, `tokens_before` (in its file).
    """
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    ids = encoded(docs.select(F.col(row).cast("long").alias("id"), F.col(text).alias("text")), vocabulary, end_id)
    step = new_path(spark, "ids")
    ids.write.option("compression", "zstd").parquet(step)
    ordered = spark.read.schema(ids.schema).parquet(step).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    index = written(map_batches(ordered.select("id", "width", "ids"), _writer(folder), INDEX), "index")
    # Records and index are files by now: nothing reads the step again.
    place = spark._jvm.org.apache.hadoop.fs.Path(step)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return index


def with_starts(index: DataFrame) -> DataFrame:
    """`index` with `start`: ids of all records before it. Only a sum per file is brought together."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("in_files_before"))
    return index.join(files, "file").withColumn("start", F.col("tokens_before") + F.col("in_files_before")).drop("in_files_before")


def read_records(index: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """`rows(batch, payloads)` for each batch of index rows and their checked payloads.

    Works for index rows in any order; consecutive ones of a file are read through one handle.
    """

    def read(batches: Iterator) -> Iterator:
        opened, source = None, None
        for batch in batches:
            records = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n_bytes")), strict=True):
                if path != opened:
                    store, place = _filesystem(path)
                    source, opened = store.open_input_file(place), path
                records.append(source.read_at(n, at))
            yield rows(batch, unframed(records))

    return map_batches(index, read, schema)


def ids_of(payload: bytes, width: int):
    """The ids of a payload as unsigned 32-bit numbers."""
    import numpy as np

    return np.frombuffer(payload, "<u2" if width == 2 else "<u4").astype("<u4")


def token_rows(index: DataFrame) -> DataFrame:
    """`id`, `start` and `ids` of each record, read from the files."""

    def rows(batch, payloads):
        import pyarrow as pa

        widths = batch.column("width").to_pylist()
        ids = pa.array([ids_of(p, w).astype("int64") for p, w in zip(payloads, widths, strict=True)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "start": batch.column("start"), "ids": ids})

    return read_records(with_starts(index), "id long, start long, ids array<long>", rows)


def digests(index: DataFrame) -> DataFrame:
    """`id`, `start`, `n_tokens` and `ids_crc32` of each record, read from the files."""

    def rows(batch, payloads):
        import pyarrow as pa

        ids = [ids_of(p, w) for p, w in zip(payloads, batch.column("width").to_pylist(), strict=True)]
        got = {"id": batch.column("id"), "start": batch.column("start")}
        got |= {"n_tokens": pa.array([len(x) for x in ids], pa.int64())}
        return pa.RecordBatch.from_pydict(got | {"ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())})

    return read_records(with_starts(index), "id long, start long, n_tokens long, ids_crc32 long", rows)
