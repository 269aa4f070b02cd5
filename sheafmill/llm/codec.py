"""Token files: frequency-ranked ids, one to four bytes an id, with the byte counts in control bytes of their own.

An id becomes its rank by frequency over all documents (ties: the smaller id first), so frequent ids take one byte. Two bits
an id, four ids a control byte, hold how many bytes its rank takes; the ranks' bytes follow in one run. A reader looks
every control byte up in a table of 256 x 4 byte counts, sums them to positions, and gathers ranks and then ids with numpy.

A file is a run of blocks in ascending order of (key, hash of the ids); a file covers a range of these that no other file covers, so
a key that many rows share is as many files as it needs:

    "FRQB" | u32 documents | u64 ids | i64 keys | u8 key is null | u32 ids a document | control bytes | rank bytes

Beside the files lies ``ranks-*.bin``: the ids by rank, unsigned 32-bit. All numbers are little-endian. Files get names of their own for every attempt;
only those in the returned manifest count, so a lost or repeated task leaves at most a file that nobody reads.

Edge cases: null and empty texts are the end id alone; a null key sorts first; rows with equal keys follow in order of the hash of their ids; an empty table gives an empty manifest; other columns are not carried.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, materialise, qualified, scratch
from .tokens import default_tokenizer, encoder

MAGIC = b"FRQB"
#: Bytes of each of the four values that a control byte describes.
BYTES_OF = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
BLOCK_IDS = 1 << 20
#: Schemes of Spark paths, and what pyarrow calls them.
SCHEMES = [("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://"), ("dbfs:/", "/dbfs/")]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    n = len(ranks)
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    padded[:n] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(n, 4)[used]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    sizes = BYTES_OF[control].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        if len(longer):
            ranks[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def n_data_bytes(control: np.ndarray, n: int) -> int:
    return int(BYTES_OF[control].sum()) - (len(control) * 4 - n)


def _files(path: str):
    """The file system of a URI or local path, and the path in it. Hadoop's names of object stores are mapped to pyarrow's."""
    from pyarrow import fs

    for hadoop, own in SCHEMES:
        if path.startswith(hadoop):
            path = own + path[len(hadoop) :]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_block(out, keys: list, counts: list[int], ids: np.ndarray, rank_of: np.ndarray) -> None:
    control, data = encode_ranks(rank_of[ids])
    out.write(MAGIC + struct.pack("<IQ", len(keys), len(ids)))
    out.write(np.array([k or 0 for k in keys], dtype="<i8").tobytes() + np.array([k is None for k in keys], dtype=np.uint8).tobytes())
    out.write(np.array(counts, dtype="<u4").tobytes() + control + data)


def read_blocks(source, ids_by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, ids a document, ids) of each block."""
    while head := source.read(16):
        if head[:4] != MAGIC:
            raise ValueError("not a block")
        n_docs, n = struct.unpack("<IQ", head[4:])
        keys = np.frombuffer(source.read(8 * n_docs), dtype="<i8")
        null = np.frombuffer(source.read(n_docs), dtype=np.uint8)
        counts = np.frombuffer(source.read(4 * n_docs), dtype="<u4")
        control = np.frombuffer(source.read(-(-n // 4)), dtype=np.uint8)
        data = np.frombuffer(source.read(n_data_bytes(control, n)), dtype=np.uint8)
        yield [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts, ids_by_rank[decode_ranks(control, data, n)]


def tokenized(docs: DataFrame, text: str, key: str, tokenizer: str, end_id: int) -> DataFrame:
    """key, n_tokens and ids (as the vocabulary needs, 16 or 32 bits each, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x + end for x in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                counts = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, n_tokens long, ids binary")


def id_counts(coded: DataFrame, itemsize: int, vocab_size: int) -> np.ndarray:
    """How often each id occurs in all documents; every task sends its sums, the driver gets one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocab_size, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                joined = b"".join(batch.column(0).slice(at, 256).to_pylist())
                sums += np.bincount(np.frombuffer(joined, dtype=f"<u{itemsize}"), minlength=vocab_size)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["id", "n"])

    found = coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab_size, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(
    docs: DataFrame,
    path: str | None = None,
    text: str = "text",
    key: str = "doc_id",
    tokenizer: str | None = None,
    end_id: int = 0,
    file_ids: int = 8_000_000,
) -> DataFrame:
    """Write the files and return their manifest: first_key, first_hash, file, n_docs, n_tokens, file_bytes, ranks."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    enc = encoder(tokenizer)
    itemsize, vocab_size = enc.dtype.itemsize, max(enc.vocab_size, end_id + 1)
    with scratch(spark) as kept:
        coded = materialise(tokenized(docs, text, key, tokenizer, end_id), "token-ids")
        manifest = _write_files(coded, path, file_ids, itemsize, id_counts(coded, itemsize, vocab_size))
        kept.append(manifest)
    return manifest


def _write_files(coded: DataFrame, path: str | None, file_ids: int, itemsize: int, counts: np.ndarray) -> DataFrame:
    """The files of documents with their ids, in the order of their keys, and the manifest."""
    spark, vocab_size = coded.sparkSession, len(counts)
    by_rank = np.lexsort((np.arange(vocab_size), -counts)).astype("<u4")
    path = qualified(spark, path or fresh_path(spark, "token-files"))  # workers and Spark must mean the same file system
    filesystem, folder = _files(path)
    filesystem.create_dir(folder, recursive=True)
    ranks = f"{path}/ranks-{uuid.uuid4().hex}.bin"
    with filesystem.open_output_stream(_files(ranks)[1]) as out:
        out.write(by_rank.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = _files(ranks)
        with files.open_input_stream(where) as source:
            ids_by_rank = np.frombuffer(source.read(), dtype="<u4")
        rank_of = np.empty(len(ids_by_rank), dtype=np.uint32)
        rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
        out, keys, counts, held, size, total, n_docs, first, name = None, [], [], [], 0, 0, 0, (None, None), ""

        def flush() -> None:
            nonlocal keys, counts, held, size
            if keys:
                write_block(out, keys, counts, np.frombuffer(b"".join(held), dtype=f"<u{itemsize}"), rank_of)
                keys, counts, held, size = [], [], [], 0

        for batch in batches:
            for k, n, x, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    first, name = (k, h), f"{path}/ids-{uuid.uuid4().hex}.frqb"
                    out = files.open_output_stream(_files(name)[1])
                keys.append(k)
                counts.append(n)
                held.append(x)
                size, total, n_docs = size + n, total + n, n_docs + 1
                if size >= BLOCK_IDS:
                    flush()
        if out is not None:
            flush()
            out.close()
            stat = files.get_file_info(_files(name)[1])
            yield pa.RecordBatch.from_pylist([{"first_key": first[0], "first_hash": first[1], "file": name, "n_docs": n_docs, "n_tokens": total, "file_bytes": stat.size, "ranks": ranks}], schema=MANIFEST)

    n_files = max(1, int(-(-int(counts.sum()) // file_ids)))
    ordered = coded.withColumn("hash", F.xxhash64("ids")).repartitionByRange(n_files, "key", "hash").sortWithinPartitions("key", "hash")
    return materialise(ordered.mapInArrow(run, "first_key long, first_hash long, file string, n_docs long, n_tokens long, file_bytes long, ranks string"), "token-manifest")


MANIFEST = pa.schema([("first_key", pa.int64()), ("first_hash", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file_bytes", pa.int64()), ("ranks", pa.string())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), ids (unsigned 32-bit) as binary."""
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "first_hash", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, where = _files(ranks)
                with files.open_input_stream(where) as source:
                    ids_by_rank = np.frombuffer(source.read(), dtype="<u4")
                with files.open_input_stream(_files(name)[1]) as source:
                    for keys, counts, ids in read_blocks(source, ids_by_rank):
                        ends = np.cumsum(counts, dtype=np.int64)
                        begins = ends - counts
                        raw = ids.astype("<u4").tobytes()
                        for at in range(0, len(keys), 512):
                            span = range(at, min(at + 512, len(keys)))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([keys[i] for i in span], pa.int64()),
                                    pa.array(before + begins[at : at + 512], pa.int64()),
                                    pa.array([raw[4 * begins[i] : 4 * ends[i]] for i in span], pa.binary()),
                                ],
                                names=["key", "start", "ids"],
                            )
                        before += len(ids)

    n = max(1, manifest.count())
    return starts.repartition(n, "file").select("file", "before", "ranks").mapInArrow(run, "key long, start long, ids binary")
