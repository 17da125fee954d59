"""Operator 5: a content-addressed store of token ids.

Layout of a store folder: `chunks` holds each distinct chunk once (digest, n_ids, data), `recipes` holds a row for each
document in ascending doc_id order (shard, doc_id, start in its shard, n_tokens, digests, root), and `manifest` a row for
each shard with its token count, start and the Merkle root over its documents' roots.  A rolling hash over a window of
ids cuts chunks, so equal passages give equal chunks wherever they stand.  A chunk's digest is SHA-256 cut to 128 bits;
a document's root is the Merkle root of its digests.  Reading checks data against digests, recipes against roots, roots
against manifests, and fails on any mismatch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, new_dir, stage, unstage
from .tokens import DEFAULT_TOKENIZER, packed_encoder, vocabulary

#: Ids in a chunk: at least, on average beyond that, and at most; ids that the rolling hash looks back on.
LEAST, MEAN, MOST, WINDOW = 64, 256, 1024, 8
_TABLE = np.random.default_rng(20240711).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of several id streams laid end to end, the streams' ends given.

    A rolling hash of the last WINDOW ids marks them.  It runs over the whole row: a mark counts LEAST ids after the
    chunk's begin at the earliest, and so never one whose window reaches into another stream.
    """
    value = _TABLE[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint64)
    rolled = np.zeros(len(ids), np.uint64)
    for j in range(min(WINDOW, len(ids))):
        rolled[j:] += value[: len(ids) - j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    marks = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    firsts = np.searchsorted(marks, ends, "right").tolist()
    marks, out, at, k = marks.tolist(), [], 0, 0
    for end, last in zip(ends.tolist(), firsts, strict=True):
        own: list[int] = []
        for mark in [*marks[k:last], end]:
            while mark - at > MOST:
                at += MOST
                own.append(at)
            if mark - at >= LEAST or mark == end > at:
                at = mark
                own.append(at)
        out.append(own)
        k = last
    return out


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary Merkle tree; an odd last node moves up as it is, and no leaves give 16 zero bytes."""
    if not leaves:
        return bytes(16)
    while len(leaves) > 1:
        paired = [hashlib.sha256(b"\x01" + a + b).digest()[:16] for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = paired + leaves[len(paired) * 2 :]
    return leaves[0]


def _binary(data: bytes, ends: list[int] | np.ndarray):
    """An Arrow array of byte strings that stand end to end in `data`."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.asarray(ends, np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _chunked(docs: DataFrame, tokenizer: str, end_id: int, width: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, last, size = packed_encoder(tokenizer), np.array([end_id], "<u4"), np.dtype(width).itemsize
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [x for text in part.column("text").to_pylist() for x in (encode(text or ""), last)]
                sizes = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(1)
                ids = np.concatenate(ids)
                cuts = cut_points(ids, np.cumsum(sizes))
                data = ids.astype(width).tobytes()
                view, digests, roots, at = memoryview(data), [], [], 0
                for own in cuts:
                    mine = []
                    for end in own:
                        mine.append(digest_of(view[at * size : end * size]))
                        at = end
                    digests += mine
                    roots.append(merkle_root(mine))
                chunks = pa.StructArray.from_arrays(
                    [_binary(b"".join(digests), 16 * np.arange(1, len(digests) + 1)), _binary(data, size * np.array([e for own in cuts for e in own]))], ["digest", "data"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cuts)]), pa.int32()), chunks)
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes), pa.array(roots, pa.binary()), lists], ["doc_id", "n_tokens", "root", "chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, root binary, chunks array<struct<digest:binary,data:binary>>")


def _with_starts(ordered: DataFrame) -> DataFrame:
    """Adds the partition as shard and the tokens of the shard's rows before each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = 0
        for batch in batches:
            n = np.asarray(batch.column("n_tokens"))
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.int64())], [*batch.schema.names, "start"])

    named = ordered.withColumn("shard", F.spark_partition_id())
    return named.mapInArrow(run, "doc_id long, n_tokens long, root binary, digests array<binary>, shard int, start long")


def _shard_roots(recipes: DataFrame) -> DataFrame:
    """shard, n_docs, n_tokens, root: a shard's documents in order of start; a shard is bounded by its partition."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        state: dict[int, list] = {}
        for batch in batches:
            for shard, n, root in zip(*(batch.column(c).to_pylist() for c in ("shard", "n_tokens", "root")), strict=True):
                own = state.setdefault(shard, [0, 0, hashlib.sha256()])
                own[0], own[1] = own[0] + 1, own[1] + n
                own[2].update(root)
        rows = [(s, d, n, h.digest()[:16]) for s, (d, n, h) in state.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "n_docs", "n_tokens", "root"])

    ordered = recipes.select("shard", "start", "doc_id", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "start")
    return ordered.mapInArrow(run, "shard int, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2) -> None:
    """Encode every row's whole text (null as empty), append `end_id`, and write the store to a new folder `path`."""
    spark = docs.sparkSession
    width = "<u2" if max(vocabulary(tokenizer)["model"]["vocab"].values()) < 1 << 16 else "<u4"
    held = stage(_chunked(docs, tokenizer, end_id, width), "tokens")
    own = held.select(F.explode("chunks").alias("c")).select("c.digest", "c.data")
    unique = own.groupBy("digest", "data").agg(F.count(F.lit(1)).alias("n_refs"))  # equal digests of different bytes give two rows
    size = 2 if width == "<u2" else 4
    unique.select("digest", "n_refs", F.lit(size).alias("id_bytes"), "data").write.option("compression", "zstd").parquet(f"{path}/chunks")
    if not spark.read.parquet(f"{path}/chunks").groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two different chunks have the same digest")
    recipes = held.select("doc_id", "n_tokens", "root", F.col("chunks.digest").alias("digests"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.hash("root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    _with_starts(ordered).write.option("compression", "zstd").parquet(f"{path}/recipes")
    unstage(held)
    shards = sorted(_shard_roots(spark.read.parquet(f"{path}/recipes")).collect())
    at, rows = 0, []
    for shard, n_docs, n_tokens, root in shards:  # a row for each shard, not for each document
        rows.append((shard, n_docs, n_tokens, at, root))
        at += n_tokens
    spark.createDataFrame(rows, "shard int, n_docs long, n_tokens long, start long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _or_fail(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(what)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks, each checked against its digest as it is read."""
    chunks = spark.read.parquet(f"{path}/chunks")
    good = F.substring(F.unhex(F.sha2("data", 256)), 1, 16) == F.col("digest")
    return chunks.withColumn("data", _or_fail(good, F.col("data"), "a chunk does not match its digest"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, digests, root; checked against the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    sealed = {tuple(r) for r in manifest.select("shard", "n_docs", "n_tokens", "root").collect()}
    if sealed != {tuple(r) for r in _shard_roots(recipes).collect()}:
        raise ValueError("the recipes do not match the manifest")
    before = F.broadcast(manifest.select("shard", F.col("start").alias("before")))
    return recipes.join(before, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "digests", "root")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, rebuilt from chunks."""
    refs = read_recipes(spark, path).select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("place", "digest"))
    total = refs.count()
    met = join_counted(refs, read_chunks(spark, path), ["digest"], "n_refs", total, "start")
    whole = met.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("place", "data", "id_bytes"))).alias("parts"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["data"], f"<u{p['id_bytes']}") for p in parts]).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def _crc_tables(bytes_by_length: int) -> np.ndarray:
    """[length, bit]: the CRC register's bit moved past `length` ids of zero bytes, over GF(2)."""
    one = np.array([1 << b for b in range(32)], np.uint32)

    def past_byte(row: np.ndarray) -> np.ndarray:
        for _ in range(8):
            row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1).astype(np.uint32)
        return row

    out = [one]
    for _ in range(MOST):
        row = out[-1]
        for _ in range(bytes_by_length):
            row = past_byte(row)
        out.append(row)
    return np.array(out)


def joined_crc(crc: np.ndarray, length: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The CRC-32 of each document's whole id stream from those of its `n` chunks and their lengths in ids, laid end to end."""
    first = np.cumsum(n) - n
    state = np.zeros(len(n), np.uint32)
    for k in range(n.max(initial=0)):
        on = np.flatnonzero(n > k)
        at = first[on] + k
        moved, old, step = np.zeros(len(on), np.uint32), state[on], length[at]
        for b in range(32 if k else 0):
            moved ^= np.where((old >> np.uint32(b)) & np.uint32(1), tables[step, b], np.uint32(0))
        state[on] = moved ^ crc[at]
    return state


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document as it stands in the files.

    The chunks' bytes are read once each; CRC-32 is linear, so a document's is joined from its chunks' and the recipe,
    without sending the data of repeated chunks to each document.
    """

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            crc, size = [], []
            for data, width in zip(batch.column("data").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True):
                ids = np.frombuffer(data, f"<u{width}")
                size.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4")))
            yield pa.record_batch([batch.column("digest"), batch.column("n_refs"), pa.array(size, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n_refs", "length", "crc"])

    chunks = read_chunks(spark, path).select("digest", "n_refs", "id_bytes", "data").mapInArrow(measured, "digest binary, n_refs long, length int, crc long")
    recipes = read_recipes(spark, path)
    refs = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("place", "digest"))
    total = recipes.agg(F.sum(F.size("digests"))).first()[0] or 0
    met = join_counted(refs, chunks, ["digest"], "n_refs", total, "start")
    whole = met.groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "length", "crc"))).alias("parts"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables = _crc_tables(4)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                chunks = part.column("parts").flatten()
                n = np.asarray(part.column("parts").value_lengths())
                length, crc = (np.asarray(chunks.field(c).fill_null(-1)) for c in ("length", "crc"))
                digests, ends = chunks.field("digest").to_pylist(), np.cumsum(n)
                sums = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
                right = (length >= 0).all() and np.array_equal(sums[ends] - sums[ends - n], np.asarray(part.column("n_tokens")))
                if not right or [merkle_root(digests[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)] != part.column("root").to_pylist():
                    raise ValueError("a recipe does not match its Merkle root or its chunks")
                crc = joined_crc(crc.astype(np.uint32), length, n, tables).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2) -> DataFrame:
    """Write a store to the shared folder and return document_digests() of its files.

    Null and empty texts hold the end id alone; null doc_ids come first; rows that share a doc_id are documents of their
    own, in order of their roots; an empty table gives no rows; other columns are not read.
    """
    path = new_dir(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id)
    return document_digests(docs.sparkSession, path)
