"""Operator 6: best-fit packing by non-negative least squares over length patterns.

The histogram of piece lengths has at most `room` bins whatever the input.  Patterns fill a sequence exactly: all multisets
of three lengths, and all repeats of one length with one other piece or none; NNLS fits how often each is used; repeats are rounded down to what the histogram holds
and the residual is packed best fit, longest first, on counts.  The plan is a bounded table of runs: the r-th to s-th
piece of a length stand at some offset of consecutive sequences.  Each piece then finds its run by its rank among the
pieces of its length, which comes from counts by task and a running sum, never from one task that sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import DEFAULT_TOKENIZER, packed_encoder

#: Multiplicative NNLS steps.
STEPS = 300


def nnls(lengths: np.ndarray, times: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes the sum of x times the patterns close to `weights`, by multiplicative updates.

    lengths[p], times[p]: the lengths in pattern p and how often each stands there, 0 for none; weights by length.
    """
    weights = weights.astype(float)
    towards = (weights[lengths] * times).sum(1)
    x = np.min(np.where(times > 0, weights[lengths] / np.maximum(times, 1), np.inf), axis=1) / max(1, len(lengths) / len(weights))
    for _ in range(steps):
        made = np.bincount(lengths.ravel(), (x[:, None] * times).ravel(), len(weights))
        x *= towards / np.maximum((made[lengths] * times).sum(1), 1e-9)
    return x


def exact_patterns(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and times of every pattern: three lengths (about room^2 / 12), or k of one length and one of another.

    Only lengths that occur are used.
    """
    has = np.zeros(room + 1, bool)
    has[1:room] = counts[1:room] > 0
    there = np.flatnonzero(has)
    rows, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    for a in there.tolist():
        k = np.arange(1, room // a + 1)
        b = room - k * a
        keep = has[b] & (b != a) & ((k > 1) | (b < a)) | (b == 0)
        k, b = k[keep], b[keep]
        rows.append(np.stack([np.full(len(k), a), b, np.zeros_like(k)], 1))
        times.append(np.stack([k, (b > 0).astype(np.int64), np.zeros_like(k)], 1))
        b = there[(there < a) & (2 * there > room - a) & (there < room - a)]
        b = b[has[room - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, room - a - b], 1))
        times.append(np.ones((len(b), 3), np.int64))
    return np.concatenate(rows), np.concatenate(times)


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, offset): consecutive ranks go to consecutive sequences."""
    counts = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    used = np.zeros(room + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    at = 0

    def put(lengths: list[int], times: int) -> None:
        nonlocal at
        offset = 0
        for length in lengths:
            runs.append((length, int(used[length]), times, at, offset))
            used[length] += times
            offset += length
        at += times

    if counts[room]:
        put([room], int(counts[room]))
    patterns, often = exact_patterns(counts, room)
    if len(patterns):
        x = nnls(patterns, often, np.where(np.arange(room + 1) < room, counts, 0))
        order = np.argsort(-x, kind="stable")
        for p in order[: int((x >= 1).sum())]:
            need = [(v, k) for v, k in zip(patterns[p].tolist(), often[p].tolist(), strict=True) if k]
            times = min(int(x[p]), *(int(counts[v] - used[v]) // k for v, k in need))
            if times > 0:
                put([v for v, k in need for _ in range(k)], times)
    # Residual: best fit decreasing on counts. Open bins by room left hold (sequences, first sequence, fill) blocks.
    left: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    for length in range(room, 0, -1):
        todo = int(counts[length] - used[length])
        while todo:
            fits = [s for s in spaces if s >= length and left.get(s)]
            if not fits:
                each = room // length
                rows = todo // each if todo >= each else 1
                here = each if todo >= each else todo
                for k in range(here):
                    runs.append((length, int(used[length]), rows, at, k * length))
                    used[length] += rows
                space = room - here * length
                todo -= rows * here
                if space:
                    left.setdefault(space, []).append((at, rows))
                    if space not in spaces:
                        spaces.append(space)
                at += rows
                continue
            space = min(fits)
            first, rows = left[space].pop()
            take = min(rows, todo)
            runs.append((length, int(used[length]), take, first, room - space))
            used[length] += take
            todo -= take
            if rows > take:
                left[space].append((first + take, rows - take))
            if space > length:
                left.setdefault(space - length, []).append((first, take))
                if space - length not in spaces:
                    spaces.append(space - length)
        spaces = [s for s in spaces if left.get(s)]
    return runs


def _pieces(docs: DataFrame, room: int, tokenizer: str, end_id: int) -> DataFrame:
    """A row for each piece, with its rank among this task's pieces of its length."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = packed_encoder(tokenizer)
        seen = np.zeros(room + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    begin, end = 0, (len(ids) - 1) % room + 1
                    for piece in range(-(-len(ids) // room)):
                        out.append((doc_id, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()), int(seen[end - begin])))
                        seen[end - begin] += 1
                        begin, end = end, end + room
                yield pa.record_batch([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names)

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long")
    return rows.withColumn("task", F.spark_partition_id())


def pack_documents(docs: DataFrame, room: int = 1024, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A document is its ids and `end_id`; one longer than `room` is cut into pieces of `room`, the first of which may be
    shorter.  Null and empty texts are the end id alone; null doc_ids and repeated rows are packed like others; texts of any
    length are read whole; equal lengths are interchangeable, their order is that of the tasks; an empty table gives no
    rows; other columns are not read, so their names may clash with ours.
    """
    pieces = stage(_pieces(docs, room, tokenizer, end_id), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    runs = np.array(sorted(plan(histogram, room)), np.int64).reshape(-1, 5)  # by length, then first rank
    lows = np.searchsorted(runs[:, 0], np.arange(room + 2))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = np.empty(len(length), np.int64)
            for v in np.unique(length):
                own = np.flatnonzero(length == v)
                at[own] = lows[v] + np.searchsorted(runs[lows[v] : lows[v + 1], 1], rank[own], "right") - 1
            found = runs[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    met = pieces.join(by_task.select("task", "length", "before"), ["task", "length"])
    return met.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
