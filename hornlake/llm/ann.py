"""Operator 1: approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts TABLE_BITS Gaussian projections into cells of one width; a query visits its own bucket and then the
buckets that moving single projections across their nearest cell borders would reach, in the order of estimated success:
sets of moves are ranked once by expected squared border distances, and mapped for each query to its own sorted borders.
Candidates of all tables are merged, then ranked by exact distance in double precision on the original vectors.

Rows are dealt to blocks of at most about BLOCK_ROWS and queries to groups of QUERY_ROWS; a task holds the tables of one
block and answers one group, returning no more than `k` rows a query.  Queries whose buckets hold fewer than `k` candidates
are answered by a scan, in the same blocks.  Among equal vectors only the k + 1 smallest ids can
be answers, so the others are left out before the blocks are made, which keeps the result whole and takes heat away.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, stage_counted

#: Tables, projections in each, and the cell width as a multiple of the typical distance between a vector and its
#: nearest neighbour in a sample.  Buckets visited start from PROBES and double until the sample's recall is AIM; a
#: sample's neighbours stand farther off than those of the whole table, so the whole table's recall is no less.
TABLES, TABLE_BITS, WIDTH, PROBES, AIM = 10, 6, 1.1, 32, 0.96
#: Rows of a block, queries of a group, rows of the bounded sample that width and probes are fitted on, its queries.
BLOCK_ROWS, QUERY_ROWS, SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 4096, 4000, 200


def probing_sets(bits: int, probes: int) -> np.ndarray:
    """0/1 rows over 2 * bits border ranks: the `probes` valid sets of least expected score, the empty set first.

    Ranks j and 2 * bits - 1 - j are the two borders of one projection, so a set holds one of them at most.
    """
    m = 2 * bits
    j = np.arange(1, m + 1)
    score = np.where(j <= bits, j * (j + 1) / (4 * (bits + 1) * (bits + 2)), 1 - (m + 1 - j) / (bits + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (bits + 1) * (bits + 2)))
    rows, heap = [np.zeros(m, np.uint64)], [(score[0], (0,))]
    while heap and len(rows) < probes:
        total, at = heapq.heappop(heap)
        if all(m - 1 - x not in at for x in at):
            row = np.zeros(m, np.uint64)
            row[list(at)] = 1
            rows.append(row)
        last = at[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*at[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*at, last + 1)))
    return np.array(rows)


class Hashes:
    """The projections of all tables; the same for the same dimension and seed."""

    def __init__(self, dimension: int, width: float, probes: int, tables: int = TABLES, bits: int = TABLE_BITS, seed: int = 7):
        rng = np.random.default_rng([seed, dimension])
        self.tables, self.bits = tables, bits
        self.directions = rng.standard_normal((dimension, tables * bits)) / width
        self.shifts = rng.random(tables * bits)
        self.odd = rng.integers(0, 2**62, (tables, bits), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sets = probing_sets(bits, probes)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys [row, table] and places in the cells [row, table, bit]."""
        at = (vectors @ self.directions + self.shifts).reshape(len(vectors), self.tables, self.bits)
        cell = np.floor(at)
        return (cell.astype(np.int64).view(np.uint64) * self.odd).sum(-1, dtype=np.uint64), at - cell

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        """Keys [row, table, probe] in the order of estimated success."""
        keys, place = self.cells(vectors)
        borders = np.concatenate([place, 1 - place], -1)
        order = np.argsort(borders, -1, kind="stable")
        moves = np.concatenate([np.zeros_like(self.odd) - self.odd, self.odd], -1)
        sorted_moves = np.take_along_axis(np.broadcast_to(moves, order.shape), order, -1)
        return keys[:, :, None] + np.einsum("qtm,pm->qtp", sorted_moves, self.sets)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, hashes: Hashes | None, k: int) -> tuple[list, np.ndarray]:
    """(query_id, vec_id, distance) of each query's k nearest candidates in the block, and candidates a query.

    Without hashes every row is a candidate.
    """
    if hashes is None:
        out = []
        for q, query in zip(query_ids.tolist(), queries, strict=True):
            far = np.sqrt(((vectors - query) ** 2).sum(1))
            far[ids == q] = np.inf
            out += [(q, int(ids[b]), float(far[b])) for b in np.lexsort((ids, far))[:k] if far[b] < np.inf]
        return out, np.full(len(queries), len(ids))
    keys, _ = hashes.cells(vectors)
    order = np.argsort(keys, 0, kind="stable")
    sorted_keys = np.take_along_axis(keys, order, 0)
    out, seen = [], np.zeros(len(queries), np.int64)
    for lo in range(0, len(queries), 256):
        probes = hashes.probes(queries[lo : lo + 256])
        first = np.stack([np.searchsorted(sorted_keys[:, t], probes[:, t], "left") for t in range(hashes.tables)], 1)
        last = np.stack([np.searchsorted(sorted_keys[:, t], probes[:, t], "right") for t in range(hashes.tables)], 1)
        for i in range(len(probes)):
            hit = np.zeros(len(ids), bool)
            for t in range(hashes.tables):
                a, b = first[i, t], last[i, t]
                some = b > a
                a, n = a[some], (b - a)[some]
                if len(n):
                    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hit[order[at, t]] = True
            found = np.flatnonzero(hit & (ids != query_ids[lo + i]))
            seen[lo + i] = len(found)
            if len(found):
                far = np.sqrt(((vectors[found] - queries[lo + i]) ** 2).sum(1))
                if len(found) > k:
                    near = far <= np.partition(far, k - 1)[k - 1]
                    found, far = found[near], far[near]
                best = np.lexsort((ids[found], far))[:k]
                out += [(int(query_ids[lo + i]), int(ids[found[b]]), float(far[b])) for b in best]
    return out, seen


def recall_of(vectors: np.ndarray, queries: int, hashes: Hashes, k: int) -> float:
    """Share of the true k nearest of the first `queries` rows that the search finds among `vectors`."""
    ids = np.arange(len(vectors))
    found: dict[int, set] = {i: set() for i in range(queries)}
    for q, v, _ in search_block(ids, vectors, ids[:queries], vectors[:queries], hashes, k)[0]:
        found[q].add(v)
    hits = total = 0
    for i in range(queries):
        far = ((vectors - vectors[i]) ** 2).sum(1)
        far[i] = np.inf
        true = np.argsort(far, kind="stable")[: min(k, len(vectors) - 1)].tolist()
        hits, total = hits + len(found[i] & set(true)), total + len(true)
    return hits / total if total else 1.0


def fit(sample: np.ndarray, k: int, aim: float = AIM) -> Hashes:
    """Hashes whose width and number of probes fit a bounded sample of distinct vectors."""
    queries = min(SAMPLE_QUERIES, len(sample))
    near = []
    for i in range(queries):
        far = ((sample - sample[i]) ** 2).sum(1)
        far[i] = np.inf
        near.append(np.sqrt(far.min()) if len(sample) > 1 else 1.0)
    width = WIDTH * float(np.median(near)) or 1.0
    probes = PROBES
    while True:
        hashes = Hashes(sample.shape[1], width, probes)
        if recall_of(sample, queries, hashes, k) >= aim:
            return hashes
        if len(hashes.sets) < probes:  # every set of single moves is visited
            width, probes = width * 1.25, PROBES
        else:
            probes *= 2


def _matrix(column) -> np.ndarray:
    """An Arrow column of binary rows of doubles as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each row whose id is divisible by `every`.

    Vectors that are null, zero, of no dimension, or hold null or non-finite components take no part, nor do rows with a
    null id; among dimensions the most frequent one takes part.  Rows that repeat an id with the same vector are one
    row.  Ties go to the smaller id.  With no vectors the result is empty; other columns are not read, so their names may
    clash with ours.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column("v")
            flat, ends = np.asarray(column.flatten(), "<f8"), np.cumsum(np.asarray(column.value_lengths()))
            data = [x.tobytes() for x in np.split(flat + 0.0, ends[:-1])]  # -0.0 becomes 0.0
            yield pa.record_batch([batch.column("id"), pa.array([len(x) // 8 for x in data], pa.int32()), pa.array(data, pa.binary())], ["id", "size", "v"])

    rows = stage(rows.mapInArrow(packed, "id long, size int, v binary"), "vectors")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("size") == sizes["size"]).drop("size")
    is_query = F.col("id") % every == 0
    equal = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).drop("n")
    few = stage(few, "distinct")
    n_rows, n_queries = few.count(), rows.filter(is_query).select("id").distinct().count()
    sample = few.select("v").distinct().orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).collect()  # a bounded, seeded sample
    hashes = fit(np.array([np.frombuffer(r["v"], "<f8") for r in sample]), k)

    blocks, groups = -(-n_rows // BLOCK_ROWS), max(1, -(-n_queries // QUERY_ROWS))
    dealt = lambda column, n, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")
    questions = stage(rows.filter(is_query).distinct(), "queries")
    schema_near = "query_id long, vec_id long, score double"

    def nearest(asked: DataFrame, hashes: Hashes | None, groups: int) -> DataFrame:
        def answer(key, left, right):
            import pyarrow as pa

            out: list = []
            if left.num_rows and right.num_rows:
                ids, query_ids = np.asarray(left.column("id")), np.asarray(right.column("id"))
                out, _ = search_block(ids, _matrix(left.column("v")), query_ids, _matrix(right.column("v")), hashes, k)
            kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
            return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

        held = few.select(dealt("id", blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "v")
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt("id", groups, 2).alias("group"), "id", "v")
        return held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(answer, schema_near).distinct()

    near = stage(nearest(questions, hashes, groups), "near")
    counts = near.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    enough = counts.filter(F.col("n") >= min(k, few.select("id").distinct().count() - 1))
    short, n_short = stage_counted(questions.join(enough, questions["id"] == enough["query_id"], "left_anti"), "short")
    if n_short:  # too few candidates in the buckets visited: all rows are looked at
        near = near.union(nearest(short, None, -(-n_short // QUERY_ROWS))).distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
