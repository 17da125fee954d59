"""Operator 2: near duplicates by one-permutation MinHash with optimal densification, banded buckets and star edges.

1. One pass hashes each text's distinct word shingles, keeps the least hash of each of BINS bins, and fills empty bins
   from other bins in a fixed random probing order of their own (optimal densification).
2. Texts with the same shingle set are one node, so groups of copies of any size cost one node.  A node's id is the
   smallest doc_id of its rows and half of its set's hash, so rows that share a doc_id but not a text stay apart.
3. Bands of ROWS bins make bucket keys.  In a bucket each node is paired with the smallest node only (a star):
   a bucket of m nodes gives m - 1 pairs.  Pairs pass exact size and sketch bounds, then full shingle sets decide.
4. Components: edges are joined into stars within tasks first, then by alternating large and small stars.
5. A star can miss a link between two nodes that are not the bucket's smallest.  So a bucket that holds several
   components then is closed: its nodes outside the component of its smallest node meet all nodes of other components,
   block by block.  A pair is tested on full sets if its sketches allow a link, in the first band that the two share, and
   only while the two are not yet of one component there.  The rows dealt are those of the bucket plus blocks times the
   nodes outside, so a family of real copies costs little, however large, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_counted, stage, stage_counted, unstage
from .exact_dedup import filter_rows

BINS, BANDS, ROWS = 128, 25, 5
#: Nodes and shingles of a block of a bucket: the open pairs of two blocks are tested in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Edges that one task joins into components.
EDGES = 200_000
#: Sketch agreement below threshold by so many standard deviations can't come from a link but once in some million.
SIGMAS = 5
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = np.argsort(_SEED.random((BINS, BINS)), axis=1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7))
_BASE = 0x9E3779B97F4A7C15
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers[:] = both
    return _powers[0], _powers[1]


def _text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, null as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words none."""
    data, offsets = _text_bytes(column)
    n_docs = len(offsets) - 1
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * n_docs
    white = _IS_WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~white & (first[:-1] | np.r_[True, white[:-1]]))
    ends = np.flatnonzero(~white & (first[1:] | np.r_[white[1:], True])) + 1
    if not len(starts):
        return [none] * n_docs
    power, inverse = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)  # words before each document
    count = len(word) - words + 1
    shingle = np.zeros(max(count, 0), np.uint64)
    for j in range(words):
        if count > 0:
            shingle = _mix(shingle * np.uint64(0xD6E8FEB86659FD93) + word[j : j + count])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(shingle[a : b - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in word[a:b]:
                whole = _mix(whole * np.uint64(0xC2B2AE3D27D4EB4F) + x + np.uint64(b - a))
            out.append(whole)
        else:
            out.append(none)
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first filled bin in its probing order."""
    at = np.searchsorted(own, _EDGES)
    filled = np.append(at[1:], len(own)) > at
    least = own[np.minimum(at, len(own) - 1)]
    if not filled.all():
        source = _PROBES[np.arange(BINS), np.argmax(filled[_PROBES], axis=1)]
        least = np.where(filled, least, least[source])
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """The bucket keys of signatures, a column for each band."""
    key = np.zeros((len(least), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS)
    for j in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, j])
    return key.view(np.int64)


def _mins(least: np.ndarray) -> np.ndarray:
    """A byte for each bin of signatures."""
    return (_mix(least) & np.uint64(255)).astype(np.uint8)


def _set_hashes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit sum hashes of each set."""
    sizes = np.array([len(x) for x in sets], np.int64)
    joined, ends = np.concatenate([*sets, np.zeros(1, np.uint64)]), np.cumsum(sizes)
    out = []
    for salt in (0x1B873593CC9E2D51, 0x52DCE729DA3E39CB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(joined + np.uint64(salt)))])
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def sketch_documents(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit sum hash of the set), bands, mins (a byte for each bin)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column("text"), words)
                some = [i for i, x in enumerate(sets) if len(x)]
                least = np.array([signature(sets[i]) for i in some], np.uint64).reshape(len(some), BINS)
                keys: list = [[]] * len(sets)
                mins: list = [b""] * len(sets)
                for i, k, m in zip(some, _bands(least), _mins(least), strict=True):
                    keys[i], mins[i] = k, m.tobytes()
                sizes = pa.array([len(x) for x in sets], pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id"), sizes, *map(pa.array, _set_hashes(sets)), pa.array(keys, pa.list_(pa.int64())), pa.array(mins, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "mins"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, mins binary")


_SAME = ["set_a", "set_b", "n_shingles"]
_LEAST_LONG = -(2**63)


def _node_of(doc_id: Column, set_a: Column) -> Column:
    """16 bytes that sort as doc_id does, then as set_a."""
    part = lambda c: F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(_LEAST_LONG))), 16, "0"))
    return F.concat(part(doc_id), part(set_a))


def _doc_of(node: Column) -> Column:
    """The doc_id that a node's id holds."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") + F.lit(_LEAST_LONG).cast("decimal(20,0)")).cast("long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, own (the sorted shingle hashes as bytes) of the wanted nodes (doc_id, set_a, node)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column("text"), words)
                keep = pa.array(_set_hashes(sets)[0] == np.asarray(part.column("set_a")))
                own = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node").filter(keep), own.filter(keep)], ["node", "own"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "set_a", "text").mapInArrow(run, "node binary, own binary").dropDuplicates(["node"])


def _close_in_size(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _least_agreement(n: np.ndarray, percent: int) -> np.ndarray:
    """The share of bins that the sketches of a link agree in at least, by the size of the smaller set.

    Bins that a small set leaves empty copy others, so only those it fills are samples.
    """
    p, filled = percent / 100, BINS * -np.expm1(-n / BINS)
    return p - SIGMAS * np.sqrt(p * (1 - p) / filled)


def _agreement(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree in enough bins to be a link."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("mins_a").to_pylist()), np.uint8).reshape(-1, BINS)
            b = np.frombuffer(b"".join(batch.column("mins_b").to_pylist()), np.uint8).reshape(-1, BINS)
            least = _least_agreement(np.minimum(np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))), percent)
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return pairs.select("a", "b", "mins_a", "mins_b", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def _is_link(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = np.concatenate([left, right])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common > 0 and 100 * common >= percent * (len(left) + len(right) - common)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, own_a, own_b) whose full sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("own_a", "own_b")]
            good = pa.array([_is_link(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(run, "a binary, b binary")


def confirm_pairs(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among `pairs` (a < b): exact size bound and sketch bound first, then the full sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("mins").alias(f"mins_{x}"))
    near = pairs.join(side("b"), "b").join(side("a"), "a").filter(_close_in_size("n_a", "n_b", percent))
    likely = stage(_agreement(near, percent), "likely")
    own = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}"))
    links = stage(_confirmed(likely.join(own("b"), "b").join(own("a"), "a"), percent), "links")
    unstage(likely)
    return links


class Forest:
    """Disjoint sets; the root of each is its smallest member."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        above, top = self.above, x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def _contracted(edges: DataFrame, kind: str) -> DataFrame:
    """Edges (hi, lo) that connect what the edges of each task connect: each node with the smallest that it reaches there.

    At most EDGES edges are held at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forest = Forest()

        def stars():
            found = [(x, forest.root(x)) for x in list(forest.above)]
            return pa.record_batch([pa.array([r[i] for r in found], type_) for i in (0, 1)], ["hi", "lo"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.above) >= EDGES:
                yield stars()
                forest = Forest()
        if forest.above:
            yield stars()

    return edges.mapInArrow(run, f"hi {kind}, lo {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge (a, b) to another one.

    Edges are joined into stars within tasks, as many as hold EDGES each.  Where one task held them all, that is the
    answer; else alternating large and small stars make each node's star, until nothing changes.
    """
    kind = edges.schema[0].dataType.simpleString()
    held, total = stage_counted(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo"), "edges")
    tasks = -(-total // EDGES)
    new, total = stage_counted(_contracted(held.coalesce(max(1, tasks)), kind), "edges")
    unstage(held)
    held, seen = new, None
    while tasks > 1:
        sums = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen, total = sums, max(1, sums[0])
        both = held.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(held.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
        large = join_counted(held.select(F.col("lo").alias("u"), "hi"), least.withColumn("m", F.least("u", "m")), ["u"], "n", total, "hi").select("hi", F.col("m").alias("lo")).distinct()
        large = stage(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["hi"], "n", total, "lo")
        out = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
        new = stage(out, "edges")
        unstage(held)
        unstage(large)
        held = new
    return held.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, node, hub (the smallest node), n for each node of each bucket of several nodes.

    The hubs are found by an aggregate that combines before its shuffle, and staged, so the join with them is a plain
    one that is dealt anew where a bucket is hot, or a broadcast where they are few.
    """
    rows = nodes.select("node", F.explode("bands").alias("key"))
    hubs = stage(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs")
    return stage(rows.join(hubs, "key"), "buckets")


def _open(left: dict, right: dict, percent: int) -> np.ndarray:
    """[i, j]: whether left's i-th and right's j-th row can be a link, by size and sketch, of two components.

    A pair of rows that are both outside is taken once, and a pair only in the first band that the two share.
    """
    m, n = left["n"][:, None], right["n"]
    out = left["component"][:, None] != right["component"]
    for lo in range(0, len(m), 128):
        agree = np.zeros((len(m[lo : lo + 128]), len(n)), np.uint8)
        for a, b in zip(left["mins"][lo : lo + 128].T.copy(), right["mins"].T.copy(), strict=True):
            agree += a[:, None] == b
        out[lo : lo + 128] &= agree >= _least_agreement(np.minimum(m[lo : lo + 128], n), percent) * BINS
    out &= (m * 100 >= n * percent) & (n * 100 >= m * percent) & (~left["outside"][:, None] | (left["node"][:, None] < right["node"]))
    for i in np.flatnonzero(out.any(1)):
        at = np.flatnonzero(out[i])
        shared = left["bands"][i] == right["bands"][at]
        out[i, at] = shared.argmax(1) == (shared & (right["bands"][at] == left["key"])).argmax(1)
    return out


def _tables(batches: Iterator) -> Iterator:
    """A table for each run of rows with the same (key, part, other)."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(x)) for x in ("key", "part", "other")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(keys[lo])
    if held:
        yield pa.Table.from_batches(held)


def _rows(table, columns: dict) -> tuple[dict, dict]:
    """The two sides of a block as arrays."""
    side = np.asarray(table.column("side"))
    whole = {"node": np.array(table.column("node").to_pylist(), object), "component": np.array(table.column("component").to_pylist(), object), "outside": np.asarray(table.column("outside"))} | columns
    key = np.asarray(table.column("key"))[0]
    return tuple({c: v[side == k] for c, v in whole.items()} | {"key": key, "at": np.flatnonzero(side == k)} for k in (0, 1))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other")


def _live(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that have an open pair there."""

    def run(batches: Iterator) -> Iterator:
        names = ["key", "part", "other", "side", "node", "component", "outside"]
        for table in _tables(batches):
            mins = np.frombuffer(b"".join(table.column("mins").to_pylist()), np.uint8).reshape(-1, BINS)
            bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
            left, right = _rows(table, {"mins": mins, "bands": bands, "n": np.asarray(table.column("n_shingles"))})
            if len(left["at"]) and len(right["at"]):
                found = _open(left, right, percent)
                some = np.concatenate([left["at"][found.any(1)], right["at"][found.any(0)]])
                if len(some):
                    yield from table.select(names).take(some).to_batches()

    return _dealt(dealt).mapInArrow(run, "key long, part long, other long, side int, node binary, component binary, outside boolean")


def _joining(left: dict, right: dict, percent: int) -> list[tuple[bytes, bytes]]:
    """Links among a block's open pairs, tested on full sets, until they join all components that they can join."""
    found, forest, out = _open(left, right, percent), Forest(), []
    held, word = np.unique(np.concatenate(right["own"]), return_inverse=True)
    begins = np.cumsum([0, *(len(x) for x in right["own"][:-1])])
    ends = begins + right["n"]
    for i in np.flatnonzero(found.any(1)):
        others = [j for j in np.flatnonzero(found[i]).tolist() if forest.root(right["component"][j]) != forest.root(left["component"][i])]
        if not others:
            continue
        own = np.zeros(len(held), np.int32)
        at = np.minimum(np.searchsorted(held, left["own"][i]), len(held) - 1)
        own[at[held[at] == left["own"][i]]] = 1
        total = np.concatenate([[0], np.cumsum(own[word])]) if 8 * len(others) > len(ends) else None
        for j in others:
            common = int(total[ends[j]] - total[begins[j]] if total is not None else own[word[begins[j] : ends[j]]].sum())
            if 100 * common >= percent * (int(left["n"][i]) + int(right["n"][j]) - common) and forest.join(left["component"][i], right["component"][j]):
                out.append((left["node"][i], right["node"][j]))
    return out


def _closing(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that join components, among all pairs that share a bucket and are not of its smallest node."""
    labels = found.select("node", "component")
    member = stage(buckets.filter("n > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    of_hub = member.filter("node = hub").select("key", F.col("component").alias("hub_component"))
    own = stage(of_hub, "hubs")
    rows = member.join(own, "key").withColumn("outside", F.col("component") != F.col("hub_component")).filter("node <> hub")
    rows = stage(rows.join(nodes.select("node", "n_shingles", "mins", "bands"), "node").select("key", "node", "component", "outside", "n_shingles", "mins", "bands"), "outside")
    parts = lambda n, weight: F.greatest(F.lit(1), F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES))))
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.count_if("outside").alias("n1"), F.sum(F.when(F.col("outside"), F.col("n_shingles"))).alias("w1")).filter("n1 > 0 and n > 1")
    size = stage(size.select("key", parts(F.col("n"), F.col("w")).alias("parts"), parts(F.col("n1"), F.col("w1")).alias("others")), "sizes")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    place = lambda part, other, side: F.struct(part.alias("part"), other.alias("other"), F.lit(side).alias("side"))
    first = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda q: place(at("parts"), q, 0))
    second = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: place(p, at("others"), 1))
    places = F.explode(F.when(F.col("outside"), F.concat(first, second)).otherwise(first))
    dealt = rows.join(size, "key").withColumn("place", places).select("key", "place.*", "node", "component", "outside", "n_shingles", "mins", "bands")
    live = stage(_live(dealt, percent), "live")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table in _tables(batches):
            own = np.empty(table.num_rows, object)
            own[:] = [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
            least = np.array([signature(x) for x in own])
            left, right = _rows(table, {"own": own, "mins": _mins(least), "bands": _bands(least), "n": np.array([len(x) for x in own])})
            links = _joining(left, right, percent) if len(left["at"]) and len(right["at"]) else []
            yield pa.record_batch([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return stage(_dealt(live.join(sets, "node")).mapInArrow(run, "a binary, b binary"), "links")


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, node, component of every row; node and component are null without doc_id or words."""
    sketch, total = stage_counted(sketch_documents(docs, words), "sketch")
    linkable = sketch.filter("n_shingles > 0 and doc_id is not null")
    grouped = linkable.groupBy(*_SAME).agg(F.min(F.struct("doc_id", "bands", "mins")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stage(grouped.select(*_SAME, "first.doc_id", "first.bands", "first.mins", "n", _node_of(F.col("first.doc_id"), F.col("set_a")).alias("node")), "nodes")
    buckets = _buckets(nodes)
    star = stage(buckets.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    wanted = nodes.select("doc_id", "set_a", "node").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = stage(_sets(docs, wanted, words), "sets", "none")
    links = confirm_pairs(star, nodes, sets, percent)
    found = components(links)
    more = _closing(buckets, nodes, sets, found, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    unstage(sets)
    final = nodes.join(found, "node", "left").select(*_SAME, "n", "node", F.coalesce("component", "node").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "set_a", "set_b")
    named = join_counted(rows.filter("n_shingles > 0 and doc_id is not null"), final, _SAME, "n", total, "doc_id").select("doc_id", "n_shingles", "set_a", "set_b", "node", "component")
    none = F.lit(None).cast("binary")
    return named.union(rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "set_a", "set_b", none.alias("node"), none.alias("component")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts are lower-cased in A-Z; words are runs without ASCII white space; a set holds the distinct shingles of `words`
    words as 64-bit hashes, or the whole sequence of a shorter text.  Texts of any length are read whole.  Null and empty
    texts have no shingles and link with nothing (component_id is doc_id).  Rows that share a doc_id but not a shingle set
    are texts of their own; repeated rows repeat.  Rows with a null doc_id link with nothing (component_id null, kept).
    Ties do not arise: the smallest doc_id names a component.  An empty table gives no rows; other columns are not read.
    """
    rows = _labelled(docs, words, percent)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(_doc_of(F.col("component")))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, one with the smallest doc_id, with all columns of `docs`.

    Rows without doc_id stay (one of those with equal shingle sets), and so do texts without words.  Of rows that share
    doc_id and shingle set one stays; a row that shares its doc_id with other texts is judged by its own.  Null texts count
    as empty; texts of any length are read whole; an empty table stays empty; other columns may have any names.
    """
    rows = _labelled(docs, words, percent)
    keep = F.col("component").isNull() | (F.col("component") == _node_of(F.col("doc_id"), F.col("set_a")))

    def tagged(loose: DataFrame, names: list[str]) -> DataFrame:
        plain = loose.toDF(*[f"c{i}" for i in range(len(loose.columns))])  # names with dots don't pass mapInArrow
        text = plain.columns[loose.columns.index("text")]

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                hashes = _set_hashes(shingle_sets(batch.column(text), words))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, hashes)], [*batch.schema.names, *names])

        schema = StructType([*plain.schema.fields, *(StructField(n, LongType()) for n in names)])
        return plain.mapInArrow(run, schema).toDF(*loose.columns, *names)

    return filter_rows(docs, rows.select("doc_id", "set_a", "set_b", keep.alias("keep")), ["set_a", "set_b"], tagged)
