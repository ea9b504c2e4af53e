"""Components of documents whose shingle sets are similar, from buckets of candidates that may be very large.

A node is a distinct set. Nodes of one bucket are candidates for each other, and every candidate pair whose nodes are not
yet in one component is decided exactly. A pair is first screened by parity bitmaps: a set sets bit ``hash mod m`` to the
parity of its members there, so two bitmaps differ in at most as many bits as the sets differ in members, and similarity s
allows at most (1 - s) / (1 + s) of both sizes to differ. The screen loses no pair. What passes is decided on both whole sets.

Large buckets do not become pairs: in each round the nodes of a bucket are compared with one pivot, the links are made
components, and buckets that lie in one component are closed. Rounds with other pivots follow while many pairs are open and
rounds close most of them. The rest is decided pair by pair: small buckets by a self-join, large ones in blocks of BLOCK nodes, where a task decides on
whole sets, compares only nodes that its links have not joined, and leaves fewer links than it has nodes.

Bitmaps and texts of candidate nodes are a table bucketed by node, so that rounds move pairs and the texts of pairs, never
the whole table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, new_folder, remove_folder
from .simhash import _join

OPEN = 20  # open pairs for each row of a bucket, at most, before they are decided one by one
ROUNDS = 5  # at most; a round that leaves over half of the open pairs is the last
SMALL = 8  # nodes of a bucket that a self-join handles
BLOCK = 1024
COARSE = 256  # bits of the first screen within a block
HELD = 1 << 22  # members of the sets that a group of blocks keeps


@dataclass(frozen=True)
class Measure:
    """Shingles of ``width`` words; sets are similar if den * intersection >= num * union."""

    width: int
    num: int
    den: int

    def sizes_fit(self, a: str, b: str) -> str:
        return f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})"

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = np.concatenate([a, b])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return self.den * shared >= self.num * (len(both) - shared)

    def may_be(self, apart, sizes):
        """Whether bitmaps that differ in ``apart`` bits may be of similar sets of ``sizes`` members together."""
        return (self.den + self.num) * apart <= (self.den - self.num) * sizes


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words; fewer words are one shingle, none are no shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = max(1, len(one) - width + 1)
    out = np.full(n, min(len(one), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(one), width)):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def parity(hashes: np.ndarray) -> bytes:
    """The parity bitmap of a set: a power of two of bits, at least 64 and as many as members."""
    size = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def bits_apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(np.frombuffer(a, np.uint8), size) ^ folded(np.frombuffer(b, np.uint8), size)).sum())


def by_node(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The table written in buckets by node, and its name in the catalog."""
    spark, name = scratch.spark, f"nodes_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes.repartition(parts, "node").write.bucketBy(parts, "node").sortBy("node").option("path", new_folder(spark, "nodes")).saveAsTable(name)
    return spark.table(name), name


def shared(candidates: DataFrame) -> DataFrame:
    """Rows (h, node, n) of buckets that hold more than one node."""
    more = candidates.groupBy("h").count().where("count > 1").select("h")
    return candidates.join(more, "h", "left_semi")


def screened(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(measure.may_be(apart, batch.column(4).to_numpy()), pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").cast("long").alias(f"n_{c}")) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "bits_a", "bits_b", F.expr("n_a + n_b").alias("sizes"))
    return joined.mapInArrow(check, "a long, b long")


def decided(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, held = zstandard.ZstdDecompressor().decompress, {}

        def set_of(node: int, packed: bytes) -> np.ndarray:
            if node not in held:
                if len(held) > 8:
                    held.clear()
                held[node] = shingle_set(unpack(packed), measure.width)
            return held[node]

        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            ok = [measure.similar(set_of(i, x), set_of(j, y)) for i, j, x, y in zip(a, b, text_a, text_b)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b")
    return joined.mapInArrow(check, "a long, b long")


class Tile:
    """The nodes of one pair of blocks (i, j) of a bucket, by their bitmaps."""

    def __init__(self, key: tuple, table: pa.Table, measure: Measure):
        i, j = key[1].as_py(), key[2].as_py()
        self.node, self.n, root, block = (table.column(c).to_numpy() for c in ("node", "n", "root", "block"))
        self.bits, self.measure, self.within = table.column("bits").to_pylist(), measure, i == j
        coarse = [np.frombuffer(x, np.uint8) for x in self.bits]
        width = min([COARSE // 8, *map(len, coarse)])
        self.small = np.array([folded(x, width) for x in coarse]).reshape(len(coarse), -1).view(np.uint64)
        self.label = np.unique(root, return_inverse=True)[1]
        self.first, self.second = np.flatnonzero(block == i), np.flatnonzero(block == j)

    def others(self, k: int) -> np.ndarray:
        """Those to compare with node k: not joined with it, of fitting size, not ruled out by coarse bitmaps."""
        n, measure = self.n, self.measure
        other = self.second[self.second > k] if self.within else self.second
        ratio = measure.den * np.minimum(n[other], n[k]) >= measure.num * np.maximum(n[other], n[k])
        other = other[ratio & (self.label[other] != self.label[k])]
        apart = np.bitwise_count(self.small[other] ^ self.small[k]).sum(axis=1)
        return other[measure.may_be(apart.astype(np.int64), n[other] + n[k])]

    def may_link(self, k: int, x: int) -> bool:
        return self.measure.may_be(bits_apart(self.bits[x], self.bits[k]), int(self.n[x] + self.n[k]))


def in_blocks(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows (h, node, n, root) with the named columns of their nodes, once for each pair of blocks (i, j) of a bucket.

    Nodes are dealt to blocks; each pair of blocks of a bucket is one task's group of at most about 2 * BLOCK nodes."""
    blocks = rows.groupBy("h").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    dealt = rows.join(blocks, "h").join(nodes.select("node", *columns), "node").withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    dealt = dealt.select("h", "node", F.col("n").cast("long").alias("n"), "root", *columns, "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def promising(rows: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The rows (h, node, n, root) of nodes that have a pair in their bucket which bitmaps do not rule out.

    Bitmaps are a small part of what texts take, so texts need to follow to few buckets only. It gives rows, never pairs."""

    def screen(key: tuple, table: pa.Table) -> pa.Table:
        tile = Tile(key, table, measure)
        found = np.zeros(len(tile.node), bool)
        for k in tile.first:
            for x in tile.others(k):
                if not (found[k] and found[x]) and tile.may_link(k, x):
                    found[[k, x]] = True
        return table.select(["h", "node"]).filter(pa.array(found))

    found = in_blocks(rows, nodes, "bits").groupBy("h", "i", "j").applyInArrow(screen, "h long, node long").distinct()
    return rows.join(found, ["h", "node"], "left_semi")


def block_links(rows: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) within large buckets rows (h, node, n, root), decided on whole sets: with the roots they give all components.

    A group joins what it links, as it goes, with what has one root already and compares only nodes that are still apart, so it
    leaves fewer links than it has nodes."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        tile = Tile(key, table, measure)
        node, label, packed = tile.node, tile.label, table.column("packed")
        unpack, sets, held = zstandard.ZstdDecompressor().decompress, {}, 0

        def set_of(k: int) -> np.ndarray:
            nonlocal held
            if k not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[k] = shingle_set(unpack(packed[k].as_py()), measure.width)
                held += len(sets[k])
            return sets[k]

        a, b = [], []
        for k in tile.first:
            for x in tile.others(k):
                if label[x] != label[k] and tile.may_link(k, x) and measure.similar(set_of(k), set_of(x)):
                    label[label == label[x]] = label[k]
                    a.append(min(node[k], node[x]))
                    b.append(max(node[k], node[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_blocks(rows, nodes, "bits", "packed").groupBy("h", "i", "j").applyInArrow(compare, "a long, b long").distinct()


EDGES = 1 << 20  # links that one task makes components of


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) from every node to the smallest node of its component among the edges (u, v) of one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
        label = _join(np.arange(len(names)), at[: len(table)], at[len(table) :])
        other = np.flatnonzero(label != np.arange(len(names)))
        yield from pa.table({"u": names[other], "v": names[label[other]]}).to_batches(max_chunksize=100_000)

    return edges.repartition(tasks).mapInArrow(work, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) from every node of the edges (a, b) to its component's smallest node, without the roots; written.

    Tasks contract EDGES links each; what they leave is joined by large- and small-star steps until every edge leads to a root."""
    edges = scratch.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    tasks = max(1, -(-edges.count() // EDGES))
    previous, edges = edges, scratch.stage(contracted(edges, tasks), "edges")
    scratch.drop(previous)
    while tasks > 1:
        inner = edges.join(edges.select(F.col("v").alias("x")).distinct(), F.col("u") == F.col("x"), "left_semi")
        if inner.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
        previous = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.stage(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.stage(small, "edges")
        scratch.drop(previous, large)
    return edges


def similar_nodes(candidates: DataFrame, texts: DataFrame, measure: Measure, scratch: Scratch, only_shared: bool = False, near: DataFrame | None = None) -> DataFrame:
    """node, root for all nodes that are similar to another one, but the roots; written.

    candidates: (h, node, n), written; texts: (node, n, bits, packed), of which candidates of shared buckets are taken. With
    only_shared, candidates are of shared buckets already and texts of no other nodes. near: pairs (a, b) of nodes that are likely
    to be similar; they are decided first, so that rounds meet their nodes in one component."""
    found = candidates if only_shared else shared(candidates)
    open_rows = scratch.stage(found.withColumn("root", F.col("node")), "open")
    nodes, name = by_node(texts if only_shared else texts.join(open_rows.select("node").distinct(), "node", "left_semi"), scratch)
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    apart = f"root <> other_root and {measure.sizes_fit('n', 'other_n')}"
    other = [F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root")]
    roots = None

    def take(links: DataFrame) -> None:
        """Makes the links components with what was known."""
        nonlocal roots
        found = scratch.stage(links, "links")
        edges = found if roots is None else found.unionByName(roots.select(F.col("u").alias("a"), F.col("v").alias("b")))
        known, roots = roots, components(edges, scratch)
        scratch.drop(found, *([known] if known is not None else []))

    def compare_with_pivots(turn: int) -> None:
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "root")).alias("p")
        pivots = open_rows.groupBy("h").agg(pivot).select("h", F.col("p.node").alias("other"), F.col("p.n").alias("other_n"), F.col("p.root").alias("other_root"))
        take(decided(screened(open_rows.join(pivots, "h").where(apart).select(*pair).distinct(), nodes, measure), nodes, measure))

    def close() -> float:
        """Leaves the buckets that lie in more than one component, with their nodes' roots; the number of their open pairs."""
        nonlocal open_rows
        labelled = open_rows.select("h", "node", "n", "root").join(roots.select(F.col("u").alias("node"), F.col("v").alias("known")), "node", "left")
        labelled = scratch.stage(labelled.select("h", "node", "n", F.coalesce("known", "root").alias("root")), "labelled")
        split = labelled.groupBy("h", "root").count().groupBy("h").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count")).alias("cc"))
        before, open_rows = open_rows, scratch.stage(labelled.join(split.where("c * c > cc"), "h"), "open")
        scratch.drop(before, labelled)
        return open_rows.agg(F.sum(F.expr("(cast(c as double) - cast(cc as double) / c) / 2"))).first()[0] or 0

    rows, left = open_rows.count(), None
    if near is not None:
        take(decided(screened(near, nodes, measure), nodes, measure))
        close()
    for turn in range(ROUNDS):
        compare_with_pivots(turn)
        last, left = left, close()
        if left <= OPEN * rows or last is not None and left > last / 2:
            break
    if left:
        small, large = open_rows.where(f"c <= {SMALL}"), open_rows.where(f"c > {SMALL}")
        pairs = small.join(small.select("h", *other), "h").where(f"node < other and {apart}").select(*pair).distinct()
        # buckets of one large group hold much the same nodes: each node goes to its largest bucket first, which closes most others
        largest = large.groupBy("node").agg(F.max(F.struct("c", "h")).alias("x")).select("node", F.col("x.h").alias("h"))
        take(decided(screened(pairs, nodes, measure), nodes, measure).unionByName(block_links(large.join(largest, ["h", "node"]).drop("c", "cc"), nodes, measure)).distinct())
        done, open_rows = open_rows, scratch.stage(open_rows.where(f"c > {SMALL}"), "large")
        scratch.drop(done)
        if close():
            compare_with_pivots(ROUNDS)
            if close():
                few = scratch.stage(promising(open_rows.drop("c", "cc"), nodes, measure), "few")
                take(block_links(few, nodes, measure))
                scratch.drop(few)
    place = scratch.spark.sql(f"describe table extended {name}").where("col_name = 'Location'").first()[1]
    scratch.spark.sql(f"drop table {name}")
    remove_folder(place)
    scratch.drop(open_rows)
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
