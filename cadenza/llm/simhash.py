"""SimHash fingerprints and exact groups of near fingerprints through sharded vantage-point trees.

Two fingerprints within ``bits`` of each other differ by at most bits / blocks (rounded down) in one of ``blocks`` disjoint
bit ranges, and Hamming distance on a range is a metric. So each range gets a vantage-point tree: a bounded sample sets its
vantage points and radii, every fingerprint has one home leaf, and visits each leaf that its ball overlaps by the triangle
bounds. A leaf is a shard: homes are compared with visitors on all 64 bits, after the tree goes on locally. Every pair
within ``bits`` meets in a shard; none is left to chance.

A shard reports only which of its fingerprints belong together (each with the smallest of its local group), never pairs,
and equal fingerprints are one row from the start. Large shards are dealt out by salting the homes. Components of all
shards' groups are then found by alternating large-star and small-star steps on written tables.

Defined cases: no words (or null text) gives fingerprint zero, linked like any other; repeated rows share a component; a
component's id is the smallest non-null doc_id in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, Scratch, map_texts, put_back, set_aside, text_bytes

SEED = 42
SAMPLE = 65_536  # fingerprints that shape a tree, at most
SHARD = 6_000  # homes a shard is meant to hold
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of the lower-cased words' shingles, repeats included; bit set if set in over half of the hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; hashes: rows of eight bytes."""
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BIT for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """row (tells repeated rows apart), the columns named in keep (doc_id), and fp, the fingerprint as a signed long."""
    keep = keep or ["doc_id"]
    names = [f"`{c}`" for c in dict.fromkeys([*keep, "text"])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        rows = RowNumbers()
        for part in parts:
            fps = np.array([fingerprint(t or b"", width) for t in text_bytes(part["text"])], np.uint64).view(np.int64)
            yield {"_row": rows.take(len(fps)), **{c: part[c] for c in keep}, "_fp": fps}

    return map_texts(docs, names, work, ", ".join(["_row long", *[f"`{c}` {kinds[c]}" for c in keep], "_fp long"]))


# -- vantage-point trees ---------------------------------------------------------------------------------------------------


class Tree:
    """A vantage-point tree over one bit range, its leaves numbered; radius is what a query ball has in this range."""

    def __init__(self, shift: int, width: int, radius: int, sample: np.ndarray, leaf: int, per_row: float):
        self.shift, self.mask, self.radius = np.uint64(shift), np.uint64((1 << width) - 1), radius
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, limit, inside, outside (negative: leaf -k - 1)
        self.salts: list[int] = []
        self.per_row, self.leaf = per_row, leaf
        self.root = self._grow(self.part(sample), 0)

    def part(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.shift) & self.mask

    def _grow(self, x: np.ndarray, depth: int) -> int:
        split = split_at(x, depth) if len(x) > self.leaf else None
        if split is None:
            self.salts.append(max(1, round(len(x) * self.per_row / (2 * SHARD))))
            return -len(self.salts)
        vantage, limit, near = split
        at = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        self.nodes[at] = (vantage, limit, self._grow(x[near], depth + 1), self._grow(x[~near], depth + 1))
        return at

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that visit it, whether it is their home)."""
        x = self.part(fps)
        stack = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows, home
                continue
            vantage, limit, inside, outside = self.nodes[node]
            d = np.bitwise_count(x[rows] ^ np.uint64(vantage)).astype(np.int64)
            for child, visits, homes in ((inside, d - self.radius <= limit, d <= limit), (outside, d + self.radius > limit, d > limit)):
                stack.append((child, rows[visits], home[visits] & homes[visits]))


def split_at(x: np.ndarray, depth: int) -> tuple[int, int, np.ndarray] | None:
    """Vantage point and radius that halve x best, out of a few points; None if none of them splits it."""
    best = None
    for k in range(4):
        vantage = x[(depth * 7919 + k * 104729 + len(x) // 2) % len(x)]
        d = np.bitwise_count(x ^ vantage)
        limit = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        for m in (limit - 1, limit):
            near = d <= m
            n = int(near.sum())
            off = abs(2 * n - len(x))
            if 0 < n < len(x) and (best is None or off < best[0]):
                best = off, int(vantage), m, near
    return best[1:] if best and best[0] < 0.9 * len(x) else None


def linked_in_shard(fps: np.ndarray, home: np.ndarray, bits: int, shift: int, width: int, radius: int) -> np.ndarray:
    """Local group (index of its smallest member) of each fingerprint, by all links between homes and visitors.

    fps are sorted and distinct."""
    label = np.arange(len(fps))
    x = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    stack = [(np.flatnonzero(home), np.arange(len(fps)), 0)]
    while stack:
        homes, visitors, depth = stack.pop()
        split = split_at(x[homes], depth) if len(homes) > 256 and len(visitors) > 256 and depth < 40 else None
        if split is None:
            for k in range(0, len(homes), step := max(1, (1 << 21) // max(1, len(visitors)))):
                some = homes[k : k + step]
                a, b = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[visitors][None, :]) <= bits)
                label = _join(label, some[a], visitors[b])
            continue
        vantage, limit, near = split
        d = np.bitwise_count(x[visitors] ^ np.uint64(vantage)).astype(np.int64)
        stack.append((homes[near], visitors[d - radius <= limit], depth + 1))
        stack.append((homes[~near], visitors[d + radius > limit], depth + 1))
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: the smallest label of each group."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def ranges(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each bit range."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def local_groups(fps: DataFrame, n: int, bits: int, blocks: int) -> DataFrame:
    """Edges (a, b): fingerprint a is in one group with the smaller fingerprint b. fps: distinct column _fp, written."""
    share = max(1, -(-n // SAMPLE))
    rows = fps.where(F.pmod(F.xxhash64("_fp"), F.lit(share)) == 0).limit(2 * SAMPLE).collect()  # about SAMPLE rows
    sample = np.sort(np.array([r[0] for r in rows] or [0], np.int64)).view(np.uint64)
    radius, per_row = bits // blocks, max(1, n) / len(sample)
    trees = [Tree(shift, width, radius, sample, max(16, int(SHARD / per_row)), per_row) for shift, width in ranges(blocks)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                for leaf, rows, home in tree.route(x):
                    salts = tree.salts[leaf]
                    own = ((x[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % salts
                    for salt in range(salts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), v, np.int32)) for v in (k, leaf, salt)] + [pa.array(x[rows].view(np.int64)), pa.array(home & (own == salt))], ["tree", "leaf", "salt", "fp", "home"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(x)
        x, home = x[order], table.column("home").to_numpy(zero_copy_only=False)[order]
        tree = key[0].as_py()
        label = linked_in_shard(x, home, bits, *ranges(blocks)[tree], radius)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": x[other].view(np.int64), "b": x[label[other]].view(np.int64)})

    routed = fps.mapInArrow(spread, "tree int, leaf int, salt int, fp long, home boolean")
    return routed.groupBy("tree", "leaf", "salt").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (its component's smallest node) for all nodes of the edges (a, b)."""
    # hashing order does not matter here: nodes compare as signed longs throughout
    edges = scratch.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    known = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = tuple(state)
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


def group(prints: DataFrame, bits: int = 4, blocks: int = 3) -> DataFrame:
    """All columns of a written table of fingerprints (with _fp) and root, the group's smallest fingerprint."""
    scratch = Scratch(prints.sparkSession)
    fps = scratch.stage(prints.select("_fp").distinct(), "fps")
    edges = scratch.stage(local_groups(fps, fps.count(), bits, blocks), "links")
    roots = components(edges, scratch)
    scratch.drop(fps, edges)
    return prints.join(roots, prints["_fp"] == roots["node"], "left").select(*prints.columns, F.coalesce("root", "_fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, blocks: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.stage(fingerprints(docs, width), "prints")
    grouped = scratch.stage(group(prints, bits, blocks), "groups")
    ids = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, bits: int = 4, blocks: int = 3) -> DataFrame:
    """One document of each group: that with the smallest doc_id (null last); columns as they came."""
    scratch = Scratch(docs.sparkSession)
    columns, docs = docs.columns, set_aside(docs, {"_row", "_fp", "root", "node"})
    prints = scratch.stage(fingerprints(docs, width, docs.columns), "prints")
    grouped = group(prints.select("_row", "doc_id", "_fp"), bits, blocks)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = grouped.groupBy("root").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return put_back(prints.join(kept, "_row", "left_semi"), columns)
