"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue, exact reranking.

A documented sample of at most SAMPLE vectors shapes the trees (directions between two sampled points, split at the
median); every vector is then indexed: it goes to one leaf of each tree. A query searches all trees through one shared
queue: the branch with the best margin is taken next, whichever tree it is in, until the leaves taken hold enough vectors.
Queries meet the vectors of their leaves in a join of small groups (leaf, salt), where cosines are computed in double
precision on the original vectors; a group reports only each query's best, and the bests of all groups are merged.

Equal vectors are one class: of a class only the k + 1 smallest vec_ids can be in any answer (ties go to smaller ids and
the query itself drops out), and equal queries are searched once. Both are exact. Large leaves are salted.

Defined cases: vectors that are null or zero, or hold null or non-finite components, take no part, as query or candidate;
nor do those whose length is not the commonest one, as no cosine is defined between lengths. Rows with the same vec_id and
vector are one row, as query and as candidate. Rows with one vec_id and other vectors are queries of their own, each with
its own ranks; as candidates they are one id, with the score of the nearest. A query drops every candidate of its own id."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts

SAMPLE = 20_000
TREES = 10
LEAF = 512  # vectors a leaf is meant to hold
SHARE = 0.9  # leaf entries a query looks at, over all trees, as a share of the vectors; recall holds at any size
GROUP = 20_000  # vectors of a leaf that go to one task
PROBED = 8 << 20  # bytes of vectors in one batch of probes; a query may visit thousands of leaves


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and vec, the vector as double-precision bytes, of all vectors that take part."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            ids, vecs = [], []
            column = part["embedding"]
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            for vec_id, vector in zip(part["vec_id"].to_pylist(), column):
                if not vector.is_valid or vector.values.null_count or vec_id is None:
                    continue
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                if len(x) and np.isfinite(x).all() and x.any() and np.isfinite(np.dot(x, x)) and np.dot(x, x) > 0:
                    ids.append(vec_id)
                    vecs.append((x + 0.0).tobytes())  # one zero only
            yield {"vec_id": ids, "vec": vecs}

    return map_texts(table, ["vec_id", "embedding"], work, "vec_id long, vec binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Random-projection trees over directions; node rows hold a plane and a threshold, leaves are numbered throughout."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        self.planes: list[np.ndarray] = []
        self.limits: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves, self.random, self.leaf = 0, np.random.default_rng(seed), leaf
        self.roots = [self._grow(sample, 0) for _ in range(trees)]
        self.normal = np.array(self.planes).reshape(len(self.planes), sample.shape[1])
        del self.random, self.planes

    def _grow(self, x: np.ndarray, depth: int) -> int:
        if len(x) > self.leaf and depth < 40:
            for _ in range(4):
                a, b = x[self.random.integers(len(x), size=2)]
                plane = a - b if (a != b).any() else self.random.normal(size=x.shape[1])
                plane = plane / np.sqrt(plane @ plane)
                side = x @ plane
                limit = float(np.median(side))
                right = side > limit
                if 0.05 * len(x) < right.sum() < 0.95 * len(x):
                    at = len(self.limits)
                    self.planes.append(plane)
                    self.limits.append(limit)
                    self.children.append((0, 0))
                    self.children[at] = (self._grow(x[~right], depth + 1), self._grow(x[right], depth + 1))
                    return at
        self.leaves += 1
        return -self.leaves

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = -node - 1
                elif len(rows):
                    right = x[rows] @ self.normal[node] > self.limits[node]
                    stack += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, take: float) -> list[int]:
        """Leaves for one query, best margin first over all trees, until they hold ``take`` vectors."""
        margin = self.normal @ x - np.array(self.limits) if len(self.limits) else np.zeros(0)
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < take:
            worst, node = heapq.heappop(queue)
            while node >= 0:
                left, right = self.children[node]
                near, far = (right, left) if margin[node] > 0 else (left, right)
                heapq.heappush(queue, (max(worst, abs(margin[node])), far))
                node = near
            found.append(-node - 1)
            held += sizes[-node - 1]
        return found


def probes_of(forest: Forest, part: dict, sizes: np.ndarray, salts: np.ndarray, take: float) -> Iterator[dict]:
    """leaf, salt, q, vec of the leaves that each query of the batch visits, in batches of at most about PROBED bytes of vectors."""
    out: dict[str, list] = {"leaf": [], "salt": [], "q": [], "vec": []}
    for q, vec, x in zip(part["q"].to_pylist(), part["vec"].to_pylist(), unit(matrix(part["vec"])) if len(part["vec"]) else ()):
        for at in forest.search(x, sizes, take):
            for salt in range(salts[at]):
                for name, value in zip(out, (at, salt, q, vec)):
                    out[name].append(value)
                if len(out["vec"]) * len(vec) >= PROBED:
                    yield out
                    out = {name: [] for name in out}
    yield out


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf: int = LEAF, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of table found nearest to each row of queries (vec_id, embedding)."""
    scratch = Scratch(table.sparkSession)
    empty = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = scratch.stage(valid_vectors(table).distinct(), "vectors")
    lengths = whole.groupBy(F.length("vec").alias("l")).count().orderBy(F.desc("count"), "l").head()
    if lengths is None:
        return empty
    length, n = lengths
    whole = whole.where(F.length("vec") == length)
    asked = scratch.stage(valid_vectors(queries).where(F.length("vec") == length).distinct(), "queries")
    # of equal vectors the smallest ids; the window's limit is applied before its shuffle
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows = scratch.stage(whole.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "classes")
    every = max(1, -(-n // SAMPLE))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE).collect()
    if not picked:
        picked = rows.select("vec").limit(SAMPLE).collect()
    sample = unit(np.frombuffer(b"".join(sorted(bytes(r[0]) for r in picked)), np.float64).reshape(len(picked), -1))
    forest = Forest(sample, trees, max(8, leaf * len(picked) // n))

    def index(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            if len(part["vec_id"]):
                leaves = forest.home(unit(matrix(part["vec"])))
                which = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                yield {"leaf": leaves.ravel(), "vec_id": part["vec_id"].take(pa.array(which)), "vec": part["vec"].take(pa.array(which))}

    placed = map_texts(rows, ["vec_id", "vec"], index, "leaf int, vec_id long, vec binary", "vec")
    sizes = np.zeros(forest.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row per leaf, a number the sample bounds
        sizes[r["leaf"]] = r["count"]
    salts = np.maximum(1, -(-sizes // GROUP))
    take = share * sizes.sum() / trees

    def probe(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            yield from probes_of(forest, part, sizes, salts, take)

    def salted(parts: Iterator[dict]) -> Iterator[dict]:
        for part in index(parts):
            ids = np.asarray(part["vec_id"]).astype(np.uint64)
            yield part | {"salt": ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % salts[part["leaf"]]}

    # what is found names its query by a number, as the vector would be most of each row
    numbers = scratch.stage(asked.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()), "numbers")
    probes = map_texts(numbers, ["q", "vec"], probe, "leaf int, salt int, q long, vec binary", "vec")
    targets = map_texts(rows, ["vec_id", "vec"], salted, "leaf int, salt int, vec_id long, vec binary", "vec")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        queried, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            q, c = matrix(left.column("vec")), matrix(right.column("vec"))
            names = right.column("vec_id").to_numpy()
            repeated = len(np.unique(names)) < len(names)
            norm_q, norm_c = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
            uq, uc = q / norm_q[:, None], c / norm_c[:, None]
            for at in range(0, len(q), 256):
                near = uq[at : at + 256] @ uc.T
                for i, row in enumerate(near, at):
                    # a repeated id takes one place only, so no row may be left out before
                    best = np.arange(len(row)) if repeated else np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)] - 1e-9) if len(row) > k + 1 else np.arange(len(row))
                    exact = (c[best] * q[i]).sum(axis=1) / (norm_c[best] * norm_q[i])
                    order = np.lexsort((names[best], -exact))
                    if repeated:
                        order = order[np.sort(np.unique(names[best][order], return_index=True)[1])]
                    order = order[: k + 1]
                    queried += [i] * len(order)
                    ids.append(names[best][order])
                    scores.append(exact[order])
        none = np.zeros(0)
        return pa.table({"q": left.column("q").take(pa.array(queried, pa.int64())), "vec_id": np.concatenate([none.astype(np.int64), *ids]), "score": np.concatenate([none, *scores])})

    found = probes.groupBy("leaf", "salt").cogroup(targets.groupBy("leaf", "salt")).applyInArrow(compare, "q long, vec_id long, score double")
    # a candidate comes from several trees, with the same score
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    found = scratch.stage(found.drop("at"), "found")
    own = asked.withColumnRenamed("vec_id", "query_id").join(numbers, "vec").drop("vec").join(found, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
