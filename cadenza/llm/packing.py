"""Best-fit packing of tokenised documents into sequences of fixed capacity, by bin completion.

The work on rows is distributed; the search sees only how many pieces there are of each length. A capacity of 4096 gives
at most 4096 such numbers, however large the corpus, so they may go through the driver. The search returns patterns: a
multiset of lengths that share a sequence, and how many sequences follow it. Each step uses up a length or at least halves
it, so there are at most about 2.5 patterns per length. A piece then finds its place from its rank among the pieces of
its length; ranks are taken in small salted buckets, so that a length that half of all pieces share is no hot key.

Null texts count as empty: a document of no tokens still has its end id. Rows that repeat are packed once each."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RowNumbers, Scratch, map_texts, text_bytes
from .tokens import WordIds

Filling = tuple[int, ...]
PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut at each multiple of the capacity.

    Columns row (tells repeated rows apart), doc_id, piece, start, length, ids_crc32; with_ids adds the ids as unsigned
    32-bit little-endian bytes. A null text is empty; a null doc_id stays null."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        words, rows, end = WordIds.of(tokenizer), RowNumbers(), int(end_id).to_bytes(4, "little")
        for part in parts:
            texts = [t or b"" for t in text_bytes(part["text"])]
            out: dict[str, list] = {k.split()[0]: [] for k in (PIECE + ", ids binary").split(", ")}
            for row, doc_id, ids in zip(rows.take(len(texts)), part["doc_id"].to_pylist(), words.texts(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (row, doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None)):
                        out[name].append(value)
            yield out

    return map_texts(docs, ["doc_id", "text"], work, PIECE + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 4096, nodes: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to a written table of pieces (row, piece, length).

    ``nodes`` bounds the steps of the search; past it the best packing found so far holds."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan_bins(counts, capacity, nodes)
    # slots of each pattern: the pieces of one length with ranks start .. start + bins * times go to it, times to a bin
    used: dict[int, int] = {}
    slots, first = [], 0
    for bins, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            start = used.get(length, 0)
            slots.append((length, start, times, first, offset))
            used[length] = start + bins * times
            offset += length * times
        first += bins
    slots.sort()
    table = np.array(slots or [(0, 0, 1, 0, 0)], np.int64)
    keys, inner = table[:, 0] << 48, table[:, 1]

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        _, starts, times, firsts, offsets = table[np.searchsorted(keys + inner, (n << 48) + r, "right") - 1].T
        return pd.DataFrame({"sequence_id": firsts + (r - starts) // times, "offset": offsets + (r - starts) % times * n})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    buckets = max(1, sum(counts.values()) // 20_000)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    ranked = keyed.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    return ranked.withColumn("to", placed("length", "rank")).select(*pieces.columns, "to.*")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = Scratch(docs.sparkSession).stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity).drop("row")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), doc_ids and starts of the pieces in order."""
    pieces = Scratch(docs.sparkSession).stage(token_pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces")
    to_ids = F.pandas_udf(lambda parts: parts.map(lambda p: np.frombuffer(b"".join(p), "<u4").astype(np.int32)), "array<int>")
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity entries
    grouped = pack(pieces, capacity).groupBy("sequence_id").agg(inside.alias("p"))
    return grouped.select("sequence_id", to_ids(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


# -- the search ----------------------------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: bins that lengths over capacity - a need, for every a up to half the capacity."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        n[length] += count
    number, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half = capacity // 2
    a = np.arange(1, half + 1)
    large = number[-1] - number[capacity - a + 1]
    middle = number[capacity - a + 1] - number[half + 1]
    room = middle * capacity - (total[capacity - a + 1] - total[half + 1])
    small = total[half + 1] - total[a]
    bound = large + middle + np.maximum(0, -((room - small) // capacity))
    return int(max(-(-total[-1] // capacity), bound.max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over lengths with counts: each length goes into the fullest bins with room, many bins at a time."""
    open_bins: dict[int, list[tuple[int, Filling]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, filling: Filling) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append((bins, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, bins, filling = capacity, -(-left // (capacity // length)), ()
            else:
                room = rooms[at]
                bins, filling = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            times = room // length
            full = min(bins, left // times)
            if full:
                put(room - times * length, full, filling + (length,) * times)
            left -= full * times
            if full < bins and left:
                put(room - left * length, 1, filling + (length,) * left)
                full, left = full + 1, 0
            if full < bins and filling:
                put(room, bins - full, filling)
    return [group for groups in open_bins.values() for group in groups]


def fillings(room: int, lengths: list[int], counts: dict[int, int], width: int) -> list[Filling]:
    """Undominated ways to fill the room beside the largest piece, least waste first.

    Each starts with one of the longest lengths that fit and takes the best exact or nearest completion; among equal
    waste, fewer and longer pieces come first. One that another dominates (its pieces fit into bins as large as the
    other's pieces) is left out."""
    top = bisect_left(lengths, room + 1)
    if not top:
        return [()]
    found: list[Filling] = []
    exact = 0
    for at in range(top - 1, max(-1, top - 1 - 12 * width), -1):
        first = lengths[at]
        filling, left, upto = [first], room - first, at
        while left:
            k = min(bisect_left(lengths, left + 1) - 1, upto)
            while k >= 0 and filling.count(lengths[k]) >= counts[lengths[k]]:
                k -= 1
            if k < 0:
                break
            # of the lengths just below the room, prefer one whose remainder is itself a length
            for j in range(k, max(-1, k - 24), -1):
                rest = left - lengths[j]
                if rest == 0 or (counts.get(rest, 0) > filling.count(rest) + (rest == lengths[j]) and counts[lengths[j]] > filling.count(lengths[j])):
                    k = j
                    break
            filling.append(lengths[k])
            left, upto = left - lengths[k], k
        found.append(tuple(sorted(filling, reverse=True)))
        exact += left == 0
        if exact >= width:
            break
    found = sorted(set(found), key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    kept: list[Filling] = []
    for f in found:
        if not any(dominates(g, f) for g in kept):
            kept.append(f)
        if len(kept) == width:
            break
    return kept


def dominates(one: Filling, other: Filling) -> bool:
    """Whether the pieces of other fit into bins as large as the pieces of one (checked by best fit, so never wrongly true)."""
    rooms = sorted(one)
    for piece in other:
        at = bisect_left(rooms, piece)
        if at == len(rooms):
            return False
        left = rooms.pop(at) - piece
        rooms.insert(bisect_left(rooms, left), left)
    return True


def plan_bins(counts: dict[int, int], capacity: int, nodes: int = 20_000, width: int = 3) -> list[tuple[int, Filling]]:
    """Patterns (bins, lengths) that use every piece once, in as few bins as found.

    Branch and bound on the largest piece left: each branch is one filling around it, used as often as the counts allow.
    A branch is cut when the waste so far leaves no hope of beating the incumbent, which starts as best fit and is
    replaced by every better completion; the search ends at the lower bound or after so many nodes."""
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    fewest, bound, total = sum(b for b, _ in best), lower_bound(counts, capacity), sum(n * x for x, n in counts.items())
    left, lengths = dict(counts), sorted(counts)
    taken: list[tuple[int, Filling]] = []
    waste, spent = 0, 0
    stack: list[list[Filling]] = []

    def use(bins: int, filling: Filling, sign: int) -> None:
        for x in set(filling):
            had = left.get(x, 0)
            left[x] = had - sign * bins * filling.count(x)
            if not had:
                lengths.insert(bisect_left(lengths, x), x)
            elif not left[x]:
                del lengths[bisect_left(lengths, x)]

    def back() -> None:
        nonlocal waste
        bins, filling = taken.pop()
        use(bins, filling, -1)
        waste -= bins * (capacity - sum(filling))

    branch = True
    while fewest > bound and spent < nodes:
        if branch:
            if not lengths:
                fewest, best = sum(b for b, _ in taken), list(taken)
                back()
                branch = False
                continue
            largest = lengths[-1]
            left[largest] -= 1
            options = fillings(capacity - largest, lengths, left, width)
            left[largest] += 1
            stack.append([(largest, *f) for f in reversed(options)])
        options = stack[-1] if stack else None
        if options is None:
            break
        if not options:
            stack.pop()
            if not taken:
                break
            back()
            branch = False
            continue
        filling = options.pop()
        spent += 1
        bins = min(left[x] // filling.count(x) for x in set(filling))
        lost = bins * (capacity - sum(filling))
        if not bins or waste + lost > (fewest - 1) * capacity - total:
            branch = False
            continue
        use(bins, filling, 1)
        taken.append((bins, filling))
        waste += lost
        branch = True
    return best
