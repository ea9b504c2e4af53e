"""Removal of repeated passages: every window of consecutive words that stands anywhere else too, by sharded FM-indexes.

A shard must hold all places of a window. So windows are dealt out by their minimizer, the least hash of their 4-word
grams: equal windows have equal minimizers. Neighbouring windows mostly share it, so a text falls into runs of windows
(about 16 each), and a run is what travels. Steps:

1. One scan marks which minimizers occur twice in a table of 2**27 flags (16 MB, whatever the corpus; two minimizers on
   one flag only let more runs through).
2. A second scan writes the runs whose minimizer may repeat: document, place, minimizer and a 128-bit hash of the words,
   but no text. Equal runs are counted together before they are shuffled; one document of each supplies the words.
3. Each shard builds an FM-index of its distinct runs (suffix sorting, the Burrows-Wheeler transform in a wavelet matrix of
   bit vectors with rank counts) and streams the same runs through it by backward search. The suffix-array interval of a
   match gives its number of places, weighted by how often a run occurs. Matches of at least a window's length with two
   places or more are reported.
4. The reported windows go back to all documents that hold the run, and the covered words are removed.

A minimizer with very many different runs is split by a hash of the whole window, so its shard stays bounded.

Defined cases: null text has no words; repeated rows are documents of their own, so each is another place of all its
windows; texts shorter than a window lose nothing; windows are judged on the input, not on what is left."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, set_aside, text_bytes

CELLS = 27  # bits of a minimizer that choose its flag
LONGEST = 256  # windows in a run
SHARD_WORDS = 600_000
HOT = 20_000  # different runs of one minimizer in a shard


def runs_of(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer, whether the minimizer may stand in it twice) of each run of a text."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, bool))
    span = 1 << (window - 3).bit_length() - 1  # grams looked at: a power of two; the rest of the window is one gram
    gram = window - span + 1
    with np.errstate(over="ignore"):
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = h[: len(h) - gram + 1].copy()
        for k in range(1, gram):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - gram + 1 + k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
    tied, size = np.zeros(len(mixed), bool), 1
    while size < span:
        a, b, ta, tb = mixed[:-size], mixed[size:], tied[:-size], tied[size:]
        mixed, tied = np.minimum(a, b), np.where(a < b, ta, np.where(b < a, tb, True))
        size *= 2
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(mixed[1:], mixed[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, n))
    twice = np.logical_or.reduceat(tied, starts) | (lengths > span)
    minimizer = mixed[starts]
    if lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        which = np.repeat(np.arange(len(starts)), parts)
        inner = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        starts, lengths = starts[which] + inner, np.minimum(LONGEST, lengths[which] - inner)
        minimizer, twice = minimizer[which], twice[which]
    return starts, lengths, minimizer, twice


# -- the index -------------------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """A sequence of numbers as one bit vector per binary digit, with rank."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for digit in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (values >> digit & 1).astype(np.uint8)
            words = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, np.uint8)), bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((digit, words, before.astype(np.int32), len(bits) - int(bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        self.first = self.place(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the prefix of length at, of each symbol, in the last level's order."""
        for digit, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> digit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first at values."""
        return self.place(symbols, at) - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the compared length until all differ (a text's last symbol is its own)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, size = rank.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - size if size < n else 0] += rank[size:] + 1
        order = np.argsort(key)
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        size *= 2


class FmIndex:
    """Counts, by weight, the places of word sequences in many pieces. Each piece ends in a separator of its own."""

    def __init__(self, pieces: list[np.ndarray], weights: np.ndarray, words: int):
        """Words are numbered from 0; pieces get separators below them."""
        p = len(pieces)
        lengths = np.array([len(x) for x in pieces], np.int64)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        self.text = np.empty(int(lengths.sum()) + p, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.start + lengths] = False
        self.text[inside] = np.concatenate(pieces) + p
        self.text[~inside] = np.arange(p)
        order = suffix_array(self.text)
        self.transform = WaveletMatrix(self.text[order - 1], p + words)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=p + words))])
        owner = np.repeat(np.arange(p), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol on their left."""
        first = self.before[symbols]
        return first + self.transform.rank(symbols, low), first + self.transform.rank(symbols, high)

    def matched(self, piece: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Leftmost place to which each match, starting at word ``at`` of its piece, keeps two places; never past ``stop``.

        All searches take their steps together; one that has lost its second place drops out."""
        reached = at + 1
        going = np.arange(len(piece))
        low, high = np.zeros(len(piece), np.int64), np.full(len(piece), len(self.text), np.int64)
        at = at.copy()
        while len(going):
            low, high = self.extend(self.text[self.start[piece] + at], low, high)
            alive = self.weight[high] - self.weight[low] >= 2
            reached[going[alive]] = at[alive]
            alive &= at > stop
            going, piece, at, stop, low, high = (x[alive] for x in (going, piece, at, stop, low, high))
            at = at - 1
        return reached

    def repeated(self, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges (piece, from, to) of window starts whose windows have two places or more.

        A first search runs from each piece's end leftwards as far as the match keeps two places: all windows inside are
        repeated. The windows before it are then searched one by one, all at once."""
        pieces = np.arange(len(lengths))
        windows = lengths - window + 1
        reached = self.matched(pieces, lengths - 1, np.zeros(len(lengths), np.int64))
        settled = np.minimum(reached, windows)  # windows from here on are repeated
        which = np.repeat(pieces, settled)
        first = np.arange(len(which)) - np.repeat(np.cumsum(settled) - settled, settled)
        again = self.matched(which, first + window - 1, first) == first
        which, first = np.concatenate([which[again], pieces]), np.concatenate([first[again], settled])
        last = np.concatenate([first[: int(again.sum())] + 1, windows])
        order = np.lexsort((first, which))
        order = order[last[order] > first[order]]
        which, first, last = which[order], first[order], last[order]
        # neighbouring ranges of a piece become one
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (first[1:] != last[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(which)) - 1
        return which[starts], first[starts], last[ends] if len(ends) else last


# -- the steps -------------------------------------------------------------------------------------------------------------


def _flags(docs: DataFrame, window: int) -> np.ndarray:
    """One bit per flag: whether more than one run falls on it."""

    def count(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            seen = [(m, t) for t in text_bytes(part["text"]) if t for _, _, m, t in (runs_of(t.split(), window),)]
            cells = np.concatenate([m for m, _ in seen] or [np.zeros(0, np.uint64)]) >> np.uint64(64 - CELLS)
            twice = np.concatenate([t for _, t in seen] or [np.zeros(0, bool)])
            cell, which = np.unique(cells, return_inverse=True)
            yield {"cell": cell.astype(np.int32), "n": np.minimum(2, np.bincount(which, weights=1 + twice)).astype(np.int32)}

    counted = map_texts(docs, ["text"], count, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    block = 1 << 13  # flags to a row

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(block, np.uint8)
        bits[table.column("cell").to_numpy() % block] = 1
        return pa.table({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    packed = counted.select("cell", (F.col("cell") / block).cast("int").alias("block")).groupBy("block").applyInArrow(pack, "block int, bits binary")
    flags = np.zeros((1 << CELLS) // 8, np.uint8)
    for row in packed.collect():  # at most 2**14 rows of 1 kB
        flags[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return flags


RUN = "doc_id long, tkey long, start int, windows int, minimizer long, twice boolean, content binary"


def _candidates(docs: DataFrame, window: int, flags) -> DataFrame:
    def work(parts: Iterator[dict]) -> Iterator[dict]:
        import xxhash

        marked = flags.value
        for part in parts:
            out: dict[str, list] = {k.split()[0]: [] for k in RUN.split(", ")}
            for doc_id, tkey, text in zip(part["doc_id"].to_pylist(), part["tkey"].to_pylist(), text_bytes(part["text"])):
                words = text.split() if text else []
                starts, lengths, minimizer, twice = runs_of(words, window)
                cell = minimizer >> np.uint64(64 - CELLS)
                may = (marked[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if not may.any():
                    continue
                starts, lengths = starts[may], lengths[may]
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                joined = b" ".join(words)
                left, right = np.append(0, ends)[starts].tolist(), (ends[starts + lengths + window - 2] - 1).tolist()
                out["content"] += [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(left, right)]
                out["start"] += starts.tolist()
                out["windows"] += lengths.tolist()
                out["minimizer"] += minimizer[may].view(np.int64).tolist()
                out["twice"] += twice[may].tolist()
                out["doc_id"] += [doc_id] * len(starts)
                out["tkey"] += [tkey] * len(starts)
            yield out

    return map_texts(docs, ["doc_id", "tkey", "text"], work, RUN)


def _same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tkey"] == b["tkey"])


def repeated_windows(docs: DataFrame, window: int = 35, hot: int = HOT) -> DataFrame:
    """doc_id, tkey (hash of the text) and ranges, the (from, to) pairs of window starts that are repeated."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").where("text is not null")
    flags = spark.sparkContext.broadcast(_flags(docs, window))  # 16 MB at any size
    runs = scratch.stage(_candidates(docs, window, flags), "runs")
    whose = F.min(F.struct("doc_id", "tkey", "start")).alias("whose")
    kinds = runs.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.first("windows").alias("windows"), whose)
    kinds = scratch.stage(kinds, "kinds")
    totals = kinds.groupBy("minimizer").agg(F.sum("n").alias("places"), F.count("*").alias("contents"), F.max("twice").alias("any_twice"))
    totals = totals.where("places > 1 or any_twice").drop("places", "any_twice")
    wanted = scratch.stage(kinds.drop("twice").join(totals, "minimizer"), "wanted")
    words = wanted.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))

    def cut(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            out: dict[str, list] = {"shard": [], "minimizer": [], "content": [], "offset": [], "n": [], "words": []}
            for text, wants in zip(text_bytes(part["text"]), part["wants"].to_pylist()):
                all_words = text.split()
                for w in wants:
                    first, upto = w["start"], w["start"] + w["windows"]
                    salts = -(-w["contents"] // hot)
                    pieces = [(first, upto, 0)]
                    if salts > 1:
                        salt = [zlib.crc32(b" ".join(all_words[k : k + window])) % salts for k in range(first, upto)]
                        cuts = [0, *(k for k in range(1, len(salt)) if salt[k] != salt[k - 1]), len(salt)]
                        pieces = [(first + a, first + b, salt[a]) for a, b in zip(cuts, cuts[1:])]
                    for a, b, s in pieces:
                        out["shard"].append((w["minimizer"] % 1_000_003 + s) % shards)
                        out["minimizer"].append(w["minimizer"])
                        out["content"].append(w["content"])
                        out["offset"].append(a - first)
                        out["n"].append(w["n"])
                        out["words"].append(b" ".join(all_words[a : b + window - 1]))
            yield out

    wants = wanted.groupBy(F.col("whose.doc_id").alias("doc_id"), F.col("whose.tkey").alias("tkey"))
    wants = wants.agg(F.collect_list(F.struct("whose.start", "windows", "minimizer", "content", "n", "contents")).alias("wants"))
    sources = docs.join(wants, _same_document(docs, wants)).select("text", "wants")
    pieces = map_texts(sources, ["text", "wants"], cut, "shard int, minimizer long, content binary, offset int, n long, words binary")

    def search(table: pa.Table) -> pa.Table:
        rows, names = {}, {}
        # a document that stands in several rows supplies its runs more than once
        for row in zip(*(table.column(c).to_pylist() for c in ("minimizer", "content", "offset", "n", "words"))):
            rows.setdefault(row[:3], row[3:])
        pieces = [np.array([names.setdefault(w, len(names)) for w in words.split()], np.int64) for _, words in rows.values()]
        lengths = np.array([len(p) for p in pieces], np.int64)
        which, first, last = FmIndex(pieces, np.array([n for n, _ in rows.values()], np.int64), len(names)).repeated(lengths, window)
        keys = list(rows)
        out = [(*keys[p][:2], keys[p][2] + a, keys[p][2] + b) for p, a, b in zip(which.tolist(), first.tolist(), last.tolist())]
        m, c, a, b = zip(*out) if out else ((), (), (), ())
        return pa.table({"minimizer": pa.array(m, pa.int64()), "content": pa.array(c, pa.binary()), "first": pa.array(a, pa.int32()), "last": pa.array(b, pa.int32())})

    found = pieces.groupBy("shard").applyInArrow(search, "minimizer long, content binary, first int, last int")
    found = scratch.stage(found.groupBy("minimizer", "content").agg(F.collect_list(F.struct("first", "last")).alias("found")), "found")
    placed = runs.join(found, ["minimizer", "content"]).select("doc_id", "tkey", F.expr("transform(found, f -> struct(start + f.first as `from`, start + f.last as `to`))").alias("ranges"))
    out = scratch.stage(placed.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    scratch.drop(runs, kinds, wanted, found)
    return out


def remove_repeats(docs: DataFrame, window: int = 35, hot: int = HOT, spaced: bool = False) -> DataFrame:
    """All columns of docs, with text cut down to the kept words, and n_words, n_removed, kept_sha256.

    Kept words are joined by one space, or with spaced keep the white space that stood before each of them. Columns of docs
    that clash with names used here come back as ``in:`` and their name (common.put_back)."""
    import re

    ranges = repeated_windows(docs, window, hot)
    docs = set_aside(docs, {"tkey", "ranges", "n_words", "n_removed", "kept_sha256"})
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    keyed = docs.withColumn("tkey", F.xxhash64("text"))
    joined = keyed.join(ranges, _same_document(keyed, ranges), "left").select(*[keyed[f"`{c}`"] for c in names], "ranges")

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            texts, all_words, removed, digests = [], [], [], []
            for text, found in zip(text_bytes(part["text"]), part["ranges"].to_pylist()):
                words = text.split() if text else []
                cover = np.zeros(len(words) + 1, np.int64)
                for r in found or ():
                    cover[r["from"]] += 1
                    cover[min(len(words), r["to"] + window - 1)] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k]) if found else b" ".join(words)
                all_words.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if not removed[-1]:
                    kept = text
                elif spaced:
                    kept = b"".join([w for w, k in zip(re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text), keep.tolist()) if k]).lstrip()
                texts.append(kept)
            yield {c: part[c] for c in names if c != "text"} | {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": all_words, "n_removed": removed, "kept_sha256": digests}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_words long", "n_removed long", "kept_sha256 string"])
    return map_texts(joined, [f"`{c}`" for c in [*names, "ranges"]], work, schema)


#: The same in DuckDB for windows of 35 words; a row is a document, so rows are numbered first.
SQL = r"""
with numbered as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
windows as (select r, unnest(range(1, len(words) - 33)) as spot from numbered),
hashed as (select w.r, w.spot, sha256(array_to_string(list_slice(n.words, w.spot, w.spot + 34), ' ')) as h from windows w join numbered n using (r)),
repeated as (select r, spot from hashed where h in (select h from hashed group by h having count(*) > 1)),
covered as (select distinct r, unnest(range(spot, spot + 35)) as spot from repeated),
gone as (select r, list(spot) as places, count(*) as n from covered group by r)
select n.doc_id, cast(len(n.words) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when g.r is null then n.words
    else list_filter(n.words, lambda w, i: not list_contains(g.places, i)) end, ' '), '')) as kept_sha256
from numbered n left join gone g using (r)"""
