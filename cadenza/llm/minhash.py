"""Near duplicates by MinHash: fast similarity sketches, banding, and links decided on whole shingle sets.

A fast similarity sketch fills SIZE coordinates in rounds. In round i < SIZE every member of the set is hashed to one
coordinate and a value i + v, 0 <= v < 1; in round SIZE + j every member is placed at coordinate j; a coordinate keeps its
least value. Rounds end once all coordinates are filled, after 2 * SIZE at most, since later values cannot be smaller. A set of
SIZE log SIZE members or more takes one round, so the sketch costs a hash a member instead of SIZE, and the share of equal
coordinates estimates the similarity with the concentration of independent samples.

BANDS bands of SIZE / BANDS coordinates make the candidates: sets of similarity 0.8 share no band with a probability of
(1 - 0.8^4)^32, below 1e-7. Each candidate pair is decided on both whole sets (links.py), so no link is false.

Defined cases: null text and texts without words have an empty set, linked with nothing; fewer words than ``width`` are one
shingle; repeated rows share a component; a component's id is the smallest non-null doc_id in it, a row that has none
keeps null and counts as kept; very long texts are taken whole; an empty table gives no rows; other columns are ignored, whatever
their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, Scratch, map_texts, text_bytes
from .links import Measure, parity, shingle_set, similar_nodes

SIZE = 128
BANDS = 32
_SEEDS = np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SIZE values of a set that is not empty: the round in the high bits, 48 bits of hash below."""
    out = np.full(SIZE, np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 2 * SIZE // len(hashes))  # rounds at once; more rounds than needed change nothing
    done = 0
    while done < 2 * SIZE and (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any():
        rounds = np.arange(done, min(2 * SIZE, done + step))
        x = mixed(hashes[None, :] + _SEEDS[rounds][:, None])
        place = (x >> np.uint64(57)).astype(np.int64)  # 7 bits: SIZE coordinates
        late = rounds >= SIZE
        place[late] = (rounds[late] - SIZE)[:, None]
        np.minimum.at(out, place.ravel(), ((rounds.astype(np.uint64) << np.uint64(48))[:, None] | (x & np.uint64((1 << 48) - 1))).ravel())
        done += len(rounds)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, other for other bands."""
    rows = values.reshape(BANDS, -1)
    out = _SEEDS[:BANDS].copy()
    for k in range(rows.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def prints(docs: DataFrame, width: int) -> DataFrame:
    """row, doc_id, node (digest of the set), n, bits, bands and packed (lower-cased words, compressed) of every row."""
    import xxhash
    import zstandard

    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        rows, pack = RowNumbers(), zstandard.ZstdCompressor(level=3).compress
        with np.errstate(over="ignore"):
            for part in parts:
                words = [(t or b"").lower().split() for t in text_bytes(part["text"])]
                sets = [shingle_set(b" ".join(w), width) for w in words]
                yield {
                    "row": rows.take(len(sets)), "doc_id": part["doc_id"], "node": np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
                    "n": [len(s) for s in sets], "bits": [parity(s) for s in sets], "bands": [band_keys(sketch(s)).tobytes() if len(s) else b"" for s in sets],
                    "packed": [pack(b" ".join(w)) for w in words]}

    return map_texts(docs, ["doc_id", "text"], work, f"row long, doc_id {kind}, node long, n int, bits binary, bands binary, packed binary")


def candidates(table: DataFrame) -> DataFrame:
    """h, node, n: the band keys of every distinct set that is not empty."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            columns = [keys, *(np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "node", "n"])

    return table.where("n > 0").select("node", "n", "bands").dropDuplicates(["node"]).mapInArrow(spread, "h long, node long, n int")


def near_duplicates(docs: DataFrame, width: int = 2, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links join sets of similarity num / den or more."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.stage(prints(docs, width), "prints")
    firsts = table.where("n > 0").groupBy("node").agg(F.min("row").alias("row"))
    texts = table.join(firsts.select("row"), "row", "left_semi").select("node", "n", "bits", "packed")
    roots = similar_nodes(scratch.stage(candidates(table), "candidates"), texts, Measure(width, num, den), scratch)
    least = table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", "component_id")
    out = table.select("doc_id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
with recursive docs as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
shingles as (
  select distinct r, unnest(case when len(words) = 0 then [] when len(words) = 1 then words
    else list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]) end) as s from docs),
sizes as (select r, count(*) as n from shingles group by r),
pairs as (select a.r as a, b.r as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.r < b.r group by all),
links as (
  select a, b from pairs join sizes x on x.r = a join sizes y on y.r = b where 100 * shared >= 80 * (x.n + y.n - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select r as a, r as b from docs union select reach.a, edges.b from reach join edges on edges.a = reach.b)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id, d.doc_id is not distinct from c.component_id as kept
from docs d left join sizes using (r)
join (select reach.a as r, min(o.doc_id) as component_id from reach join docs o on o.r = reach.b group by reach.a) c on c.r = d.r
"""
