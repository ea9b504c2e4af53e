"""Ordered-sequence building blocks that survive very long songs.

Normal corpora hold songs of a few hundred rows: one hash partitioning on ``song_id`` serves every
window, join and group.  When a corpus holds a song longer than ``BLOCK_ROWS`` rows (``block_size``
measures this with a map-side count), sequences are cut into blocks ``(song_id, idx div size)``.
Windows then run per block, and what crosses a block edge travels through a join with one row per
block.  Both layouts give the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS = 4096
_LOCAL: list[str] = []  # folder of a local session that names none


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names; local sessions get their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = _LOCAL[0]
    return path


def join_by_measured_size(spark: SparkSession) -> None:
    """Broadcast a table only by the size that adaptive execution measured, never by the size of its files.

    A written table is compressed and pruned, so its estimate says little about its rows: millions of ``(song_id, seg)`` pass for a
    few MB and would be collected by the driver. The session's own threshold goes on to hold for measured sizes.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(planned) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(planned))
        spark.conf.set(planned, "-1")


TASK_ROWS = 20_000  # rows of the input whose derived rows one task should meet at most
TASK_BYTES = 4 << 20
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def deal_by_rows(spark: SparkSession, rows: int) -> None:
    """Let shuffles have partitions in proportion to the input, so that the memory of a task does not grow with it.

    Adaptive execution merges partitions down to one per core as long as they stay below its advisory size. Shuffled songs are
    small, as they are packed and compressed, but are many times larger once their candidates or chords are exploded.
    """
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    have = int(spark.conf.get(FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if have * TASK_ROWS < rows:
        spark.conf.set(FIRST_PARTITIONS, str(-(-rows // TASK_ROWS)))
    if rows > 8 * TASK_ROWS:
        spark.conf.set(advised, f"{TASK_BYTES}b")


def stage(df: DataFrame, size: int | None = BLOCK_ROWS) -> DataFrame:
    """Write a table that several later steps read; cuts the lineage and keeps column pruning.

    Without blocks (``size`` None) whole songs are dealt to buckets, as many as shuffles have partitions: windows, groups and
    joins whose keys hold ``song_id`` then read them as they lie, and nothing is shuffled again.
    """
    spark = df.sparkSession
    join_by_measured_size(spark)
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{staging_dir(spark)}/{name}"
    if size is not None or "song_id" not in df.columns:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # equal songs lie together, so do equal (song_id, seg)
    buckets = int(spark.conf.get(FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, "song_id").write.bucketBy(buckets, "song_id").option("path", path).saveAsTable(name)
    return spark.table(name)


def stage_small(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, bool]:
    """The table, written, and whether it has at most ``rows`` rows, so that a join may be told to broadcast it."""
    written = stage(df)
    return written, written.count() <= rows


def sql(text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over DataFrames named in the text as ``{name}``."""
    return next(iter(tables.values())).sparkSession.sql(text, **tables)


def block_size(rows: DataFrame, key: str = "song_id", limit: int = BLOCK_ROWS) -> int | None:
    """None when every song has at most ``limit`` rows, else the block length to use."""
    long_songs = rows.groupBy(key).count().where(f"count > {limit}")
    return None if long_songs.isEmpty() else limit


def keys(size: int | None) -> list[str]:
    return ["song_id"] if size is None else ["song_id", "blk"]


def with_block(df: DataFrame, idx: str, size: int | None) -> DataFrame:
    return df if size is None else df.selectExpr("*", f"cast({idx} div {size} as int) as blk")


def neighbour(df: DataFrame, idx: str, value: str, name: str, size: int | None, step: int = -1) -> DataFrame:
    """Value of the previous (step -1) or next (+1) row of a densely numbered sequence."""
    fn = "lag" if step < 0 else "lead"
    if size is None:
        return df.selectExpr("*", f"{fn}({value}) over (partition by song_id order by {idx}) as {name}")
    edge = size - 1 if step < 0 else 0
    cols = ", ".join(f"r.{c}" for c in df.columns)
    return sql(f"""
        with r as (select *, cast({idx} div {size} as int) as blk from {{df}}),
             w as (select *, {fn}({value}) over (partition by song_id, blk order by {idx}) as inside from r),
             e as (select song_id, {idx} - ({step}) as {idx}, {value} as across from {{df}} where {idx} % {size} = {edge})
        select {cols}, coalesce(r.inside, e.across) as {name}
        from w r left join e on e.song_id = r.song_id and e.{idx} = r.{idx}""", df=df)


def running_sum(df: DataFrame, idx: str, value: str, name: str, size: int | None) -> DataFrame:
    """Inclusive running sum along a sequence; numbers may be missing, a block carries all blocks before it."""
    over = f"order by {idx} rows between unbounded preceding and current row"
    if size is None:
        return df.selectExpr("*", f"sum({value}) over (partition by song_id {over}) as {name}")
    cols = ", ".join(f"r.{c}" for c in df.columns)
    return sql(f"""
        with r as (select *, cast({idx} div {size} as int) as blk from {{df}}),
             w as (select *, sum({value}) over (partition by song_id, blk {over}) as inside from r),
             t as (select song_id, blk, sum({value}) as total from r group by song_id, blk),
             c as (select song_id, blk, sum(total) over (partition by song_id order by blk
                                                         rows between unbounded preceding and 1 preceding) as before from t)
        select {cols}, r.inside + coalesce(c.before, 0) as {name}
        from w r left join c on c.song_id = r.song_id and c.blk = r.blk""", df=df)


def islands(df: DataFrame, idx: str, same: str, prev: str, island: str, size: int | None) -> DataFrame:
    """Number maximal stretches of rows for which ``same`` holds (``p`` = struct ``prev`` of the row before)."""
    marked = neighbour(df, idx, prev, "p", size).selectExpr(
        *df.columns, f"if(p is null or not coalesce({same}, false), 1, 0) as starts")
    if size is not None:
        marked = stage(marked)
    return running_sum(marked, idx, "starts", island, size).selectExpr(
        *df.columns, f"cast({island} - 1 as int) as {island}")


def orbit(nodes: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """The nodes that are reached from the first one of each song by following ``succ``: ``(song_id, idx)``.

    ``nodes(song_id, idx, succ)``, written; ``succ`` is a larger idx of the song or null. A block of nodes is a function from the node
    by which it is entered to the node by which it is left; only nodes that some block is left by stay for the next round, which
    follows the same way over far fewer nodes. Then every block that is passed marks its own nodes. No task holds more
    than one block.
    """
    import pandas as pd
    kind = nodes.schema["song_id"].dataType.simpleString()
    n = nodes.count()
    ranked = stage(sql(f"""select song_id, cast(idx as bigint) as idx, cast(succ as bigint) as succ, cast((row_number() over (partition by song_id order by idx) - 1) div {size} as int) as blk,
                                  idx = min(idx) over (partition by song_id) as head from {{n}}""", n=nodes))
    # a block is one row, so that Python gets many of them at a time; no successor is -1
    blocks = sql("""select song_id, blk, transform(nodes, x -> x.idx) as idx, transform(nodes, x -> x.succ) as succ, transform(nodes, x -> x.head) as head from (
                      select song_id, blk, sort_array(collect_list(struct(idx, coalesce(succ, -1L) as succ, head))) as nodes from {r} group by song_id, blk)""", r=ranked)

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, succ in zip(pdf["idx"], pdf["succ"]):
                end, left = idx[-1], {}
                for i, s in zip(idx[::-1].tolist(), succ[::-1].tolist()):
                    left[i] = left[s] if 0 <= s <= end else s
                out.append([left[i] for i in idx.tolist()])
            yield pdf[["song_id", "idx", "head"]].assign(succ=out)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, succ, at in zip(pdf["idx"], pdf["succ"], pdf["entry"]):
                following, passed = dict(zip(idx.tolist(), succ.tolist())), []
                while at in following:
                    passed.append(at)
                    at = following[at]
                out.append(passed)
            yield pdf[["song_id"]].assign(idx=out)

    if ranked.where("blk > 0").isEmpty():
        entered = ranked.where("head").selectExpr("song_id", "blk", "idx as entry")
    else:
        packed = blocks.select("song_id", "idx", "succ", "head").mapInPandas(leave, f"song_id {kind}, idx array<bigint>, head array<boolean>, succ array<bigint>")
        left = stage(packed.selectExpr("song_id", "inline(arrays_zip(idx, succ, head))").selectExpr("song_id", "idx", "nullif(succ, -1L) as succ", "head"))
        fewer = stage(sql("""select l.song_id, l.idx, l.succ from {l} l left semi join (
                               select song_id, idx from {l} where head union select song_id, succ from {l} where succ is not null) k
                             on k.song_id = l.song_id and k.idx = l.idx""", l=left))
        passed = orbit(fewer, size if fewer.count() < n else 2 * size)
        entered = sql("""select r.song_id, r.blk, min(r.idx) as entry from {r} r join {p} p on p.song_id = r.song_id and p.idx = r.idx
                         group by r.song_id, r.blk""", r=ranked, p=passed)
    marked = blocks.join(entered, ["song_id", "blk"]).select("song_id", "idx", "succ", "entry")
    return marked.mapInPandas(mark, f"song_id {kind}, idx array<bigint>").selectExpr("song_id", "explode(idx) as idx")
