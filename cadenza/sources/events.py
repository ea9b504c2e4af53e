"""Chord frames derived from the ``events`` table: one user is one song, one event one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza import theory as th
from cadenza.operators import sequence as seq


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", "event_id", "event_type", "ts", "props")


def _positions(e: DataFrame, size: int | None) -> DataFrame:
    """frame_idx and start_beat along each song in (ts, event_id) order."""
    upto = "order by ts, event_id rows between unbounded preceding and current row"
    if size is None:
        return e.selectExpr("*", "cast(row_number() over (partition by song_id order by ts, event_id) - 1 as int) as frame_idx",
                            f"cast(sum(beats) over (partition by song_id {upto}) - beats as int) as start_beat")
    # Long songs: rank inside time buckets, then add what earlier buckets hold.
    cols = ", ".join(f"r.{c}" for c in e.columns)
    return seq.sql(f"""
        with b as (select *, date_trunc('hour', ts) as slot from {{e}}),
             r as (select *, row_number() over (partition by song_id, slot order by ts, event_id) as n,
                          sum(beats) over (partition by song_id, slot {upto}) as s from b),
             t as (select song_id, slot, count(*) as n, sum(beats) as s from b group by song_id, slot),
             c as (select song_id, slot,
                          sum(n) over (partition by song_id order by slot rows between unbounded preceding and current row) - n as n0,
                          sum(s) over (partition by song_id order by slot rows between unbounded preceding and current row) - s as s0
                   from t)
        select {cols}, cast(r.n - 1 + c.n0 as int) as frame_idx, cast(r.s - r.beats + c.s0 as int) as start_beat
        from r join c on c.song_id = r.song_id and c.slot = r.slot""", e=e)


def chord_frames(events: DataFrame, size: int | None = None) -> DataFrame:
    """Integer-only chord frames: two candidates per frame with permille weights."""
    e = (events.selectExpr("user_id as song_id", "event_id", "event_type", "ts",
                           "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k",
                           "cast(1 + event_id % 4 as int) as beats"))
    return (_positions(e, size)
            .selectExpr("*", "k % 7 as g", "500 + 10 * (k % 50) as p1",
                        "cast((song_id + if(song_id % 3 = 0 and frame_idx >= 30, 2, 0)) % 12 as int) as tonic")
            .selectExpr("*", f"cast((tonic + {th.pick([0, 5, 7, 9, 2, 4, 11], 'g')}) % 12 as int) as r1",
                        "case when k >= 97 then 'N' when event_type = 'error' then '7' "
                        "when event_type = 'purchase' then 'min' when event_type = 'signup' then "
                        "case when g <= 2 then 'maj' when g <= 5 then 'min' else 'dim' end else "
                        "case when g <= 1 then 'maj7' when g = 2 then '7' when g <= 5 then 'min7' else 'hdim7' end end as q1")
            .selectExpr("song_id", "frame_idx", "event_id", "start_beat", "beats", "tonic",
                        "if(q1 = 'N', null, r1) as root1", "q1", "cast(p1 as int) as p1_permille",
                        "case when q1 = 'N' then null when q1 in ('maj', 'maj7', '7') then (r1 + 9) % 12 "
                        "else (r1 + 3) % 12 end as root2",
                        "case when q1 = 'N' then null when q1 in ('maj', 'maj7', '7') then 'min' else 'maj' end as q2",
                        "if(q1 = 'N', 0, cast((1000 - p1) / 10 * 6 as int)) as p2_permille",
                        "cast(floor(start_beat / 4) as int) + 1 as bar",
                        "if(floor(frame_idx / 16) % 2 = 0, 'Verse', 'Chorus') as section",
                        "event_id % 5 = 0 and q1 <> 'N' as corrupt"))


def as_frames(view: DataFrame, kind: str = "soft") -> DataFrame:
    """Recognition frames over the view.

    ``soft``: both candidates; ``reference``: first chord, probability 1; ``estimate``: the
    reference with the corrupt frames replaced by their second chord.
    """
    def label(n: int) -> str:
        return f"if(q{n} = 'N', 'N', concat({th.note_name(f'root{n}')}, ':', q{n}))"

    one = "struct({} as label, cast({} as double) as prob)"
    if kind == "soft":
        first = one.format(label(1), "p1_permille / 1000.0D")
        cands = f"if(q1 = 'N', array({first}), array({first}, {one.format(label(2), 'p2_permille / 1000.0D')}))"
    elif kind == "reference":
        cands = f"array({one.format(label(1), '1')})"
    else:
        cands = f"array({one.format(f'if(corrupt, {label(2)}, {label(1)})', '1')})"
    return view.selectExpr(
        "song_id", "frame_idx", "cast(start_beat as double) as time", "cast(beats as double) as duration",
        "cast(beats as double) as beats", "bar", "cast(start_beat % 4 + 1 as double) as beat_in_bar", "section",
        "'beat' as time_unit", f"{cands} as candidates")


def given_keys(view: DataFrame) -> DataFrame:
    """The key told to the analysis: song_id mod 12, major."""
    return view.select("song_id").distinct().selectExpr("song_id", "cast(song_id % 12 as int) as key_idx")
