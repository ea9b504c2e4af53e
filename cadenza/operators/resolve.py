"""Competing explanations of one chord: keep the strongest, remember the losers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza.operators import sequence as seq

FUNCTIONAL = ["ii_V_I", "ii_V", "secondary_dominant", "secondary_leading_tone", "tritone_sub"]

_RANK = ("if(type = 'borrowed_chord' or (type = 'secondary_dominant' and coalesce(attrs['resolution'], '') <> 'resolved'), 1, 2)")
_RULE = "case type when 'ii_V' then 'ii_V_I' else type end"


def _agree(a: str, b: str) -> str:
    """The V7/x of a ii-V into x is the same reading, not a rival."""
    def pair(ii: str, sd: str) -> str:
        return f"({ii}.type in ('ii_V_I', 'ii_V') and {sd}.type = 'secondary_dominant' and {sd}.explains[0] = {ii}.segs[1])"

    return f"coalesce({pair(a, b)} or {pair(b, a)}, false)"


def resolve_events(events: DataFrame, params: dict, size: int | None = seq.BLOCK_ROWS) -> DataFrame:
    """Greedy by (rank, confidence) over shared explained segments.

    Claims only meet on common segments, so each stretch of overlapping claims is folded on its own
    and songs of any length are split exactly.
    """
    g = params["general"]
    e = seq.sql(f"""
        select * from (
          select *, row_number() over (partition by song_id, type, segs order by conf desc, rule_no, run) as copy, {_RANK} as rank
          from {{e}} where conf >= {g['min_event_confidence']}D) where copy = 1""", e=events).drop("copy")
    e = seq.stage(e, size)
    alt = "struct<type:string,label:string,confidence:double,rule:string>"
    slim = "struct<a:int,b:double,rule_no:int,run:int,type:string,segs:array<int>,explains:array<int>,label:string"
    fold = f"""aggregate(
        sort_array(collect_list(struct(-rank as a, -conf as b, rule_no, run, type, segs, explains, label))),
        cast(array() as array<{slim},alternatives:array<{alt}>>>),
        (acc, z) -> transform(array(get(flatten(transform(z.explains, x -> filter(acc,
                        w -> array_contains(w.explains, x) and not {_agree('w', 'z')}))), 0)),
            rival -> if(rival is null,
                concat(acc, array(struct(z.a as a, z.b as b, z.rule_no as rule_no, z.run as run, z.type as type,
                    z.segs as segs, z.explains as explains, z.label as label, cast(array() as array<{alt}>) as alternatives))),
                transform(acc, w -> if(w.rule_no = rival.rule_no and w.run = rival.run and w.type = rival.type,
                    struct(w.a as a, w.b as b, w.rule_no as rule_no, w.run as run, w.type as type, w.segs as segs,
                           w.explains as explains, w.label as label, concat(w.alternatives, array(struct(z.type as type,
                           z.label as label, -z.b as confidence, z.type as rule))) as alternatives), w))))[0])"""
    claimed = seq.sql(f"""
        with c as (select song_id, run, rule_no, type, label, segs, explains, conf, rank, array_min(explains) as lo,
                          array_max(explains) as hi from {{e}} where size(explains) > 0),
        b as (select *, max(hi) over (partition by song_id order by lo, hi rows between unbounded preceding and 1 preceding)
                          as before from c),
        s as (select *, sum(if(before >= lo, 0, 1)) over (partition by song_id order by lo, hi
                          rows between unbounded preceding and current row) as grp from b),
        f as (select song_id, explode({fold}) as x from s group by song_id, grp)
        select song_id, x.run as run, x.type as type, x.alternatives as alternatives from f""", e=e)
    cols = ", ".join(f"e.{c}" for c in e.columns)
    return seq.sql(f"""
        select {cols}, c.alternatives from {{e}} e join {{c}} c on c.song_id = e.song_id and c.run = e.run and c.type = e.type
        union all
        select {cols}, cast(array() as array<{alt}>) from {{e}} e where size(explains) = 0""", e=e, c=claimed)


def number_events(kept: DataFrame, params: dict, size: int | None = seq.BLOCK_ROWS) -> DataFrame:
    """Order events in time, give them ids, flag low confidence and link V7/x to its ii-V."""
    thr = params["general"]["low_confidence_threshold"]
    n = seq.stage(seq.sql(f"""
        select *, cast(row_number() over (partition by song_id order by start, if(type = 'modulation', 0, 1), conf desc,
                  rank desc, rule_no, run) - 1 as int) as event_no, conf < {thr}D as low_confidence from {{k}}""", k=kept), size)
    cols = ", ".join(f"e.{c}" for c in kept.columns if c != "rank")
    return seq.sql(f"""
        with p as (select sd.song_id, sd.event_no, max(ii.event_no) as owner
                   from {{n}} sd join {{n}} ii on ii.song_id = sd.song_id and ii.segs[1] = sd.explains[0]
                   where sd.type = 'secondary_dominant' and ii.type in ('ii_V_I', 'ii_V') and ii.attrs['tonicization'] = 'true'
                   group by sd.song_id, sd.event_no)
        select concat('ev', e.event_no) as id, e.event_no, {cols}, e.low_confidence, {_RULE} as rule,
               concat('ev', p.owner) as part_of
        from {{n}} e left join p on p.song_id = e.song_id and p.event_no = e.event_no""", n=n)


def segment_links(events: DataFrame, keyed: DataFrame, display: str) -> DataFrame:
    """Back-links of every segment: event ids in event order and functional labels (no duplicates, not the own numeral)."""
    kinds = ", ".join(f"'{t}'" for t in FUNCTIONAL)
    return seq.sql(f"""
        with x as (select song_id, event_no, id, type, functions, posexplode(segs) as (pos, seg) from {{e}}),
        g as (select song_id, seg, sort_array(collect_list(struct(event_no, pos, id,
                     if(type in ({kinds}), functions[pos], null) as func))) as parts from x group by song_id, seg)
        select g.song_id, g.seg, transform(parts, p -> p.id) as event_ids,
               array_except(array_distinct(array_compact(transform(parts, p -> p.func))), array(coalesce({display}, ''))) as functions
        from g join {{k}} k on k.song_id = g.song_id and k.seg = g.seg""", e=events, k=keyed)
