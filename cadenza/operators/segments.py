"""Frames -> chord segments -> root runs, for all songs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza import theory as th
from cadenza.functions import labels as lb
from cadenza.operators import sequence as seq

FRAME_COLUMNS = {"beats": "double", "bar": "int", "beat_in_bar": "double", "section": "string",
                 "bass_note": "string", "bass_prob": "double", "time_unit": "string"}


def complete(frames: DataFrame) -> DataFrame:
    """Add the optional frame columns that a source does not have."""
    extra = [f"cast({chr(39) + 'second' + chr(39) if n == 'time_unit' else 'null'} as {t}) as {n}"
             for n, t in FRAME_COLUMNS.items() if n not in frames.columns]
    return frames.selectExpr("*", *extra)


def frame_beats(params: dict) -> str:
    """Beats of a frame: stated, else its duration in beats, else seconds at the default tempo."""
    spb = params["general"]["default_seconds_per_beat"]
    return f"greatest(coalesce(beats, if(time_unit = 'beat', duration, duration / {spb}D)), 1e-6D)"


def clean_frames(frames: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """One row per frame with its readable candidates in listed order.

    Unreadable candidates are dropped, masses above one are normalised and a frame left without
    candidates becomes the placeholder ``X`` with probability 0.
    """
    f = complete(frames)
    attrs = ["time", "duration", "beats", "bar", "beat_in_bar", "section", "time_unit"] + (
        ["bass_note", "bass_prob"] if "bass_note" in frames.columns else [])
    dim, few = seq.stage_small(lb.chord_dim(f.selectExpr("explode(candidates.label) as label")))
    rows = seq.sql(f"""
        select {"/*+ broadcast(d) */" if few else ""} f.song_id, f.frame_idx, {', '.join('f.' + a for a in attrs)}, f.pos, f.cand, coalesce(d.ok, false) as good,
               d.root, d.quality, d.bass, d.core_mask, d.harte
        from (select *, posexplode_outer(candidates) as (pos, cand) from {{f}}) f left join {{dim}} d on f.cand.label = d.label
        """, f=f, dim=dim)
    rows = seq.with_block(rows, "frame_idx", size).repartition(*seq.keys(size))
    item = ("struct(pos, cand.label as label, cand.prob as prob, root, quality, bass, core_mask, harte)")
    by = ", ".join(seq.keys(size) + ["frame_idx"])
    scale = "if(mass > 1 + 1e-6D, mass, 1D)"
    return seq.sql(f"""
        with g as (
          select {by}, {', '.join(f'first({a}) as {a}' for a in attrs)}, sum(if(good, cand.prob, null)) as mass,
                 cast(count_if(not good and cand is not null) as int) as n_dropped,
                 sort_array(collect_list(if(good, {item}, null))) as kept
          from {{rows}} group by {by})
        select {by}, {', '.join(attrs)}, n_dropped, coalesce(mass > 1 + 1e-6D, false) as normalised, {frame_beats(params)} as w,
          if(size(kept) > 0,
             transform(kept, c -> struct(c.label as label, c.prob / {scale} as prob, c.root as root, c.quality as quality,
                                         c.bass as bass, c.core_mask as core_mask, c.harte as harte)),
             array(struct('X' as label, 0D as prob, cast(null as int) as root, 'X' as quality, cast(null as int) as bass,
                          0 as core_mask, 'X' as harte))) as cands
        from g""", rows=rows)


def frame_warnings(frames: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """What the cleaning changed, as rows instead of exceptions."""
    return clean_frames(frames, params, size).selectExpr("song_id", "frame_idx", "time", "n_dropped", """
        explode(array_compact(array(
            if(n_dropped > 0, 'dropped unparseable candidate', null),
            if(normalised, 'candidate probabilities normalised', null),
            if(cands[0].harte = 'X', 'no parseable chord candidate', null),
            if(beats is null and time_unit <> 'beat', 'no beat information', null)))) as kind""")


def number_segments(frames: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """Frames with their segment number: equal first candidate and section merge, ``X`` never does."""
    f = clean_frames(frames, params, size)
    f = f.selectExpr(*[c for c in f.columns if c != "blk"], "cands[0].harte as top_harte")
    if size is not None:
        f = seq.stage(f)
    same = "p.top_harte = top_harte and p.section <=> section and top_harte <> 'X'"
    return seq.islands(f, "frame_idx", same, "struct(top_harte, section)", "seg", size)


def build_segments(frames: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """Merge consecutive frames with the same first candidate and section; average candidates by beats.

    One row per segment: span, beats, section, bar, top chord and ``cands`` sorted by probability. Masses are added in the order
    of frames, whatever was spilled or cut into blocks on the way, so that limits like 0.6 are met or missed alike.
    """
    f = number_segments(frames, params, size)
    whole = "" if size is None else "distribute by song_id, seg"  # without blocks a song is in one task already
    has_bass = "bass_note" in f.columns
    extra = f", {lb.note_pc('bass_note')} as bass_pc, coalesce(bass_prob, 1D) * w as bass_mass" if has_bass else ""
    votes = [f"sum(if(pos = 0 and bass_pc = {i}, bass_mass, null)) as b{i}" for i in range(12)] if has_bass else []
    head = f", array({', '.join(f'coalesce(sum(b{i}), 0D)' for i in range(12))}) as votes" if has_bass else ""
    return seq.sql(f"""
        with y as (select song_id, seg, frame_idx, time, duration, w, section, bar{extra}, posexplode(cands) as (pos, c)
                   from {{f}}),
        x as (select *, c.harte as harte from y {whole} sort by song_id, seg, harte, frame_idx, pos),
        by_chord as (
          select song_id, seg, harte, sum(c.prob * w) as pw,
                 min(struct(frame_idx, pos, c.label as label, c.root as root, c.quality as quality, c.bass as bass,
                            c.core_mask as core_mask)) as lead,
                 sum(if(pos = 0, w, null)) as beats,
                 min(if(pos = 0, struct(frame_idx, time, section, bar), null)) as head,
                 max(if(pos = 0, struct(frame_idx, time + duration as until), null)) as tail
                 {''.join(', ' + v for v in votes)}
          from x group by song_id, seg, harte),
        by_seg as (
          select song_id, seg, sum(beats) as beats, min(head) as head, max(tail) as tail,
                 collect_list(struct(pw, lead, harte)) as raw{head}
          from by_chord group by song_id, seg)
        select song_id, seg, head.time as start, tail.until as end, beats, head.section as section, head.bar as bar,
               head.frame_idx as first_frame, tail.frame_idx as last_frame, cands[0] as top, cands,
               {'transform(votes, v -> v / beats)' if has_bass else 'cast(null as array<double>)'} as bass_head
        from (select *, transform(sort_array(transform(raw, r -> struct(
                  -r.pw / beats as neg, r.lead.frame_idx as f, r.lead.pos as pos, r.lead as lead, r.harte as harte))),
                c -> struct(c.lead.label as label, -c.neg as prob, c.harte as harte, c.lead.root as root,
                            c.lead.quality as quality, c.lead.bass as bass, c.lead.core_mask as core_mask)) as cands
              from by_seg)""", f=f)


def bass_vote(segments: DataFrame) -> DataFrame:
    """Most voted bass pitch class and its share per segment (null without a bass head)."""
    return segments.selectExpr(
        "song_id", "seg", "if(array_max(bass_head) > 0, cast(array_position(bass_head, array_max(bass_head)) - 1 as int), null)"
        " as bass_pc", "nullif(array_max(bass_head), 0D) as share")


def add_runs(segments: DataFrame, size: int | None = None) -> DataFrame:
    """Number maximal stretches of segments with the same top root (no-chord counts as one root)."""
    return seq.islands(segments, "seg", "p.root <=> top.root", "struct(top.root as root)", "run", size)


def build_runs(segments_with_run: DataFrame, params: dict) -> DataFrame:
    """One row per run with its navigation state: use, skip (passing) or block (long no-chord)."""
    g = params["general"]
    return seq.sql(f"""
        select *, case when root is null then if(beats < {g['skip_no_chord_beats']}D, 'skip', 'block')
                       when beats < {g['passing_beats']}D then 'skip' else 'use' end as state
        from (select song_id, run, min(seg) as seg_first, max(seg) as seg_last, first(top.root) as root, sum(beats) as beats
              from {{s}} group by song_id, run)""", s=segments_with_run)


def link_runs(runs: DataFrame, size: int | None = None) -> DataFrame:
    """Add prev_run / next_run: nearest usable run that no blocking run separates.

    ``u`` counts usable runs and ``walls`` blocking runs along the song, so the neighbour is the
    usable run whose count differs by one while the wall count is equal.  Short songs find it with
    windows over the count, long ones with equi-joins on (song, count).
    """
    r = seq.running_sum(runs, "run", "if(state = 'use', 1, 0)", "u", size)
    r = seq.running_sum(r, "run", "if(state = 'block', 1, 0)", "walls", size)
    cols = ", ".join(f"r.{c}" for c in runs.columns)
    if size is None:
        near = "struct(run, walls)"
        return seq.sql(f"""
            select {cols}, if(nx.walls = walls, nx.run, null) as next_run, if(pv.walls = walls - if(state = 'block', 1, 0), pv.run, null) as prev_run
            from (select *, last(if(state = 'use', {near}, null), true) over (partition by song_id order by run desc
                              rows between unbounded preceding and 1 preceding) as nx,
                            last(if(state = 'use', {near}, null), true) over (partition by song_id order by run
                              rows between unbounded preceding and 1 preceding) as pv from {{r}}) r""", r=r)
    return seq.sql(f"""
        select {cols}, n.run as next_run, p.run as prev_run from {{r}} r
        left join {{r}} n on n.song_id = r.song_id and n.state = 'use' and n.u = r.u + 1 and n.walls = r.walls
        left join {{r}} p on p.song_id = r.song_id and p.state = 'use'
             and p.u = r.u - if(r.state = 'use', 1, 0) and p.walls = r.walls - if(r.state = 'block', 1, 0)""", r=seq.stage(r))


def seg_candidates(segments: DataFrame, *extra: str) -> DataFrame:
    """Exploded candidates of the segments."""
    return (segments.selectExpr("song_id", "seg", *extra, "posexplode(cands) as (rank, c)")
            .selectExpr("song_id", "seg", *extra, "rank", "c.label", "c.prob", "c.harte", "c.root", "c.quality", "c.bass",
                        "c.core_mask", f"{th.qclass('c.quality')} as qclass"))
