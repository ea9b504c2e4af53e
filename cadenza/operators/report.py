"""Section reports and corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza.operators import sequence as seq


def marker_sections(frames: DataFrame, size: int | None = None) -> DataFrame:
    """Sections from frame markers: consecutive marked frames with the same label."""
    f = frames.where("section is not null and section <> ''").selectExpr(
        "song_id", "frame_idx", "time", "duration", "section")
    # marked frames are numbered anew, as frames without a section leave gaps
    f = seq.running_sum(f.selectExpr("*", "1 as one"), "frame_idx", "one", "at", size).selectExpr("*", "cast(at - 1 as int) as i").drop("one", "at")
    if size is not None:
        f = seq.stage(f)
    m = seq.islands(f, "i", "p.section = section", "struct(section)", "sec", size)
    return seq.sql("""select song_id, sec, first(section) as label, min(time) as start, max(time + duration) as end
                      from {m} group by song_id, sec""", m=m)


# ------------------------------------------------------------------------------ section report

def bar_lines(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars from frames on beat 1: start, end (next bar line or end of song)."""
    return seq.sql("""
        with b as (select song_id, time as start, row_number() over (partition by song_id order by time) - 1 as bar_no
                   from {f} where beat_in_bar = 1),
        z as (select song_id, max(end) as stop from {s} group by song_id)
        select b.song_id, cast(b.bar_no as int) as bar_no, b.start,
               coalesce(lead(b.start) over (partition by b.song_id order by b.bar_no), z.stop) as end
        from b join z on z.song_id = b.song_id""", f=frames, s=segments)


def bar_numerals(bars: DataFrame, segment_rows: DataFrame, sections: DataFrame, params: dict) -> DataFrame:
    """Numerals sounding in every bar of every section; equal neighbours inside a bar collapse.

    A bar that crosses a section border lists, for each of the two sections, only segments that reach into it."""
    from cadenza.operators.evaluate import overlap_join
    least = params["report"]["min_overlap"]
    segs = segment_rows.selectExpr("song_id", "start", "end", "seg", "chord",
                                   "coalesce(display, if(chord_harte = 'N', 'N', '?')) as numeral")
    held = overlap_join(sections.select("song_id", "start", "end", "sec"), segs).selectExpr(
        "song_id", "a.sec as sec", "b.start as start", "b.end as end", "b.seg as seg", "b.numeral as numeral", "b.chord as chord")
    inside = overlap_join(bars, sections).selectExpr("song_id", "a.bar_no as bar_no", "b.sec as sec")
    per_bar = seq.sql(f"""
        with x as (select song_id, b.sec as sec, a.bar_no as bar_no, b.seg as seg, b.numeral as numeral, b.chord as chord
                   from {{j}} where w >= {least}D * (a.end - a.start)),
        d as (select *, lag(numeral) over (partition by song_id, sec, bar_no order by seg) as before from x)
        select song_id, sec, bar_no, array_join(transform(sort_array(collect_list(struct(seg, numeral))), z -> z.numeral), ' ') as numerals,
               array_join(transform(sort_array(collect_list(struct(seg, chord))), z -> z.chord), ' ') as chords
        from d where before is null or before <> numeral group by song_id, sec, bar_no""", j=overlap_join(bars, held))
    return seq.sql("""
        select i.song_id, i.sec, i.bar_no, coalesce(p.numerals, '—') as numerals, coalesce(p.chords, '—') as chords,
               cast(row_number() over (partition by i.song_id, i.sec order by i.bar_no) - 1 as int) as pos
        from {i} i left join {p} p on p.song_id = i.song_id and p.sec = i.sec and p.bar_no = i.bar_no""", i=inside, p=per_bar)


def loops(bar_rows: DataFrame) -> DataFrame:
    """Shortest period of 1, 2, 4 or 8 bars with at least 60 % of bars equal to the bar a period earlier."""
    lags = ", ".join(f"lag(numerals, {p}) over (partition by song_id, sec order by pos) as p{p}" for p in (1, 2, 4, 8))
    same = ", ".join(f"sum(if(numerals = p{p}, 1, 0)) as s{p}" for p in (1, 2, 4, 8))
    pick = " ".join(f"when n >= {2 * p} and s{p} / (n - {p}) >= 0.6 then {p}" for p in (1, 2, 4, 8))
    # a longer period is only tried when the section holds two of it
    return seq.sql(f"""
        with l as (select *, {lags} from {{b}}),
        g as (select song_id, sec, cast(count(*) as int) as n, {same}, transform(sort_array(collect_list(if(pos < 8, struct(pos, numerals), null))),
                     z -> z.numerals) as head from l group by song_id, sec),
        c as (select *, case {pick} end as period from g)
        select song_id, sec, n as bars, period, if(period is null, array(), slice(head, 1, period)) as loop,
               if(period is null, 0D, round((case period when 1 then s1 when 2 then s2 when 4 then s4 else s8 end + period) / n, 2)) as cover from c""",
                   b=bar_rows)


def section_report(frames: DataFrame, segment_rows: DataFrame, events: DataFrame, progressions: DataFrame, params: dict,
                   sections: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """One row per section: bars, loop, key shares, progressions, confident events, low-confidence share."""
    from cadenza.operators.evaluate import overlap_join
    s = seq.stage(marker_sections(frames, size) if sections is None else sections)
    rows = seq.stage(bar_numerals(bar_lines(frames, segment_rows), segment_rows, s, params))
    held = overlap_join(segment_rows.select("song_id", "start", "end", "key", "low_confidence"), s.select("song_id", "start", "end", "sec"))
    keys = seq.sql("""
        with k as (select song_id, b.sec as sec, a.key as key, sum(w) as w, sum(if(a.low_confidence, w, 0D)) as low from {h} group by song_id, b.sec, a.key),
        t as (select song_id, sec, sum(w) as total, sum(low) as low,
                     transform(sort_array(collect_list(struct(-w as neg, key, w))), z -> struct(z.key as key, z.w as w)) as ks from k group by song_id, sec)
        select song_id, sec, transform(ks, z -> struct(z.key as key, z.w / total as share)) as keys, round(low / total, 2) as low_confidence_share from t""",
                   h=held)
    named = overlap_join(progressions.selectExpr("song_id", "start", "end", "name"), s.select("song_id", "start", "end", "sec"))
    names = seq.sql("""select song_id, b.sec as sec, sort_array(collect_set(a.name)) as progressions from {n}
                       where w >= 0.5 * (a.end - a.start) group by song_id, b.sec""", n=named)
    from cadenza.operators.evaluate import point_lookup
    mids = point_lookup(events.where("not low_confidence").selectExpr("song_id", "type", "label", "conf", "event_no", "(start + end) / 2 as at"),
                        s.select("song_id", "start", "end", "sec"))
    evs = seq.sql("""select song_id, i.sec as sec, transform(sort_array(collect_list(struct(p.event_no, p.type, p.label, round(p.conf, 2) as conf))),
                       z -> struct(z.type as type, z.label as label, z.conf as confidence)) as events from {m} where i is not null group by song_id, i.sec""", m=mids)
    bars = seq.sql("""select song_id, sec, transform(sort_array(collect_list(struct(pos, numerals))), z -> z.numerals) as bars
                      from {r} group by song_id, sec""", r=rows)
    return seq.sql("""
        select s.song_id, s.sec, s.label, s.start, s.end, coalesce(b.bars, array()) as bars, coalesce(l.loop, array()) as loop,
               coalesce(l.cover, 0D) as loop_cover, k.keys, coalesce(n.progressions, array()) as progressions,
               coalesce(e.events, array()) as events, k.low_confidence_share
        from {s} s left join {b} b on b.song_id = s.song_id and b.sec = s.sec left join {l} l on l.song_id = s.song_id and l.sec = s.sec
        left join {k} k on k.song_id = s.song_id and k.sec = s.sec left join {n} n on n.song_id = s.song_id and n.sec = s.sec
        left join {e} e on e.song_id = s.song_id and e.sec = s.sec""", s=s, b=bars, l=loops(rows), k=keys, n=names, e=evs)


# ------------------------------------------------------------------------------ documents and summaries

def corpus_summary(segment_rows: DataFrame, global_keys: DataFrame, regions: DataFrame, events: DataFrame, progressions: DataFrame,
                   songs: DataFrame, meters: DataFrame | None = None) -> DataFrame:
    """One row per song: key, regions, share of low-confidence time, event and progression counts; failed songs keep an error row.

    ``meters(song_id, bpm, time_signature, n_bars, tempo_cv, irregular)`` adds tempo, meter and bars where they are known.
    """
    from cadenza import theory as th
    if meters is None:
        meters = songs.where("false").selectExpr("song_id", "0D as bpm", "'' as time_signature", "0 as n_bars", "0D as tempo_cv", "array(0) as irregular")
    return seq.sql(f"""
        with s as (select song_id, count(*) as segments, sum(end - start) as time, sum(if(low_confidence, end - start, 0D)) as low
                   from {{s}} where chord_harte not in ('N', 'X') group by song_id),
        g as (select song_id, key_idx, prob, ambiguous from {{g}} where rank = 0),
        r as (select song_id, transform(sort_array(collect_list(struct(region, key_idx))), z -> z.key_idx) as regions from {{r}} group by song_id),
        e as (select song_id, map_from_entries(sort_array(collect_list(struct(type, n)))) as events
              from (select song_id, type, count(*) as n from {{e}} group by song_id, type) group by song_id),
        p as (select song_id, map_from_entries(sort_array(collect_list(struct(name, n)))) as progressions
              from (select song_id, name, count(*) as n from {{p}} group by song_id, name) group by song_id)
        select a.song_id, {th.key_name('g.key_idx')} as global_key, g.prob as key_p, g.ambiguous, transform(r.regions, k -> {th.key_name('k')}) as key_regions,
               s.segments, round(s.low / s.time, 3) as low_conf_time, coalesce(e.events, map()) as events, coalesce(p.progressions, map()) as progressions,
               round(m.bpm, 2) as bpm, m.time_signature as meter, m.n_bars as bars, round(m.tempo_cv, 4) as tempo_cv,
               cast(size(m.irregular) as int) as irregular_bars, if(g.song_id is null, 'no analysis', null) as error
        from {{a}} a left join g on g.song_id = a.song_id left join s on s.song_id = a.song_id left join r on r.song_id = a.song_id
        left join e on e.song_id = a.song_id left join p on p.song_id = a.song_id left join {{m}} m on m.song_id = a.song_id""",
                   s=segment_rows, g=global_keys, r=regions, e=events, p=progressions, a=songs, m=meters)


def label_lines(segment_rows: DataFrame) -> DataFrame:
    """Segments as ``start<TAB>end<TAB>harte`` lines with three decimals."""
    return segment_rows.selectExpr("song_id", "seg", "concat_ws('\t', format_string('%.3f', start), format_string('%.3f', end), chord_harte) as line")


def write_label_files(segment_rows: DataFrame, path: str) -> None:
    """One text folder per song, lines in time order."""
    (label_lines(segment_rows).repartition("song_id").sortWithinPartitions("song_id", "seg").select("song_id", "line")
     .write.mode("overwrite").partitionBy("song_id").text(path))


def analysis_documents(segment_rows: DataFrame, events: DataFrame, regions: DataFrame, global_keys: DataFrame, progressions: DataFrame) -> DataFrame:
    """Nested JSON result per song."""
    from cadenza import theory as th

    def packed(name: str, order: str, cols: str) -> str:
        by_order = "(l, r) -> case when l.o < r.o then -1 when l.o > r.o then 1 else 0 end"
        return (f"select song_id, transform(array_sort(collect_list(struct({order} as o, struct({cols}) as x)), {by_order}), z -> z.x) as {name} "
                f"from {{{name}}} group by song_id")

    return seq.sql(f"""
        with s as ({packed('segments', 'seg', 'seg, start, end, beats, chord, chord_harte, candidates, key, key_prob, numeral, display, functions, event_ids, confidence, low_confidence, warnings, section, bar')}),
        e as ({packed('events', 'event_no', 'id, type, label, start, end, segs, chords, numerals, functions, conf, low_confidence, rule, evidence, attrs, explains, alternatives, part_of')}),
        r as ({packed('regions', 'region', f"start, end, seg_first, seg_until, {th.key_name('key_idx')} as key, prob")}),
        g as ({packed('keys', '`rank`', f"{th.key_name('key_idx')} as key, prob, ambiguous, source")}),
        p as ({packed('progressions', 'start', 'name, alias, start, end, segs, reference_key, numerals, conf, key_prior_applied')})
        select s.song_id, to_json(struct(g.keys as global_key, r.regions as key_regions, s.segments as segments,
               coalesce(e.events, array()) as events, coalesce(p.progressions, array()) as progressions, '0.1.0' as schema_version)) as doc
        from s left join g on g.song_id = s.song_id left join r on r.song_id = s.song_id left join e on e.song_id = s.song_id
        left join p on p.song_id = s.song_id""", segments=segment_rows, events=events, regions=regions, keys=global_keys, progressions=progressions)
