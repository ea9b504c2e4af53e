"""The whole analysis of a corpus: frames in, tables of segments, keys, events and progressions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cadenza import params as P
from cadenza import theory as th
from cadenza.operators import evidence as evd
from cadenza.operators import idioms as idm
from cadenza.operators import keys as ky
from cadenza.operators import resolve as rs
from cadenza.operators import rules
from cadenza.operators import segments as sg
from cadenza.operators import sequence as seq


@dataclass
class Analysis:
    """Staged tables of one run; every one is keyed by song_id."""

    segments: DataFrame
    runs: DataFrame
    keys: DataFrame
    keyed: DataFrame
    regions: DataFrame
    global_keys: DataFrame
    progressions: DataFrame
    events: DataFrame
    context: DataFrame
    params: dict


def prepare(frames: DataFrame, params: dict, size: int | None) -> tuple[DataFrame, DataFrame]:
    """Segments (with run number) and linked runs."""
    segments = seq.stage(sg.add_runs(sg.build_segments(frames, params, size), size), size)
    runs = seq.stage(sg.link_runs(sg.build_runs(segments, params), size), size)
    return segments, runs


def analyze(frames: DataFrame, params: dict | None = None, given: DataFrame | None = None, size: int | str | None = "measured",
            borrowed: list[dict] | None = None, progressions: list[dict] | None = None) -> Analysis:
    """Analyse every song.  ``given(song_id, key_idx)`` fixes keys; a null key_idx leaves the song estimated.

    ``size`` is the block length for long songs, None for no blocks; by default the longest song decides."""
    if size == "measured":
        size = seq.block_size(frames)
    p = params or P.with_overrides()
    entries = P.borrowed_entries() if borrowed is None else borrowed
    idioms = P.progression_entries() if progressions is None else progressions
    segments, runs = prepare(frames, p, size)
    exempt = prior = None
    if p["named_progressions"]["enabled"] and idioms:
        ev = seq.stage(idm.pattern_evidence(segments, runs, p, idioms, size), size)
        matches = seq.stage(idm.drop_overlaps(idm.match_progressions(ev, p, idioms)), size)
        exempt, prior = idm.loop_segments(matches, ev, p), idm.key_prior(matches, ev, p)
    keys = seq.stage(ky.segment_keys(segments, p, size, exempt, prior, given), size)
    keyed = seq.stage(evd.segments_with_keys(segments, keys), size)
    regions = ky.key_regions(segments, keys, size)
    context = seq.stage(evd.run_context(keyed, runs, p, entries, size), size)
    found = rules.describe(seq.stage(rules.detect(context, p, entries, regions, keys)), keyed)
    events = seq.stage(rs.number_events(rs.resolve_events(found, p, size), p, size), size)
    named = idm.describe_progressions(matches, segments, keys) if exempt is not None else None
    return Analysis(segments, runs, keys, keyed, regions, ky.global_keys(segments, keys, p), named, events, context, p)


def segment_output(a: Analysis) -> DataFrame:
    """Final segment rows: chord, key, numeral, functions, confidence flags and warnings."""
    thr = a.params["general"]["low_confidence_threshold"]
    display = th.roman_display("top.root", "top.quality", "top.bass", "key_idx")
    links = rs.segment_links(a.events, a.keyed, display)
    unknown, unsure = "top.quality = 'X'", f"top.prob < {thr}D"
    shaky = f"top.quality <> 'N' and key_prob < {thr}D"
    return seq.sql(f"""
        select k.song_id, k.seg, k.start, k.end, round(k.beats, 4) as beats, top.label as chord, top.harte as chord_harte,
               transform(k.cands, c -> struct(c.label as label, {th.rounded('c.prob')} as prob)) as candidates,
               if(top.root is null, null, coalesce(nullif(regexp_extract(top.harte, '^([A-G][#b]*)', 1), ''),
                  {th.spelled('key_idx', 'top.root')})) as root,
               {th.spelled('key_idx', 'coalesce(top.bass, top.root)')} as bass,
               {th.key_name('key_idx')} as key, {th.rounded('key_prob')} as key_prob,
               {th.roman_numeral('top.root', 'top.quality', 'key_idx')} as numeral, {display} as display,
               {th.degree('top.root', 'key_idx')} as degree,
               if(top.root is null, null, top.core_mask & ~{th.key_mask('key_idx')} = 0) as diatonic,
               {th.rounded('top.prob * key_prob')} as numeral_confidence, {th.rounded('top.prob')} as confidence,
               {unknown} or {unsure} or ({shaky}) as low_confidence,
               array_compact(array(if({unknown}, 'chord unknown / unparseable', null),
                   if(not {unknown} and {unsure}, format_string('chord confidence %.2f < {thr}', top.prob), null),
                   if({shaky}, format_string('key confidence %.2f < {thr}', key_prob), null))) as warnings,
               coalesce(l.functions, array()) as functions, coalesce(l.event_ids, array()) as event_ids, k.section, k.bar
        from {{k}} k left join {{l}} l on l.song_id = k.song_id and l.seg = k.seg""", k=a.keyed, l=links)
