"""Registered queries over the driver's tables: one per operator, each over the whole corpus."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import params as P
from cadenza import theory as th
from cadenza.operators import evidence as evd
from cadenza.operators import idioms as idm
from cadenza.operators import keys as ky
from cadenza.operators import rules
from cadenza.operators import segments as sg
from cadenza.operators import sequence as seq
from cadenza.plans import analysis as an
from cadenza.sources import events as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_MEMO: dict[tuple[str, str], "Corpus"] = {}


def m6(x: str) -> str:
    return f"cast(floor(({x}) * 1000000 + 0.5000003) as bigint)"


def e4(x: str) -> str:
    return f"cast(round(({x}) * 10000) as bigint)"


class Corpus:
    """The derived corpus with its shared tables, each staged on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.params = spark, sf_dir, P.with_overrides()
        self.entries, self.idioms = P.borrowed_entries(), P.progression_entries()
        events = src.read_events(spark, sf_dir)
        seq.deal_by_rows(spark, events.count())
        self.size = seq.block_size(events, "user_id")
        self.tables: dict[str, DataFrame] = {}
        self.events = events

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = seq.stage(make(), self.size)
        return self.tables[name]

    @property
    def view(self) -> DataFrame:
        return self.get("view", lambda: src.chord_frames(self.events, self.size))

    def frames(self, kind: str = "soft") -> DataFrame:
        return src.as_frames(self.view, kind)

    def segments(self, kind: str = "soft") -> DataFrame:
        return self.get(f"segments_{kind}", lambda: sg.add_runs(sg.build_segments(self.frames(kind), self.params, self.size), self.size))

    def runs(self, kind: str = "soft") -> DataFrame:
        return self.get(f"runs_{kind}", lambda: sg.link_runs(sg.build_runs(self.segments(kind), self.params), self.size))

    @property
    def given(self) -> DataFrame:
        return src.given_keys(self.view)

    def keys(self, kind: str = "soft") -> DataFrame:
        return self.get(f"given_keys_{kind}", lambda: ky.given_segment_keys(self.segments(kind), self.given))

    def keyed(self, kind: str = "soft") -> DataFrame:
        return self.get(f"keyed_{kind}", lambda: evd.segments_with_keys(self.segments(kind), self.keys(kind)))

    def context(self, kind: str = "soft") -> DataFrame:
        return self.get(f"context_{kind}", lambda: evd.run_context(self.keyed(kind), self.runs(kind), self.params, self.entries, self.size))

    def analysis(self, kind: str = "soft") -> an.Analysis:
        name = f"analysis_{kind}"
        if name not in self.tables:
            self.tables[name] = an.analyze(self.frames(kind), self.params, size=self.size)  # type: ignore[assignment]
        return self.tables[name]  # type: ignore[return-value]

    def given_analysis(self, kind: str = "soft") -> an.Analysis:
        name = f"given_analysis_{kind}"
        if name not in self.tables:
            self.tables[name] = an.analyze(self.frames(kind), self.params, given=self.given, size=self.size)  # type: ignore[assignment]
        return self.tables[name]  # type: ignore[return-value]


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _MEMO:
        _MEMO[key] = Corpus(spark, sf_dir)
    return _MEMO[key]


def forget() -> None:
    """Drop the shared tables, so that the next query does all its own work."""
    _MEMO.clear()


def query(name: str):
    def register(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(corpus(spark, sf_dir))
        return fn

    return register


# ---------------------------------------------------------------- frames, segments, runs

@query("w1_segments")
def _(c):
    return c.segments().selectExpr("song_id", "seg", "cast(start as int) as start", "cast(end as int) as stop", "cast(beats as int) as beats",
                                   "section", "bar", "top.harte as harte", f"{m6('top.prob')} as prob_e6")


@query("a1_segment_candidates")
def _(c):
    return sg.seg_candidates(c.segments()).selectExpr("song_id", "seg", "harte", f"{m6('prob')} as prob_e6")


@query("w2_runs")
def _(c):
    return c.runs().selectExpr("song_id", "run", "root", "cast(beats as int) as beats", "seg_first", "seg_last", "state")


@query("j3_neighbours")
def _(c):
    return c.runs().select("song_id", "run", "next_run", "prev_run")


@query("p1_clean_candidates")
def _(c):
    """First candidates of every fifth frame made unreadable, every seventh frame doubled in mass."""
    broken = c.frames().selectExpr("song_id", "frame_idx", "time", "duration", "beats", "section", "bar", "time_unit",
                                   "transform(candidates, (x, i) -> struct(if(frame_idx % 5 = 1 and i = 0, 'H??', x.label) as label, "
                                   "x.prob * if(frame_idx % 7 = 0, 2, 1) as prob)) as candidates")
    return sg.clean_frames(broken, c.params, c.size).selectExpr("song_id", "frame_idx", "posexplode(cands) as (pos, x)").selectExpr(
        "song_id", "frame_idx", "pos", "x.harte as harte", f"{m6('x.prob')} as prob_e6")


@query("p2_frame_beats")
def _(c):
    f = c.frames().selectExpr("song_id", "frame_idx", "if(frame_idx % 3 = 0, beats, null) as beats",
                              "if(frame_idx % 3 = 1, duration, duration * 0.25D) as duration", "if(frame_idx % 3 = 1, 'beat', 'second') as time_unit")
    return f.selectExpr("song_id", "frame_idx", f"{m6(sg.frame_beats(c.params))} as w_e6")


@query("p3_key_weight")
def _(c):
    return c.segments().selectExpr("song_id", "seg", f"{m6(ky.key_weight(c.params))} as w_e6")


@query("p4_likely_roots")
def _(c):
    likely = evd.class_masses(sg.seg_candidates(c.segments()), ("maj",), c.params["general"]["min_root_prob"])
    return likely.selectExpr("song_id", "seg", "root", f"{m6('prob')} as prob_e6")


@query("p5_segment_rows")
def _(c):
    return c.keyed().selectExpr("song_id", "seg", "top.harte as harte", f"{th.roman_display('top.root', 'top.quality', 'top.bass', 'key_idx')} as display",
                                f"{th.degree('top.root', 'key_idx')} as degree",
                                f"if(top.root is null, null, top.core_mask & ~{th.key_mask('key_idx')} = 0) as diatonic",
                                f"{e4(th.rounded('top.prob'))} as conf_e4", "top.prob < 0.6D as low_confidence")


@query("p7_diatonic_share")
def diatonic_share(c):
    """Per song, with its given key: merged segments and the share of beats on diatonic chords."""
    return seq.sql(f"""
        select song_id, count(*) as segments, cast(sum(beats) as int) as beats,
               {m6(f"sum(if(top.core_mask & ~{th.key_mask('key_idx')} = 0, beats, 0D)) / sum(beats)")} as share_e6
        from {{k}} where top.root is not null group by song_id""", k=c.keyed())


@query("p6_user_edits")
def _(c):
    from cadenza.sources import edits
    e = seq.sql(f"""select song_id, 1 as edit_no, cast(min(start_beat) as double) as start, cast(max(start_beat + beats) as double) as end,
                       concat({th.note_name('song_id % 12')}, ':maj') as label from {{v}} where frame_idx between 5 and 8 group by song_id""", v=c.view)
    return edits.apply_edits(c.frames(), e).selectExpr("song_id", "frame_idx", "candidates[0].label as harte")


@query("a3_soft_mass")
def _(c):
    return evd.class_masses(sg.seg_candidates(c.segments()), ("maj", "dom")).selectExpr(
        "song_id", "seg", "root", f"{m6('mass')} as mass_e6", f"{m6('share')} as cond_e6")


@query("a4_run_evidence")
def _(c):
    e = evd.root_evidence(evd.root_masses(c.keyed(), c.runs(), c.params), c.params, c.entries)
    return e.selectExpr("song_id", "run", "root", f"{m6('rp')} as rp_e6", "vv.seg as v_seg", f"{m6('vv.v')} as v_e6",
                        "ii.seg as ii_seg", f"{m6('ii.v')} as ii_e6")


@query("a2_bass_vote")
def _(c):
    f = c.frames().join(c.view.selectExpr("song_id", "frame_idx", f"{th.note_name('pmod(root1 + if(frame_idx % 4 = 0, 4, 0), 12)')} as bass_note",
                                          "1D as bass_prob"), ["song_id", "frame_idx"])
    s = sg.build_segments(f, c.params, c.size)
    return sg.bass_vote(s).join(s.select("song_id", "seg", "beats"), ["song_id", "seg"]).where("bass_pc is not null").selectExpr(
        "song_id", "seg", "bass_pc", "cast(round(share * beats * 1000) as bigint) as votes_e3")


@query("w17_marker_sections")
def _(c):
    from cadenza.operators import report
    return report.marker_sections(c.frames(), c.size).selectExpr("song_id", "sec", "label", "cast(start as int) as start", "cast(end as int) as stop")


# ---------------------------------------------------------------- rules with the given key

def _conf(df: DataFrame, *cols: str) -> DataFrame:
    return df.selectExpr("song_id", "run", *cols, f"{e4('conf')} as conf_e4")


def _target_pc(key: str = "attrs['target']") -> str:
    """Target pitch class from the numeral in the event."""
    names = {n: i for table in (th.NUMERALS_UPPER, th.NUMERALS_MINOR, th.NUMERALS_DIM) for i, n in enumerate(table)}
    return f"cast((key_idx + {th.lookup(names, key)}) % 12 as int)"


@query("r1_ii_v_i")
def _(c):
    return _conf(rules.ii_v_i(c.context(), c.params), "segs[0] as s1", "segs[1] as s2", "segs[2] as s3", f"{_target_pc()} as target")


@query("r2_ii_v_unresolved")
def _(c):
    done = rules.ii_v_i(c.context(), c.params)
    return _conf(rules.ii_v(c.context(), done, c.params), "segs[0] as s1", "segs[1] as s2", f"{_target_pc()} as target", "attrs['resolution'] as status")


@query("r3_secondary_dominant")
def _(c):
    return _conf(rules.secondary_dominant(c.context(), c.params), "segs[0] as s1", f"{_target_pc()} as target", "attrs['resolution'] as status")


@query("r4_leading_tone")
def _(c):
    return _conf(rules.leading_tone(c.context(), c.params), "segs[0] as s1", f"{_target_pc()} as target")


@query("r5_tritone_substitution")
def _(c):
    return _conf(rules.tritone_sub(c.context(), c.params), "segs[0] as s1", f"{_target_pc()} as target", "attrs['preceded_by_ii'] = 'true' as by_ii")


@query("r6_borrowed_chords")
def _(c):
    return _conf(rules.borrowed(c.context(), c.params, c.entries), "attrs['entry'] as entry", "segs[0] as s1")


@query("r7_aeolian_cadence")
def _(c):
    return _conf(rules.aeolian_cadence(c.context(), c.params), "segs[0] as s1", "segs[1] as s2", "segs[2] as s3")


@query("r8_deceptive_cadence")
def _(c):
    return _conf(rules.deceptive_cadence(c.context(), c.params), "attrs['target'] as name", "segs[0] as s1", "segs[1] as s2")


# ---------------------------------------------------------------- keys (estimated, no named-progression prior)

def _emission(c: Corpus) -> DataFrame:
    return c.get("emission", lambda: ky.emissions(c.segments(), c.params, c.size))


def _path(c: Corpus) -> DataFrame:
    return c.get("path", lambda: ky.decode_keys(_emission(c), c.params, c.size))


def _path_keys(c: Corpus) -> DataFrame:
    """The decoded path as segment keys, before short regions are merged."""
    return _path(c).selectExpr("song_id", "seg", "path_idx as key_idx", "post[path_idx] as key_prob", "post", "false as given")


@query("f16_chord_key_fit")
def _(c):
    pairs = sg.seg_candidates(c.segments()).where("root is not null").select("root", "quality").distinct()
    fit = th.fit_table(c.spark, c.params["key"]["seventh_off_scale_penalty"])
    return seq.sql("""select /*+ broadcast(f) */ k as key_idx, p.root, p.quality, cast(round(ln(x) * 10) as int) as fit_e1
                      from {p} p join {f} f on f.root = p.root and f.quality = p.quality lateral view posexplode(f.key_like) as k, x""", p=pairs, f=fit)


@query("a5_key_emissions")
def _(c):
    return _emission(c).selectExpr("song_id", "seg", "posexplode(emission) as (key_idx, e)").selectExpr("song_id", "seg", "key_idx", f"{m6('e')} as e_e6")


@query("w6_key_path")
def _(c):
    return _path(c).select("song_id", "seg", "path_idx")


@query("w7_key_posteriors")
def _(c):
    return _path(c).selectExpr("song_id", "seg", "posexplode(post) as (key_idx, p)").selectExpr(
        "song_id", "seg", "key_idx", f"{e4(th.rounded('p'))} as p_e4")


@query("a6_global_key")
def _(c):
    return ky.global_keys(c.segments(), _path_keys(c), c.params).where("rank < 1").selectExpr("song_id", "rank", "key_idx", f"{e4(th.rounded('prob'))} as p_e4")


@query("t4_alternative_keys")
def _(c):
    return ky.global_keys(c.segments(), _path_keys(c), c.params).where("rank between 1 and 3").selectExpr("song_id", "rank", "key_idx", f"{e4(th.rounded('prob'))} as p_e4")


@query("a7_ambiguity")
def _(c):
    return ky.global_keys(c.segments(), _path_keys(c), c.params, 1).select("song_id", "ambiguous")


@query("a8_path_regions")
def _(c):
    return ky.key_regions(c.segments(), _path_keys(c), c.size).selectExpr(
        "song_id", "region", "key_idx", "seg_first", "seg_until", "cast(start as int) as start", "cast(end as int) as stop", f"{e4(th.rounded('prob'))} as p_e4")


@query("w4_cadence_bonus")
def _(c):
    n = ky.before_cadence(ky.emission_parts(c.segments(), c.params), c.params, c.size)
    return n.selectExpr("song_id", "seg", "posexplode(concat(maj, min)) as (key_idx, ton)", "prev_v").selectExpr(
        "song_id", "seg", "key_idx", "prev_v[(key_idx + 7) % 12] * ton as b").where("b > 0").selectExpr("song_id", "seg", "key_idx", f"{m6('b')} as bonus_e6")


@query("w5_boundary_segments")
def _(c):
    return ky.boundary_segments(c.segments().selectExpr("song_id", "seg", "if(top.root is null, 0, 1) as rooted")).where("first_seg is not null")


@query("r9_modulations")
def _(c):
    regions = seq.stage(ky.key_regions(c.segments(), _path_keys(c), c.size))
    m = rules.modulation(regions, _path_keys(c), c.params)
    old = th.lookup({k: i for i, k in enumerate(th.KEY_LABELS)}, "attrs['from']")
    return m.selectExpr("song_id", "run", f"{old} as old_idx", "key_idx as new_idx", "segs[1] as cut", f"{e4('conf')} as conf_e4")


@query("w8_merged_keys")
def _(c):
    return ky.segment_keys(c.segments(), c.params, c.size).selectExpr("song_id", "seg", "key_idx", f"{e4(th.rounded('key_prob'))} as p_e4")


# ---------------------------------------------------------------- named progressions

def _pattern_evidence(c: Corpus) -> DataFrame:
    return c.get("pattern", lambda: idm.pattern_evidence(c.segments(), c.runs(), c.params, c.idioms, c.size))


def _matches(c: Corpus) -> DataFrame:
    return c.get("matches", lambda: idm.match_progressions(_pattern_evidence(c), c.params, c.idioms))


def _kept(c: Corpus) -> DataFrame:
    return c.get("kept", lambda: idm.drop_overlaps(_matches(c)))


@query("r10_progression_matches")
def _(c):
    return _matches(c).selectExpr("song_id", "name", "idiom", "tonic", "run", "array_join(segs, '-') as segs", f"{e4('conf')} as conf_e4")


@query("r11_kept_progressions")
def _(c):
    return _kept(c).selectExpr("song_id", "name", "tonic", "array_join(segs, '-') as segs", f"{e4('conf')} as conf_e4")


@query("r12_loop_segments")
def _(c):
    return idm.loop_segments(_kept(c), _pattern_evidence(c), c.params).distinct()


@query("r13_key_prior")
def _(c):
    return idm.key_prior(_kept(c), _pattern_evidence(c), c.params).selectExpr("song_id", "seg", "key_idx", "cast(round(bonus * 100000) as bigint) as bonus_e5")


@query("r16_progression_rows")
def _(c):
    keys = c.keys()
    return idm.describe_progressions(_kept(c), c.segments(), keys)


# ---------------------------------------------------------------- resolved events and outputs

@query("r15_resolved_events")
def _(c):
    return c.given_analysis().events.selectExpr("song_id", "event_no", "type", "label", "array_join(segs, '-') as segs", f"{e4('conf')} as conf_e4",
                                                "size(alternatives) as rivals", "part_of", "low_confidence")


@query("u1_rule_union")
def _(c):
    return rules.detect(c.context(), c.params, c.entries).groupBy("type").count()


@query("p5_full_segment_rows")
def _(c):
    return an.segment_output(c.given_analysis())


@query("k2_corpus_summary")
def _(c):
    from cadenza.operators import report
    a = c.analysis()
    from cadenza.operators import meter
    meters = _tempo(c).select("song_id", "bpm", "time_signature").join(meter.tempo_stats(_bar_lines(c)), "song_id")
    return report.corpus_summary(an.segment_output(a), a.global_keys, a.regions, a.events, a.progressions, c.view.select("song_id").distinct(), meters)


@query("k1_analysis_documents")
def _(c):
    from cadenza.operators import report
    a = c.analysis()
    return report.analysis_documents(an.segment_output(a), a.events, a.regions, a.global_keys, a.progressions)


@query("k5_section_report")
def _(c):
    from cadenza.operators import report
    a = c.given_analysis()
    return report.section_report(c.frames(), an.segment_output(a), a.events, a.progressions, a.params, size=c.size)


# ---------------------------------------------------------------- functions over the corpus's own labels and ids

@query("f1_label_dimension")
def _(c):
    from cadenza.functions import labels as lb
    return lb.chord_dim(c.frames().selectExpr("explode(candidates.label) as label")).selectExpr(
        "label", "harte", "root", "quality", "qclass", "has_seventh", "bit_count(core_mask) as tones")


@query("f14_song_split")
def _(c):
    from cadenza.functions import labels as lb
    return c.view.select("song_id").distinct().selectExpr("song_id", f"{lb.split_of('song_id')} as split", f"{lb.stable_hash('song_id')} as hash")


@query("f15_key_changes")
def _(c):
    t = c.view.selectExpr("song_id", "frame_idx", "tonic")
    n = seq.neighbour(t, "frame_idx", "tonic", "before", c.size).where("before <> tonic")
    return n.selectExpr("song_id", "frame_idx", f"{th.modulation_name('before', 'tonic')} as change", f"{th.key_name('tonic')} as new_key")


# ---------------------------------------------------------------- evaluation: reference = clean chords, estimate = corrupted ones

def _spans(c: Corpus, kind: str, id_name: str) -> DataFrame:
    """Chord segments as labelled events: type = chord class, confidence from the first frame."""
    s = c.segments(kind).where("top.root is not null")
    return s.selectExpr("song_id", f"seg as {id_name}", f"{th.qclass('top.quality')} as type", "start", "end", "top.harte as label",
                        "(first_frame * 37 % 100) / 100.0D as confidence")


def _pairs(c: Corpus, kind: str = "estimate") -> DataFrame:
    from cadenza.operators import evaluate as ev
    return c.get(f"pairs_{kind}", lambda: ev.match_events(_spans(c, "reference", "gold_id"), _spans(c, kind, "pred_id"), c.params))


@query("j4_overlaps")
def _(c):
    from cadenza.operators import evaluate as ev
    j = ev.overlap_join(c.segments("reference").select("song_id", "seg", "start", "end"), c.segments("estimate").select("song_id", "seg", "start", "end"))
    return j.selectExpr("song_id", "a.seg as ref_seg", "b.seg as est_seg", "cast(w as int) as w")


@query("j5_point_lookup")
def _(c):
    from cadenza.operators import evaluate as ev
    p = c.segments("estimate").selectExpr("song_id", "seg", "(start + end) / 2 as at")
    return ev.point_lookup(p, c.segments("reference").select("song_id", "start", "end", "seg")).selectExpr("song_id", "p.seg as est_seg", "i.seg as ref_seg")


@query("j6_nearest_start")
def _(c):
    from cadenza.operators import evaluate as ev
    p = c.segments("estimate").selectExpr("song_id", "seg", "start + 0.5D as at")
    return ev.nearest(p, c.segments("reference").selectExpr("song_id", "start as at", "seg as grid_idx")).selectExpr("song_id", "seg as est_seg", "grid_idx as ref_seg")


@query("j8_match_candidates")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.match_candidates(_spans(c, "reference", "gold_id"), _spans(c, "estimate", "pred_id"), c.params).selectExpr(
        "song_id", "gold_id", "pred_id", f"{m6('quality')} as q_e6")


@query("j9_greedy_matches")
def _(c):
    return _pairs(c).selectExpr("song_id", "cast(gold_id as int) as gold_id", "cast(pred_id as int) as pred_id")


@query("j10_missed_gold")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.missed_gold(_spans(c, "reference", "gold_id"), _pairs(c)).select("song_id", "gold_id", "type")


@query("a11_event_scores")
def _(c):
    from cadenza.operators import evaluate as ev
    s = ev.event_scores(_spans(c, "reference", "gold_id"), _spans(c, "estimate", "pred_id"), _pairs(c))
    return s.selectExpr("song_id", "coalesce(type, 'all') as type", "tp", "n_gold", "n_pred", f"{m6('f1')} as f1_e6", f"{m6('label_accuracy')} as acc_e6")


@query("a12_corpus_event_scores")
def _(c):
    from cadenza.operators import evaluate as ev
    s = ev.corpus_event_scores(ev.event_scores(_spans(c, "reference", "gold_id"), _spans(c, "estimate", "pred_id"), _pairs(c)))
    return s.selectExpr("coalesce(type, 'all') as type", "songs", "tp", "n_gold", "n_pred", f"{m6('precision')} as p_e6", f"{m6('recall')} as r_e6")


def _attribution(c: Corpus) -> DataFrame:
    from cadenza.operators import evaluate as ev
    gold, oracle, system = _spans(c, "reference", "gold_id"), _spans(c, "soft", "pred_id"), _spans(c, "estimate", "pred_id")
    om, sm = _pairs(c, "soft"), _pairs(c)
    return ev.attribute_errors(gold, om, sm, ev.false_positives(oracle, om), ev.false_positives(system, sm), c.params)


@query("a14_error_attribution")
def _(c):
    return _attribution(c).groupBy("song_id", "category").count().selectExpr("song_id", "category", "count as n")


@query("a15_local_key_scores")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.local_key_scores(c.keyed(), _tonic_spans(c)).selectExpr("song_id", f"{m6('weighted')} as w_e6", f"{m6('exact')} as x_e6",
                                                                      f"{m6('tonic')} as t_e6", "cast(duration as int) as duration")


def _tonic_spans(c: Corpus) -> DataFrame:
    i = seq.islands(c.view.select("song_id", "frame_idx", "tonic", "start_beat", "beats"), "frame_idx", "p.tonic = tonic", "struct(tonic)", "n", c.size)
    return seq.sql("""select song_id, cast(min(start_beat) as double) as start, cast(max(start_beat + beats) as double) as end, first(tonic) as key_idx
                      from {i} group by song_id, n""", i=i)


@query("a16_numeral_agreement")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.numeral_agreement(c.keyed("reference"), c.keyed("estimate")).selectExpr("song_id", f"{m6('strict')} as s_e6", f"{m6('degree')} as d_e6")


def _chord_scores(c: Corpus) -> DataFrame:
    from cadenza.operators import evaluate as ev
    return c.get("chord_scores", lambda: ev.chord_scores(ev.top_intervals(c.frames("reference"), c.size), ev.top_intervals(c.frames("estimate"), c.size)))


@query("a17_chord_scores")
def _(c):
    return _chord_scores(c).selectExpr("song_id", "cast(duration as int) as duration", *[f"{m6(n)} as {n}_e6" for n in ("root", "triads", "tetrads", "majmin", "sevenths", "mirex", "seg")])


@query("a13_corpus_chord_scores")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.corpus_chord_scores(_chord_scores(c)).selectExpr("songs", *[f"{m6(n)} as {n}_e6" for n in ("root", "majmin", "sevenths", "seg")])


@query("k3_evaluation_report")
def _(c):
    from cadenza.operators import evaluate as ev
    side = ["song_id", "seg as idx", "top.harte as harte", "top.root as root", "top.quality as quality"]
    errors = {level: ev.align_sequences(c.segments("reference").selectExpr(*side), c.segments("estimate").selectExpr(*side), level)
              for level in ("root", "majmin", "sevenths")}
    report = ev.evaluation_report(_chord_scores(c), errors, ev.numeral_agreement(c.keyed("reference"), c.keyed("estimate")),
                                  ev.local_key_scores(c.keyed(), _tonic_spans(c)), _attribution(c))
    return report.selectExpr("measure", f"{m6('value')} as value_e6")


@query("k7_expert_summary")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.expert_summary(_expert_scores(c))


@query("a19_home_key")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.home_key(_tonic_spans(c)).selectExpr("song_id", "key_idx", "cast(held as int) as held")


@query("w3_top_intervals")
def _(c):
    from cadenza.operators import evaluate as ev
    return ev.top_intervals(c.frames("estimate"), c.size).selectExpr("song_id", "idx", "harte", "cast(start as int) as start", "cast(end as int) as stop")


@query("w21_alignment")
def _(c):
    from cadenza.operators import evaluate as ev
    side = ["song_id", "seg as idx", "top.harte as harte", "top.root as root", "top.quality as quality"]
    return ev.align_sequences(c.segments("reference").selectExpr(*side), c.segments("estimate").selectExpr(*side)).selectExpr(
        "song_id", f"{m6('cost')} as cost_e6", "n_ref", "unmatched_ref", "array_join(ref_of_est, '-') as ref_of_est")


def _chart(c: Corpus) -> tuple[DataFrame, DataFrame]:
    from cadenza.operators import charts
    if "chart_map" not in c.tables:
        costs, mapped = charts.chart_map(c.segments("reference"), c.segments("estimate"))
        c.tables["chart_costs"], c.tables["chart_map"] = seq.stage(costs), mapped
    return c.tables["chart_costs"], c.tables["chart_map"]


@query("a17_chart_scores")
def _(c):
    from cadenza.operators import charts
    costs, mapped = _chart(c)
    return charts.aligned_scores(c.segments("reference"), c.segments("estimate"), mapped, costs).selectExpr(
        "song_id", "cast(duration as int) as duration", f"{m6('cost')} as cost_e6", "n_ref", "unmatched_ref",
        *[f"{m6(n)} as {n}_e6" for n in ("root", "triads", "tetrads", "majmin", "sevenths", "mirex")])


@query("a16_chart_numerals")
def _(c):
    from cadenza.operators import charts
    return charts.chart_numeral_agreement(c.keyed("reference"), c.keyed("estimate"), _chart(c)[1]).selectExpr(
        "song_id", f"{m6('strict')} as s_e6", f"{m6('degree')} as d_e6", "cast(duration as int) as duration")


@query("u2_chart_spans")
def _(c):
    """Every three neighbouring segments as an event, in chart time; those that end on no chord as modulations."""
    from cadenza.operators import charts
    e = c.segments("estimate")
    events = seq.sql("""select song_id, seg as event_no, if(lead(top.root, 2) over w is null, 'modulation', 'span') as type, array(seg, seg + 1, seg + 2) as segs
                        from {e} window w as (partition by song_id order by seg)""", e=e)
    return charts.chart_spans(events, _chart(c)[1], c.segments("reference")).selectExpr("song_id", "event_no", "type", "cast(start as int) as start", "cast(end as int) as stop")


def _expert_scores(c: Corpus) -> DataFrame:
    """Expert numerals derived from the true tonic; ours from the given key."""
    from cadenza.operators import evaluate as ev, resolve as rs
    a = c.given_analysis()
    links = rs.segment_links(a.events, a.keyed, th.roman_display("top.root", "top.quality", "top.bass", "key_idx")).select("song_id", "seg", "functions")
    expert = c.view.where("q1 <> 'N'").selectExpr("song_id", "cast(start_beat as double) as start", "cast(start_beat + beats as double) as end",
                                                  f"if(q1 = '7', 'V7/ii', {th.roman_numeral('root1', 'q1', 'tonic')}) as value")
    return ev.expert_scores(a.keyed, expert, links)


@query("a18_expert_scores")
def _(c):
    return _expert_scores(c)


@query("t6_parameter_sweep")
def parameter_sweep(c):
    """Estimates of several corruption strengths scored at once, parameters as one more key."""
    from cadenza.operators import evaluate as ev
    v = c.view.selectExpr("*", "explode(array(2, 3, 5, 7)) as param")
    est = v.selectExpr("song_id", "param", "cast(start_beat as double) as start", "cast(start_beat + beats as double) as end",
                       "if(event_id % param = 0 and q1 <> 'N', root2, root1) as root", "if(event_id % param = 0 and q1 <> 'N', q2, q1) as quality")
    ref = c.view.selectExpr("song_id", "cast(start_beat as double) as start", "cast(start_beat + beats as double) as end", "root1 as root", "q1 as quality")
    j = ev.overlap_join(ref, est)
    cmp_ = ev.chord_comparison("a", "b")
    return seq.sql(f"""select b.param as param_id, {m6("sum(" + cmp_['majmin'] + " * w) / sum(if(" + cmp_['majmin'] + " is null, 0D, w))")} as majmin_e6,
                       {m6("sum(" + cmp_['root'] + " * w) / sum(w)")} as root_e6 from {{j}} group by b.param""", j=j)


@query("t5_best_parameter")
def _(c):
    from cadenza.operators import evaluate as ev
    rows = parameter_sweep(c).selectExpr("param_id", "param_id = 2 as is_default", "majmin_e6 / 1e6D as objective", "root_e6 / 1e6D as local_key")
    return ev.best_parameters(rows).selectExpr("param_id", f"{m6('objective')} as objective_e6")


@query("k6_ranked_sweep")
def _(c):
    from cadenza.sources import sinks
    rows = parameter_sweep(c).selectExpr("param_id", "param_id = 2 as is_default", "majmin_e6 / 1e6D as objective", "root_e6 / 1e6D as local_key")
    return sinks.ranked_sweep(rows).selectExpr("rank", "param_id", f"{m6('objective')} as objective_e6", "eligible", "best")


# ---------------------------------------------------------------- sources and sinks over texts derived from the corpus

@query("s1_chart_frames")
def _(c):
    from cadenza.sources import text as tx
    label = f"if(q1 = 'N', 'N', concat({th.note_name('root1')}, ':', q1))"
    bars = seq.sql(f"""
        with t as (select song_id, frame_idx, section, {label} as label from {{v}}),
        b as (select song_id, cast(frame_idx div 2 as int) as b, concat(' | ', if(min(frame_idx) % 16 = 0, concat('[', min_by(section, frame_idx), '] '), ''),
                 if(min(frame_idx) % 10 = 8, '%', concat(min_by(label, frame_idx), if(count(*) > 1, if(min(frame_idx) % 6 = 2, ' .', concat(' ', max_by(label, frame_idx))), '')))) as bar
              from t group by song_id, frame_idx div 2)
        select song_id, concat('# derived chart\n', array_join(transform(sort_array(collect_list(struct(b, bar))), x -> x.bar), ''), ' |') as text, 4 as beats_per_bar
        from b group by song_id""", v=c.view)
    frames, _ = tx.parse_charts(bars)
    return frames.selectExpr("song_id", "frame_idx", "candidates[0].label as label", f"{m6('time')} as time_e6", f"{m6('duration')} as dur_e6", "bar", "section")


@query("s2_label_lines")
def _(c):
    from cadenza.sources import text as tx
    lines = c.view.selectExpr("song_id", "frame_idx as line_no", f"if(frame_idx % 9 = 4, '# note', if(frame_idx % 9 = 7, 'broken', concat(start_beat, '.0 \t', start_beat + beats, '.5 ', "
                              f"if(q1 = 'N', 'N', concat({th.note_name('root1')}, ':', q1)), ' '))) as text")
    good, bad = tx.parse_lab(lines)
    return good.selectExpr("song_id", "line_no", "cast(start * 10 as int) as start_e1", "cast(end * 10 as int) as end_e1", "label").unionByName(
        bad.selectExpr("song_id", "line_no", "-1 as start_e1", "-1 as end_e1", "text as label"))


@query("s3_recognition_documents")
def _(c):
    from cadenza.sources import documents as docs
    d = docs.recognition_documents(c.frames()).selectExpr("song_id", f"from_json(doc, '{docs.RECOGNITION.replace(chr(10), ' ')}') as d").selectExpr("song_id", "d.*")
    frames, _ = docs.recognition_frames(d)
    return frames.selectExpr("song_id", "frame_idx", "cast(time as int) as time", "section", "size(candidates) as n", "candidates[0].label as harte")


@query("s4_annotations")
def _(c):
    from cadenza.sources import documents as docs
    label = f"if(frame_idx % 11 = 3, 'bad label', if(q1 = 'N', 'N', concat({th.note_name('root1')}, ':', q1)))"
    item = "struct(cast(bar + frame_idx / 1000.0D as double) as time, cast(beats as double) as duration, {} as value)"
    d = seq.sql(f"""select song_id, array(struct('chord_harte' as namespace, transform(sort_array(collect_list(struct(frame_idx, {item.format(label)} as x))), z -> z.x) as data),
                    struct('key_mode' as namespace, array(max_by({item.format("'C:major'")}, if(frame_idx = 20, 1, 0))) as data)) as annotations from {{v}} group by song_id""", v=c.view)
    t = docs.annotation_tables(d, True)
    return t["frames"].selectExpr("song_id", "frame_idx", "cast(time as int) as time", "candidates[0].label as label").unionByName(
        t["keys"].selectExpr("song_id", "-1 as frame_idx", "cast(start as int) as time", "value as label"))


@query("s7_gold_events")
def _(c):
    from cadenza.sources import documents as docs
    d = seq.sql("""select song_id, 'chart' as kind, 4 as beats_per_bar, concat('[', array_join(transform(sort_array(collect_list(struct(frame_idx, if(frame_idx % 2 = 0,
                     concat('{{"type":"x","bars":[', bar, ',', bar + 1, ']}}'), concat('{{"type":"y","start":', start_beat, ',"end":', start_beat + beats, '}}')) as j))), z -> z.j), ','), ']') as doc
                   from {v} group by song_id""", v=c.view)
    good, _ = docs.gold_events(d)
    return good.selectExpr("song_id", "gold_id", "type", "cast(start as int) as start", "cast(end as int) as stop")


@query("s8_pick_estimates")
def _(c):
    from cadenza.sources import documents as docs
    refs = c.view.select("song_id").distinct()
    cand = c.view.where("event_id % 2 = 0").selectExpr("song_id", "get(array('.lab', '.json', '.recognition.json'), frame_idx % 3) as extension").where("song_id % 5 <> 3")
    picked, skipped = docs.pick_estimates(refs, cand)
    return picked.select("song_id", "extension").unionByName(skipped.selectExpr("song_id", "reason as extension"))


@query("s9_paired_annotations")
def _(c):
    from cadenza.sources import documents as docs
    songs = c.view.groupBy("song_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("q1"))).alias("text"), F.sum("event_id").alias("ids"))
    both, missing = docs.pair_annotations(songs.where("ids % 4 > 0").select("song_id", "text"), songs.where("ids % 3 > 0").select("song_id", "text"))
    return both.select("song_id", "split").unionByName(missing.selectExpr("song_id", "problem as split"))


@query("s9_written_corpus")
def _(c):
    """The paired corpus written by split, first a part of it, then all, then all again: what each run wrote and what is there."""
    import uuid
    from cadenza.sources import documents as docs, sinks
    songs = c.view.groupBy("song_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("q1"))).alias("text"), F.sum("event_id").alias("ids"))
    both = seq.stage(docs.pair_annotations(songs.select("song_id", "text"), songs.select("song_id", "text"))[0])
    folder = f"{seq.staging_dir(c.spark)}/corpus-{uuid.uuid4().hex}"
    runs = [sinks.write_by_split(x, folder).selectExpr(f"{k} as run", "song_id", "split") for k, x in enumerate([both.where("song_id % 3 = 0"), both, both])]
    there = c.spark.read.parquet(folder).selectExpr("9 as run", "song_id", "split")
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(there)


@query("s10_section_files")
def _(c):
    from cadenza.sources import documents as docs
    files = c.view.groupBy(F.col("song_id").alias("stem"), F.expr("concat('d', event_id % 4)").alias("directory")).agg(F.max("event_id").alias("sections"))
    pri = files.select("directory").distinct().selectExpr("directory", "-cast(substring(directory, 2) as int) as priority")
    return docs.section_files(files, pri).selectExpr("stem", "directory", "sections")


@query("s11_newest_recognition")
def _(c):
    from cadenza.sources import documents as docs
    return docs.newest_per_source(c.events.selectExpr("user_id as source_path", "unix_micros(cast(ts as timestamp)) as modified", "event_id as doc_id")).selectExpr(
        "source_path", "doc_id")


@query("k4_label_export")
def _(c):
    from cadenza.operators import report
    return report.label_lines(c.segments().selectExpr("song_id", "seg", "start / 2 as start", "end / 2 as end", "top.harte as chord_harte"))


# ---------------------------------------------------------------- meter: beat = half a second

def _beat_times(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    beats = c.view.selectExpr("song_id", "start_beat * 0.5D as at")
    downs = c.view.where("start_beat % 4 = 0").selectExpr("song_id", "start_beat * 0.5D as at")
    ends = seq.sql("select song_id, max(start_beat + beats) * 0.5D as duration from {v} group by song_id", v=c.view)
    return beats, downs, ends


def _tempo(c: Corpus) -> DataFrame:
    from cadenza.operators import meter
    beats, downs, _ = _beat_times(c)
    return c.get("tempo", lambda: meter.tempo(beats, downs))


def _bar_lines(c: Corpus) -> DataFrame:
    from cadenza.operators import meter
    return c.get("bar_lines", lambda: meter.repair_bars(_tempo(c), *_beat_times(c)))


@query("a21_tempo")
def _(c):
    return _tempo(c).selectExpr("song_id", f"{m6('beat_period')} as beat_e6", f"{m6('bar_period')} as bar_e6", "beats_per_bar", "time_signature")


@query("w11_bar_lines")
def _(c):
    return _bar_lines(c).selectExpr("song_id", "posexplode(bars) as (bar, at)").selectExpr("song_id", "bar", f"{m6('at')} as at_e6")


@query("w12_beat_grid")
def _(c):
    from cadenza.operators import meter
    return meter.beat_grid(_bar_lines(c), _tempo(c), _beat_times(c)[0]).selectExpr("song_id", "bar", "beat_in_bar", f"{m6('at')} as at_e6")


@query("a23_tempo_stats")
def _(c):
    from cadenza.operators import meter
    return meter.tempo_stats(_bar_lines(c)).selectExpr("song_id", "n_bars", f"{m6('tempo_cv')} as cv_e6", "size(irregular) as n_irregular")


@query("w10_beat_numbering")
def _(c):
    from cadenza.operators import meter
    return meter.number_beats(*_beat_times(c)).selectExpr("song_id", "cast(start * 2 as int) as start_e2", "cast(end * 2 as int) as end_e2", "bar", "beat_in_bar")


# ---------------------------------------------------------------- decoding: vocabulary of the corpus's chords and no-chord

PAIRS = {"dom>maj": 0.25, "dom>min": 0.1, "min>dom": 0.2, "hdim>dom": 0.3}  # prior of quality changes


def _vocab(c: Corpus) -> DataFrame:
    """The distinct chords of both candidates, sevenths included, numbered, with no-chord first."""
    from cadenza.operators import decode
    return c.get("vocab", lambda: decode.vocabulary(seq.sql(f"""
        select cast(row_number() over (order by q, root) as int) as chord_idx, concat({th.note_name('root')}, ':', q) as label
        from (select distinct root1 as root, q1 as q from {{v}} where root1 is not null union select distinct root2, q2 from {{v}} where root2 is not null)
        union all select 0, 'N'""", v=c.view)))


def _places(c: Corpus) -> DataFrame:
    """The view with the numbers of its two chords in the vocabulary: i1, i2 (no-chord is 0) and the vocabulary's size."""
    v = _vocab(c).select("chord_idx", "label")
    label = lambda k: f"coalesce(concat({th.note_name(f'root{k}')}, ':', q{k}), 'N')"
    return c.get("places", lambda: seq.sql(f"""
        select /*+ broadcast(a), broadcast(b) */ f.*, a.chord_idx as i1, b.chord_idx as i2, {v.count()} as chords
        from {{f}} f join {{v}} a on a.label = {label(1)} join {{v}} b on b.label = {label(2)}""", f=c.view, v=v))


def _mass(c: Corpus) -> DataFrame:
    """Per bar: chord masses of the frames that start in it."""
    return _places(c).selectExpr("song_id", "bar", "cast(start_beat as double) as time", "i1", "i2", "chords", "p1_permille / 1000.0D as p1", "p2_permille / 1000.0D as p2")


def _bar_beats(c: Corpus) -> DataFrame:
    return seq.sql("""select song_id, cast(row_number() over (partition by song_id order by bar) - 1 as int) as beat, bar, (bar - 1) * 4D as start, bar * 4D as end,
                      cast(1 + (bar - 1) % 4 as int) as beat_in_bar, 4 as beats_per_bar from (select distinct song_id, bar from {v})""", v=c.view)


def _observations(c: Corpus) -> DataFrame:
    from cadenza.operators import decode
    f = _mass(c).selectExpr("song_id", "time", "transform(sequence(0, chords - 1), i -> ln(0.01D + if(i = i1, p1, 0D) + if(i = i2, p2, 0D))) as loglik")
    return c.get("observations", lambda: decode.beat_arrays(f, _bar_beats(c), _vocab(c), c.params))


def _posteriors(c: Corpus) -> DataFrame:
    from cadenza.operators import decode
    return c.get("posteriors", lambda: decode.decode_beats(_observations(c), _bar_beats(c), decode.transition_table(_vocab(c), c.params, PAIRS), c.params))


@query("a24_beat_observations")
def _(c):
    return _observations(c).selectExpr("song_id", "beat", "posexplode(obs) as (chord_idx, o)").selectExpr("song_id", "beat", "chord_idx", f"{m6('o')} as obs_e6")


@query("w18_metrical_cost")
def _(c):
    from cadenza.operators import decode
    return _bar_beats(c).selectExpr("song_id", "beat", f"{m6(decode.metrical_cost('beat_in_bar', 'beats_per_bar', c.params))} as cost_e6")


@query("w20_transitions")
def _(c):
    from cadenza.operators import decode
    t = decode.transition_table(_vocab(c), c.params, PAIRS)
    v = _vocab(c).select("chord_idx", "label")
    return seq.sql(f"""select a.label as src, b.label as dst, {m6('t.score')} as score_e6 from {{t}} t join {{v}} a on a.chord_idx = t.src
                       join {{v}} b on b.chord_idx = t.dst""", t=t, v=v)


@query("w19_chord_decoding")
def _(c):
    return _posteriors(c).selectExpr("song_id", "beat", "path_idx", f"{m6('array_max(post)')} as top_e6")


@query("t1_top_candidates")
def _(c):
    from cadenza.operators import decode
    post = _places(c).selectExpr("song_id", "frame_idx as beat", "transform(sequence(0, chords - 1), i -> if(i = i1, p1_permille / 1000.0D, 0D) "
                                 "+ if(i = i2 and q2 is not null, p2_permille / 10000.0D, 0D)) as post")
    return decode.top_candidates(post, _vocab(c), c.params).selectExpr("song_id", "beat", "rank", "label", f"{m6('prob')} as prob_e6")


def _bass(c: Corpus) -> DataFrame:
    return c.view.selectExpr("song_id", "frame_idx", "cast(start_beat as double) as time", "transform(sequence(0, 12), i -> if(i = coalesce(root1 + 1, 0), p1_permille / 1000.0D, 0.01D)) as bass")


@query("a24_beat_bass")
def _(c):
    """Mean bass probabilities per bar and the note they name."""
    from cadenza.operators import decode
    probs = decode.bass_observations(_bass(c), _bar_beats(c))
    named = decode.bass_notes(probs)
    return seq.sql(f"select n.song_id, n.beat, n.bass_note, {m6('n.bass_prob')} as prob_e6, {m6('aggregate(p.probs, 0D, (a, x) -> a + x)')} as sum_e6 from {{n}} n join {{p}} p on p.song_id = n.song_id and p.beat = n.beat", n=named, p=probs)


@query("t2_bass_notes")
def _(c):
    from cadenza.operators import decode
    b = _bass(c).selectExpr("song_id", "frame_idx as beat", "bass as probs")
    return decode.bass_notes(b).selectExpr("song_id", "beat", "bass_note", f"{m6('bass_prob')} as prob_e6")


@query("b9_assembled_frames")
def _(c):
    from cadenza.operators import decode, report
    top = decode.top_candidates(_posteriors(c), _vocab(c), c.params)
    tempo = c.view.select("song_id").distinct().selectExpr("song_id", "1.0D as beat_period")
    bass = decode.bass_notes(decode.bass_observations(_bass(c), _bar_beats(c)))
    return decode.assemble_frames(_bar_beats(c), top, tempo, report.marker_sections(c.frames(), c.size), bass).selectExpr(
        "song_id", "frame_idx", "cast(time as int) as time", "cast(beats as int) as beats", "section", "size(candidates) as n", "candidates[0].label as label",
        "bass.note as bass", "cast(round(bass.prob * 10000) as int) as bass_e4")


# ---------------------------------------------------------------- structure

_MASK = f"({th.lookup({q: th.mask(r['semis']) for q, r in th.QUALITIES.items()}, 'q1')})"


def _beat_features(c: Corpus) -> DataFrame:
    minor = "if({} in ('min', 'min7', 'dim', 'hdim7'), 12, 0)"
    b = c.view.selectExpr("song_id", "bar", "start_beat as beat", "start_beat * 0.5D as at",
                          f"transform(sequence(0, 23), i -> if(i = root1 + {minor.format('q1')}, p1_permille / 1000.0D, 0D)) as identity0", "section", "p1_permille", "beats",
                          f"if(root1 is null, 0, {th.rotl12(_MASK, 'root1')}) as pitches")
    b = b.selectExpr("song_id", "bar", "beat", "at", "transform(identity0, x -> coalesce(x, 0D)) as identity", "transform(sequence(0, 11), i -> cast(shiftright(pitches, i) & 1 as double) * p1_permille / 1000.0D) as chroma",
                     "array(p1_permille / 100.0D, cast(beats as double)) as timbre", "if(section = 'Chorus', -10D, -18D) as loud")
    return b


def _bars(c: Corpus) -> DataFrame:
    from cadenza.operators import structure as st
    return c.get("bars", lambda: st.bar_features(_beat_features(c), 4, c.params))


def _windows(c: Corpus) -> DataFrame:
    from cadenza.operators import structure as st
    return c.get("windows", lambda: st.windows(_bars(c), c.params))


def _structure(c: Corpus) -> DataFrame:
    from cadenza.operators import structure as st
    return c.get("structure", lambda: st.analyse_structure(_bars(c), _beat_times(c)[2].withColumnRenamed("duration", "end_time"), c.params))


@query("b1_chord_templates")
def _(c):
    from cadenza.functions import labels as lb
    from cadenza.operators import structure as st
    dim = lb.chord_dim(c.frames().selectExpr("explode(candidates.label) as label"))
    return st.chord_templates(dim).selectExpr("label", "cast(aggregate(chroma, 0D, (a, x) -> a * 2 + x) as int) as chroma_bits",
                                              "coalesce(cast(array_position(identity, 1D) - 1 as int), -1) as identity_idx")


@query("a22_bar_features")
def _(c):
    return _bars(c).selectExpr("song_id", "bar_no", "bar", f"{m6('aggregate(harm, 0D, (a, x) -> a + x)')} as harm_e6", f"{m6('timbre[2]')} as loud_e6",
                               f"{m6('timbre[0]')} as timbre_e6")


@query("b2_repetition_band")
def _(c):
    from cadenza.operators import structure as st
    r = st.repetition(_windows(c), range(1, 3), range(12))
    return r.selectExpr("song_id", "shift", "i", "j", f"{m6('sim')} as sim_e6")


@query("b3_timbre_scale")
def _(c):
    from cadenza.operators import structure as st
    return st.timbre_scale(_bars(c)).selectExpr("song_id", f"{m6('sigma')} as sigma_e6")


def _novelty(c: Corpus) -> DataFrame:
    from cadenza.operators import structure as st
    return c.get("novelty", lambda: st.novelty(_windows(c), c.params))


@query("w13_novelty")
def _(c):
    return _novelty(c).selectExpr("song_id", "bar_no", f"{m6('novelty')} as novelty_e6")


@query("w14_section_cuts")
def _(c):
    from cadenza.operators import structure as st
    return st.segment_bars(_novelty(c), c.params).select("song_id", "sec", "start_bar", "end_bar")


@query("b7_sections")
def _(c):
    return _structure(c).selectExpr("song_id", "sec", "start_bar", "end_bar", "cluster", "shift", "off", "label", f"{m6('similarity')} as sim_e6")


@query("j7_snapped_sections")
def _(c):
    from cadenza.operators import report, structure as st
    ext = report.marker_sections(c.frames(), c.size).selectExpr("song_id", "start * 0.5D + 0.3D as start", "end * 0.5D as end", "lower(label) as label")
    return st.snap_sections(ext, _bars(c)).select("song_id", "sec", "start_bar", "end_bar", "label")


@query("j17_aligned_repeats")
def _(c):
    from cadenza.operators import structure as st
    return st.aligned_repeats(_structure(c), _windows(c), c.params)


@query("b8_pooled_posteriors")
def _(c):
    from cadenza import params as P
    from cadenza.operators import structure as st
    p = P.with_overrides({"structure": {"pool_weight": 0.5}})
    post = _posteriors(c).select("song_id", "beat", "post")
    beat_bars = _bar_beats(c).join(_bars(c).select("song_id", "bar", "bar_no"), ["song_id", "bar"]).selectExpr("song_id", "beat", "bar_no", "0 as k")
    return st.pool_posteriors(post, beat_bars, st.aligned_repeats(_structure(c), _windows(c), p), p).selectExpr("song_id", "beat", f"{m6('array_max(post)')} as top_e6")


def _segmentations(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Marked sections and stretches of one tonic with chords of one corruption, both in half seconds a beat."""
    from cadenza.operators import report
    marks = report.marker_sections(c.frames(), c.size).selectExpr("song_id", "start * 0.5D as start", "end * 0.5D as end", "lower(label) as label")
    i = seq.islands(c.view.selectExpr("song_id", "frame_idx", "start_beat", "beats", "corrupt or event_id % 7 < 4 as odd"), "frame_idx", "p.odd = odd", "struct(odd)", "n", c.size)
    ours = seq.sql("""select song_id, min(start_beat) * 0.5D + 0.25D as start, max(start_beat + beats) * 0.5D + 0.25D as end, if(first(odd), 'verse', 'chorus') as label
                      from {i} group by song_id, n""", i=i)
    return marks, ours


@query("a25_boundary_scores")
def _(c):
    from cadenza.operators import segmentation as sgm
    out = [sgm.boundary_scores(*_segmentations(c), window).selectExpr("song_id", f"{int(window * 10)} as window_e1", "n_ref", "n_est", "matched", f"{m6('f')} as f_e6")
           for window in (3.0, 0.5)]
    return out[0].unionByName(out[1])


@query("a25_pairwise_scores")
def _(c):
    from cadenza.operators import segmentation as sgm
    return sgm.pairwise_scores(*_segmentations(c)).selectExpr("song_id", "frames", f"{m6('precision')} as p_e6", f"{m6('recall')} as r_e6", f"{m6('f')} as f_e6")


@query("a25_segmentation_agreement")
def _(c):
    from cadenza.operators import evaluate as ev, report
    ours = _structure(c).selectExpr("song_id", "start", "end", "label")
    marks = report.marker_sections(c.frames(), c.size).selectExpr("song_id", "start * 0.5D as start", "end * 0.5D as end", "lower(label) as label")
    return ev.segmentation_agreement(marks, ours).selectExpr("song_id", f"{m6('agreement')} as agreement_e6")
