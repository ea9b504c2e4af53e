"""Harmonic events: each rule is one projection over ``run_context`` plus a best-per-run pick.

A rule scores hypotheses as a product of named factors in [0, 1], keeps those above the minimum
confidence and reports the best one per run (first hypothesis wins ties).  All rules emit the same
columns, so the result is a union of the enabled ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from cadenza import theory as th
from cadenza.operators import sequence as seq
from cadenza.operators.evidence import borrowed_features

EVENT_TYPES = ["ii_V_I", "ii_V", "secondary_dominant", "secondary_leading_tone", "tritone_sub", "borrowed_chord",
               "aeolian_cadence", "deceptive_cadence", "modulation"]
RULE_ORDER = ["ii_V_I", "secondary_dominant", "secondary_leading_tone", "tritone_sub", "borrowed", "aeolian_cadence",
              "deceptive_cadence", "modulation"]


def unit(x: str) -> str:
    return f"least(greatest({x}, 0D), 1D)"


def quality_factor(params: dict, match: str, contra: str) -> str:
    q = params["quality"]
    return unit(f"{q['base']}D + (1D - {q['base']}D) * {match} - {q['contradict_penalty']}D * {contra}")


def at(map_col: str, pc: str) -> str:
    return f"try_element_at({map_col}, {th.pmod12(pc)})"


def prob(map_col: str, pc: str) -> str:
    return f"coalesce({at(map_col, pc)}.rp, 0D)"


def _finish(text: str, params: dict, type_: str, **tables: DataFrame) -> DataFrame:
    """Best hypothesis per run.  ``text`` yields song_id, run, ord, segs, label, key_idx, functions,
    explains, attrs, ``value`` and ``factors ARRAY<STRUCT<kind, detail, factor>>``."""
    least = params["general"]["min_event_confidence"]
    return seq.sql(f"""
        with h as ({text}),
             b as (select song_id, run, max(struct({th.rounded(unit('value'))} as conf, -ord.o1 as o1, -ord.o2 as o2,
                                                   -ord.o3 as o3, segs, label, key_idx, functions, explains,
                                                   to_json(attrs) as attrs, factors)) as e
                   from h where value >= {least}D group by song_id, run)
        select song_id, run, '{type_}' as type, e.label, e.segs, e.conf, e.key_idx, e.functions, e.explains,
               from_json(e.attrs, 'map<string,string>') as attrs,
               transform(e.factors, x -> struct(x.kind, x.detail, {th.rounded(unit('x.factor'))} as factor)) as evidence
        from b""", **tables)


def _ord(o: str) -> str:
    return f"struct({o}.seg as o1, {o}.nrp as o2, {o}.np as o3)"


def _no_ord(n: str = "0") -> str:
    return f"struct({n} as o1, 0D as o2, 0D as o3)"


def ev(kind: str, detail: str, factor: str) -> tuple[str, str, str]:
    return kind, detail, factor


def scored(factors: list[tuple[str, str, str]]) -> str:
    """Confidence as a plain product (cheap to filter on) and the ledger of its factors."""
    value = " * ".join(unit(f) for _, _, f in factors)
    ledger = ", ".join(f"struct('{k}' as kind, {d} as detail, {f} as factor)" for k, d, f in factors)
    return f"{value} as value, array({ledger}) as factors"


def _ii_v_factors(p: dict) -> list[tuple[str, str, str]]:
    c = p["ii_V_I"]
    v_match = f"(v.vv.v / v.vv.rp + {c['sus_v_match']}D * v.vv.s)"
    return [ev("root_motion", "'root rises a 4th'", "i.rp * v.rp"),
            ev("quality_ii", "'ii is minor or half-diminished'", quality_factor(p, "(i.ii.v / i.ii.rp)", "i.ii.c")),
            ev("quality_V", "'V has a major third'", quality_factor(p, v_match, "v.vv.c"))]


def _target(p: dict, t: str, key: str) -> tuple[str, str]:
    c = p["ii_V_I"]
    tonic = f"({t} = {key} % 12)"
    return tonic, (f"case when {tonic} then {c['target_tonic']}D when {th.in_key(t, key)} then {c['target_diatonic']}D "
                   f"else {c['target_other']}D end")


def ii_v_i(ctx: DataFrame, params: dict) -> DataFrame:
    """ii-V-I into any chord: ii on the run before, V here, I on the run after."""
    p, least = params, params["general"]["min_root_prob"]
    tonic, target = _target(p, "t", "nx_kf")
    tnum = th.target_numeral("nx_kf", "t", "if(minor, 'min', 'maj')")
    factors = _ii_v_factors(p) + [
        ev("resolution", "'V resolves down a fifth'", "n.rp"),
        ev("quality_I", "'target is a stable triad'", quality_factor(p, "coalesce(n.fst.ok, 0D)", "coalesce(n.fst.bad, 0D)")),
        ev("target", f"if({tonic}, 'local tonic', 'tonicised chord')", target)]
    return _finish(f"""
        select song_id, run, {_ord('n.ord')} as ord, array(i.ii.seg, v.vv.seg, nx_seg) as segs, nx_kf as key_idx,
               concat(if(minor, 'ii–V–i', 'ii–V–I'), if({tonic}, '', concat(' → ', tnum))) as label,
               if({tonic}, cast(null as array<string>), array({th.applied_label('i.ii.tr', 'i.ii.tq', 't', 'tnum')},
                  {th.applied_label('v.vv.tr', 'v.vv.tq', 't', 'tnum')}, cast(null as string))) as functions,
               if({tonic}, cast(array() as array<int>), array(i.ii.seg, v.vv.seg)) as explains,
               map('mode', if(minor, 'minor', 'major'), 'target', tnum, 'tonicization', cast(not {tonic} as string)) as attrs,
               {scored(factors)}
        from (select *, {tnum} as tnum from (
              select *, {at('pv', 't + 2')} as i, {at('own', 't + 7')} as v,
                     coalesce(n.fst.min > n.fst.md, false) as minor
              from (select *, explode(nx) as (t, n) from {{ctx}} where has_prev and has_next) where n.ord is not null)
              where i.rp >= {least}D and v.rp >= {least}D)""", p, "ii_V_I", ctx=ctx)


def ii_v(ctx: DataFrame, resolved: DataFrame, params: dict) -> DataFrame:
    """ii-V that does not resolve (deceptive, unresolved or at the end); runs with a ii-V-I are left out."""
    p, c, least = params, params["ii_V_I"], params["general"]["min_root_prob"]
    tonic, target = _target(p, "t", "k")
    tnum = th.target_numeral("k", "t", "if(minor, 'min', 'maj')")
    factors = _ii_v_factors(p) + [
        ev("chromatic_V", "'V has a tone outside the key'", f"if({tonic}, 1D, v.vv.x)"),
        ev("resolution", "status", f"case status when 'deceptive' then {c['unresolved_deceptive']}D * p_dec "
                                   f"else {c['unresolved_other']}D end"),
        ev("target", f"if({tonic}, 'local tonic', 'tonicised chord')", target)]
    base = "array(i.ii.seg, v.vv.seg)"
    return _finish(f"""
        select song_id, run, {_ord('v.ord')} as ord, if(status = 'deceptive', concat({base}, array(nx_seg)), {base}) as segs,
               k as key_idx, concat('ii–V', if({tonic}, '', concat('/', tnum)), ' (', status, ')') as label,
               if({tonic}, cast(null as array<string>), array({th.applied_label('i.ii.tr', 'i.ii.tq', 't', 'tnum')},
                  {th.applied_label('v.vv.tr', 'v.vv.tq', 't', 'tnum')}, cast(null as string))) as functions,
               if({tonic}, cast(array() as array<int>), {base}) as explains,
               map('mode', if(minor, 'minor', 'major'), 'target', tnum, 'tonicization', cast(not {tonic} as string),
                   'resolution', status) as attrs,
               {scored(factors)}
        from (select *, {tnum} as tnum from (
              select *, case when not has_next then 'end' when p_dec * {c['unresolved_deceptive']}D >= {c['unresolved_other']}D
                             then 'deceptive' else 'unresolved' end as status
              from (select *, {prob('nx', 't + if(minor, 8, 9)')} as p_dec
                    from (select *, i.ii.low > 0.5 or coalesce({th.triad_class(th.degree('t', 'k'), 'k')} = 'min', false) as minor
                          from (select *, {at('pv', 't + 2')} as i, v.vv.k as k
                                from (select *, {th.pmod12('r + 5')} as t from
                                      (select *, explode(own) as (r, v) from {{ctx}} where has_prev) where v.ord is not null))
                          where i.rp >= {least}D)))
              where not (has_next and ({prob('nx', 't')} >= 0.5 or ({prob('nx', 't + 9')} >= 0.5 and {th.pmod12('t + 9')} = k % 12)))
                and not ({tonic} and status = 'deceptive')
                and ({tonic} or (v.vv.x >= {c['unresolved_min_chromatic']}D
                                 and i.ii.v / i.ii.rp >= {c['unresolved_min_ii_quality']}D))) h
        where not exists (select 1 from {{done}} d where d.song_id = h.song_id and d.run = h.run)""",
                   p, "ii_V", ctx=ctx, done=resolved.select("song_id", "run"))


def _key_factor(p: dict) -> tuple[str, str, str]:
    return ev("key", "concat('local key ', key_label)", f"power(pl, {p['general']['key_confidence_exponent']}D)")


def secondary_dominant(ctx: DataFrame, params: dict) -> DataFrame:
    """V/x and V7/x: a dominant with a tone outside the key; resolved, deceptive or unresolved."""
    p, c = params, params["secondary_dominant"]
    factors = [ev("dominant_quality", "'has a tone outside the key'", "o.dw.v"), ev("resolution", "status", "f"), _key_factor(p)]
    tnum = th.target_numeral("kl", "t", "if(status = 'resolved', nx_cls, cast(null as string))")
    stray = "" if c["unresolved_nondiatonic"] else f"and not (status = 'unresolved' and not {th.in_key('t', 'kl')})"
    return _finish(f"""
        select song_id, run, {_ord('o.ord')} as ord,
               if(status = 'unresolved', array(o.dw.seg), array(o.dw.seg, nx_seg)) as segs, kl as key_idx,
               concat(func, if(status = 'resolved', '', concat(' (', status, ')'))) as label,
               array(func, cast(null as string)) as functions, array(o.dw.seg) as explains,
               map('target', tnum, 'target_root', {th.spelled('kl', 't')}, 'resolution', status,
                   'has_seventh', cast({th.has_seventh('o.dw.tq')} as string)) as attrs,
               {scored(factors)}
        from (select *, {th.applied_label('o.dw.tr', 'o.dw.tq', 't', 'tnum')} as func from (
              select *, {tnum} as tnum from (
              select *, case when f_res > {c['unresolved']}D and f_res >= f_dec then 'resolved'
                             when f_dec > {c['unresolved']}D then 'deceptive' else 'unresolved' end as status,
                     greatest({c['unresolved']}D, f_res, f_dec) as f
              from (select *, if(has_next, {c['resolved']}D * {prob('nx', 't')}, -1D) as f_res,
                     if(has_next, {c['deceptive']}D * {prob('nx', "r + if(tcls = 'min', 1, 2)")}, -1D) as f_dec
                    from (select *, coalesce({th.triad_class(th.degree('t', 'kl'), 'kl')}, '') as tcls, {th.key_name('kl')} as key_label
                          from (select *, {th.pmod12('r + 5')} as t from
                                (select *, explode(own) as (r, o) from {{ctx}}) where o.ord is not null and o.dw.v > 0
                                 and {th.degree('r', 'kl')} <> 7))
                    where tcls <> 'dim')) where true {stray}))""", p, "secondary_dominant", ctx=ctx)


def leading_tone(ctx: DataFrame, params: dict) -> DataFrame:
    """vii°/x: a diminished chord on a chromatic root that rises a semitone."""
    factors = [ev("diminished_quality", "'diminished on a chromatic root'", "o.lt.v"),
               ev("resolution", "'rises a semitone'", "p_t"), _key_factor(params)]
    return _finish(f"""
        select song_id, run, {_ord('o.ord')} as ord, array(o.lt.seg, nx_seg) as segs, kl as key_idx, func as label,
               array(func, cast(null as string)) as functions, array(o.lt.seg) as explains,
               map('target', tnum, 'target_root', {th.spelled('kl', 't')}) as attrs, {scored(factors)}
        from (select *, {th.applied_label('o.lt.tr', 'o.lt.tq', 't', 'tnum')} as func from (
              select *, {th.target_numeral('kl', 't', 'nx_cls')} as tnum, {prob('nx', 't')} as p_t, {th.key_name('kl')} as key_label
              from (select *, {th.pmod12('r + 1')} as t from (select *, explode(own) as (r, o) from {{ctx}} where has_next)
                    where o.ord is not null and o.lt.v > 0 and not {th.in_key('r', 'kl')})
              where coalesce({th.triad_class(th.degree('t', 'kl'), 'kl')}, '') <> 'dim') where p_t > 0)""",
                   params, "secondary_leading_tone", ctx=ctx)


def tritone_sub(ctx: DataFrame, params: dict) -> DataFrame:
    """subV7: a dominant seventh whose root falls a semitone into its target."""
    c = params["tritone_sub"]
    deg_cls = f"coalesce({th.triad_class(th.degree('t', 'nx_kf'), 'nx_kf')}, 'dim')"
    factors = [ev("dominant_quality", "'dominant seventh shares the tritone'", "o.tt.v"),
               ev("root_motion", "'root falls a semitone'", "p_t"),
               ev("target", "concat('in ', key_label)", f"case when t = nx_kf % 12 then {c['target_tonic']}D "
                  f"when {deg_cls} <> 'dim' then {c['target_diatonic']}D else {c['target_other']}D end")]
    func = "concat('subV', if(" + th.has_seventh("o.tt.tq") + ", '7', ''), if(t = nx_kf % 12, '', concat('/', tnum)))"
    return _finish(f"""
        select song_id, run, {_ord('o.ord')} as ord, array(o.tt.seg, nx_seg) as segs, nx_kf as key_idx,
               concat(func, ' → ', tnum) as label, array(func, cast(null as string)) as functions,
               array(o.tt.seg) as explains,
               map('target', tnum, 'target_root', {th.spelled('nx_kf', 't')}, 'preceded_by_ii', cast(by_ii as string)) as attrs,
               {scored(factors)}
        from (select *, {func} as func from (
              select *, {th.target_numeral('nx_kf', 't', 'nx_cls')} as tnum, {prob('nx', 't')} as p_t,
                     coalesce({at('pv', 't + 2')}.pre_ii2 >= 0.5, false) as by_ii, {th.key_name('nx_kf')} as key_label
              from (select *, {th.pmod12('r - 1')} as t from (select *, explode(own) as (r, o) from {{ctx}} where has_next)
                    where o.ord is not null and o.tt.v > 0)) where p_t > 0)""", params, "tritone_sub", ctx=ctx)


def borrowed(ctx: DataFrame, params: dict, entries: list[dict]) -> DataFrame:
    """Modal interchange by table: (mode, degree, classes) entries against every run."""
    spark: SparkSession = ctx.sparkSession
    names = borrowed_features(entries)
    table = spark.createDataFrame(
        [(e["entry_no"], e["mode"] == "minor", e["degree"], e["numeral"], e["source"], e["note"], e["required"],
          names[e["required"], tuple(sorted(e["classes"]))]) for e in entries],
        "entry_no int, minor boolean, degree int, numeral string, source string, note string, required boolean, feat string")
    value = "case b.feat " + " ".join(f"when '{n}' then o.{n}" for n in names.values()) + " end"
    least = params["general"]["min_root_prob"]
    factors = [ev("evidence", "if(required, 'borrowed quality', 'chromatic root')", "f.v"), _key_factor(params)]
    return _finish(f"""
        select song_id, run, {_no_ord('entry_no')} as ord, array(abs(f.seg)) as segs, kl as key_idx,
               concat('%0 (borrowed: ', source, ')') as label, cast(null as array<string>) as functions,
               array(abs(f.seg)) as explains,
               map_concat(map('source', source, 'entry', numeral, 'theory_note', note),
                          if(degree = 10 and has_next and {prob('nx', 'kl')} >= 0.5, map('backdoor', 'true'),
                             cast(map() as map<string,string>))) as attrs, {scored(factors)}
        from (select /*+ broadcast(b) */ *, {value} as f, {th.key_name('kl')} as key_label
              from (select *, explode(own) as (r, o) from {{ctx}}) c join {{b}} b
                on b.minor = (c.kl >= 12) and b.degree = {th.degree('c.r', 'c.kl')}
              where o.rp >= {least}D)""", params, "borrowed_chord", ctx=ctx, b=table)


def aeolian_cadence(ctx: DataFrame, params: dict) -> DataFrame:
    """♭VI-♭VII-I over three usable runs."""
    p, least = params, params["general"]["min_root_prob"]
    modes = "" if params["aeolian_cadence"]["include_minor_keys"] else "and kf < 12"
    third = "if(kf < 12, o.fst.maj, o.fst.min)"
    factors = [ev("root_motion", "'roots rise by whole steps to the tonic'", "p"),
               ev("quality_♭VI", "'as major ♭VI'", quality_factor(p, "(a.md.v / a.md.rp)", "a.md.c")),
               ev("quality_♭VII", "'as major ♭VII'", quality_factor(p, "(b.md.v / b.md.rp)", "b.md.c")),
               ev("quality_I", "'as tonic'", quality_factor(p, f"coalesce({third}, 0D)", "coalesce(o.fst.bad, 0D)"))]
    return _finish(f"""
        select song_id, run, {_no_ord()} as ord, array(a.md.seg, b.md.seg, seg_first) as segs, kf as key_idx,
               if(kf < 12, '♭VI–♭VII–I', '♭VI–♭VII–i') as label, cast(null as array<string>) as functions,
               cast(array() as array<int>) as explains, map('borrowed', cast(kf < 12 as string)) as attrs,
               {scored(factors)}
        from (select *, a.rp * b.rp * o.rp as p
              from (select *, {at('pv2', 'kf + 8')} as a, {at('pv', 'kf + 10')} as b, {at('own', 'kf')} as o
                    from {{ctx}} where has_prev {modes})) where p >= {least}D""", p, "aeolian_cadence", ctx=ctx)


def deceptive_cadence(ctx: DataFrame, params: dict) -> DataFrame:
    """V to vi or ♭VI, weighed by how the V is prepared."""
    p, c, least = params, params["deceptive_cadence"], params["general"]["min_root_prob"]
    pre_ii, pre_iv = (f"coalesce({at('pv', x)}.{f}, 0D)" for x, f in (("kl + 2", "pre_ii"), ("kl + 5", "pre_iv")))
    prepared = (f"case when {pre_ii} >= 0.5 then {c['prepared']}D "
                f"when {pre_iv} >= 0.5 and v.md.sev >= 0.5 then {c['prepared_iv_seventh']}D "
                f"when {pre_iv} >= 0.5 then {c['prepared_iv_triad']}D when v.md.sev >= 0.5 then {c['seventh_only']}D end")
    match = "coalesce(if(name = 'vi', n.fst.min, n.fst.maj), 0D)"
    factors = [ev("dominant", "'V of the local key'", "v.md.v"), ev("root_motion", "'V moves up a step'", "n.rp"),
               ev("quality_target", "name", quality_factor(p, match, "coalesce(n.fst.bad, 0D)")),
               ev("preparation", "'how the V is prepared'", "prep"), _key_factor(p)]
    return _finish(f"""
        select song_id, run, {_no_ord("if(name = 'vi', 0, 1)")} as ord, array(v.md.seg, nx_seg) as segs, kl as key_idx,
               concat('V–', name, ' (deceptive cadence)') as label, cast(null as array<string>) as functions,
               cast(array() as array<int>) as explains,
               map('target', name, 'borrowed_target', cast(name = '♭VI' and kl < 12 as string)) as attrs,
               {scored(factors)}
        from (select *, {at('nx', 'kl + step')} as n, {prepared} as prep, {th.key_name('kl')} as key_label
              from (select *, {at('own', 'kl + 7')} as v,
                           inline(filter(array(struct('vi' as name, 9 as step), struct('♭VI' as name, 8 as step)),
                                         x -> kl < 12 or x.name = '♭VI')) as (name, step)
                    from {{ctx}} where has_next))
        where v.md.v >= {least}D and n.rp >= {least}D and prep is not null""", p, "deceptive_cadence", ctx=ctx)


def modulation(regions: DataFrame, keyed: DataFrame, params: dict) -> DataFrame:
    """Boundary between two key regions: mean posterior of each key on its own side."""
    n = params["modulation"]["context_segments"]
    pairs = seq.sql(f"""
        select a.song_id, a.region, a.key_idx as old_idx, b.key_idx as new_idx, b.seg_first as cut, b.start as at,
               greatest(a.seg_first, a.seg_until - {n}) as lo, least(b.seg_until, b.seg_first + {n}) as hi
        from {{r}} a join {{r}} b on b.song_id = a.song_id and b.region = a.region + 1""", r=regions)
    spread = pairs.selectExpr("*", "explode(sequence(lo, hi - 1)) as seg")
    return seq.sql(f"""
        with m as (select x.song_id, x.region, x.old_idx, x.new_idx, x.cut, x.at,
                          avg(if(x.seg < x.cut, k.post[x.old_idx], null)) as p_old,
                          avg(if(x.seg >= x.cut, k.post[x.new_idx], null)) as p_new
                   from {{x}} x join {{k}} k on k.song_id = x.song_id and k.seg = x.seg
                   group by x.song_id, x.region, x.old_idx, x.new_idx, x.cut, x.at)
        select song_id, region as run, 'modulation' as type,
               concat({th.key_name('old_idx')}, ' → ', {th.key_name('new_idx')}, ' (', {th.modulation_name('old_idx', 'new_idx')}, ')') as label,
               array(cut - 1, cut) as segs, {th.rounded(unit('p_old * p_new'))} as conf, new_idx as key_idx,
               cast(null as array<string>) as functions, cast(array() as array<int>) as explains,
               map('from', {th.key_name('old_idx')}, 'to', {th.key_name('new_idx')},
                   'interval', {th.modulation_name('old_idx', 'new_idx')},
                   'semitones', cast({th.pmod12('new_idx - old_idx')} as string)) as attrs,
               array(struct('key_before' as kind, 'mean posterior before' as detail, {th.rounded('p_old')} as factor),
                     struct('key_after' as kind, 'mean posterior after' as detail, {th.rounded('p_new')} as factor)) as evidence
        from m""", x=spread, k=keyed)


def detect(ctx: DataFrame, params: dict, entries: list[dict], regions: DataFrame | None = None,
           keys: DataFrame | None = None) -> DataFrame:
    """Union of the enabled rules with their registry order."""
    found: list[DataFrame] = []

    def add(name: str, df: DataFrame) -> None:
        found.append(df.selectExpr("*", f"{RULE_ORDER.index(name)} as rule_no"))

    if params["ii_V_I"]["enabled"]:
        resolved = ii_v_i(ctx, params)
        add("ii_V_I", resolved)
        if params["ii_V_I"]["report_unresolved"]:
            add("ii_V_I", ii_v(ctx, resolved, params))
    plain = {"secondary_dominant": secondary_dominant, "secondary_leading_tone": leading_tone, "tritone_sub": tritone_sub,
             "aeolian_cadence": aeolian_cadence, "deceptive_cadence": deceptive_cadence}
    for name, rule in plain.items():
        if params[name]["enabled"]:
            add(name, rule(ctx, params))
    if params["borrowed"]["enabled"]:
        add("borrowed", borrowed(ctx, params, entries))
    if params["modulation"]["enabled"] and regions is not None:
        add("modulation", modulation(regions, keys, params))
    return reduce(DataFrame.unionByName, found)


def describe(events: DataFrame, keyed: DataFrame) -> DataFrame:
    """Add span, chord labels and numerals of the event's segments; functions default to numerals."""
    shown = keyed.selectExpr("song_id", "seg", "start", "end", "top.label as label",
                             f"coalesce({th.roman_display('top.root', 'top.quality', 'top.bass', 'key_idx')}, top.quality) as numeral")
    return seq.sql("""
        with x as (select e.song_id, e.type, e.run, pos, s.start, s.end, s.label, s.numeral
                   from (select song_id, type, run, posexplode(segs) as (pos, seg) from {e}) e
                   join {s} s on s.song_id = e.song_id and s.seg = e.seg),
             a as (select song_id, type, run, min(start) as start, max(end) as end,
                          sort_array(collect_list(struct(pos, label, numeral, start))) as parts
                   from x group by song_id, type, run)
        select e.song_id, e.run, e.rule_no, e.type, replace(e.label, '%0', a.parts[0].numeral) as label,
               if(e.type = 'modulation', a.parts[1].start, a.start) as start,
               if(e.type = 'modulation', a.parts[1].start, a.end) as end, e.segs, e.key_idx,
               transform(a.parts, p -> p.label) as chords, transform(a.parts, p -> p.numeral) as numerals,
               transform(a.parts, p -> coalesce(get(e.functions, p.pos), p.numeral)) as functions,
               e.conf, e.evidence, e.attrs, e.explains
        from {e} e join a on a.song_id = e.song_id and a.type = e.type and a.run = e.run""", e=events, s=shown)
