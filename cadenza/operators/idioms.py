"""Named progressions: transposition-invariant patterns over the chain of usable runs.

Every run is scored once against every pattern position it could fill (a fixed literal list, so no
join), rows below the floor drop out, and a match is the longest prefix of positions whose runs
follow each other: position i of a match that starts at chain count u sits at count u + i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza import theory as th
from cadenza.operators import sequence as seq
from cadenza.operators.segments import seg_candidates

DEFINITE = ["maj", "min", "dom", "dim", "hdim", "aug"]


def _sets(idioms: list[dict], field: str) -> list[tuple]:
    out: list[tuple] = []
    for i in idioms:
        for p in i["positions"]:
            if p[field] is not None and tuple(sorted(p[field])) not in out:
                out.append(tuple(sorted(p[field])))
    return out


def pattern_evidence(segments_with_run: DataFrame, runs: DataFrame, params: dict, idioms: list[dict],
                     size: int | None = None) -> DataFrame:
    """Per rooted run: map root -> (probability, best segment per class set) and bass shares per tonic."""
    classes, basses = _sets(idioms, "classes"), _sets(idioms, "bass")
    w = params["general"]["bass_head_weight"]
    c = seg_candidates(segments_with_run, "run", "bass_head")
    masses = ", ".join(f"sum(if(qclass in ({', '.join(repr(x) for x in s)}), prob, 0D)) as m{j}, sum(if(qclass in "
                       f"({', '.join(repr(x) for x in DEFINITE if x not in s)}), prob, 0D)) as c{j}" for j, s in enumerate(classes))
    per_root = seq.sql(f"select song_id, run, seg, root, sum(prob) as rp, {masses} from {{c}} where root is not null "
                       "group by song_id, run, seg, root", c=c)
    best = ", ".join(f"max(struct(cast(floor(m{j} * 1e9D + 0.5D) as bigint) as tie, seg, m{j} as v, m{j} / rp as m, c{j} / rp as c)) as k{j}" for j in range(len(classes)))
    fields = ", ".join(f"if(k{j}.v > 0 or k{j}.seg = r.seg_last, k{j}, struct(0L as tie, r.seg_last as seg, 0D as v, 0D as m, 0D as c)) as k{j}"
                       for j in range(len(classes)))
    head = "coalesce(first(bass_head)[{0}], 0D)"
    has_head = "coalesce(array_max(first(bass_head)), 0D) > 0"
    share = ", ".join(
        f"if({has_head}, (1 - {w}D) * {cand} + {w}D * {head.format(i)}, {cand}) as s{i}" for i, cand in (
            (i, f"sum(if(coalesce(bass, root) = {i}, prob, 0D)) / coalesce(nullif(sum(if(root is not null, prob, 0D)), 0D), 1D)")
            for i in range(12)))
    tonic_max = ", ".join("array(" + ", ".join(
        "max(" + " + ".join(f"s{(t + b) % 12}" for b in s) + ")" for t in range(12)) + f") as bass{j}" for j, s in enumerate(basses))
    linked = seq.running_sum(runs, "run", "if(state = 'use', 1, 0)", "u", size)
    linked = seq.running_sum(linked, "run", "if(state = 'block', 1, 0)", "walls", size)
    tables = {"p": per_root, "r": linked.where("root is not null")}
    bass_cte = bass_cols = bass_join = ""
    if basses:
        tables["c"] = c
        bass_cte = (f", sb as (select song_id, run, seg, {share} from {{c}} group by song_id, run, seg), "
                    f"b as (select song_id, run, {tonic_max} from sb group by song_id, run)")
        bass_cols = "".join(f", b.bass{j}" for j in range(len(basses)))
        bass_join = "left join b on b.song_id = r.song_id and b.run = r.run"
    return seq.sql(f"""
        with a as (select song_id, run, root, max(rp) as rp, max(struct(cast(floor(rp * 1e9D + 0.5D) as bigint) as tie, seg)) as top, {best}
                   from {{p}} group by song_id, run, root),
             m as (select a.song_id, a.run, map_from_entries(collect_list(struct(a.root, struct(
                          rp, top.seg as any_seg, {fields})))) as rk
                   from a join {{r}} r on r.song_id = a.song_id and r.run = a.run group by a.song_id, a.run) {bass_cte}
        select r.song_id, r.run, r.root, r.state, r.seg_first, r.seg_last, r.u, r.walls, r.prev_run, r.next_run, m.rk{bass_cols}
        from {{r}} r join m on m.song_id = r.song_id and m.run = r.run {bass_join}""", **tables)


def _positions(idioms: list[dict], with_bass: bool) -> str:
    """Literal list of (idiom, position, options): one row per option, which must win among its rivals."""
    classes, basses = _sets(idioms, "classes"), _sets(idioms, "bass")
    width = max(len(p["degrees"]) for i in idioms for p in i["positions"])
    rows = []
    for i in idioms:
        for n, p in enumerate(i["positions"]):
            if bool(p["bass"]) != with_bass:
                continue
            feat = classes.index(tuple(sorted(p["classes"]))) if p["classes"] else -1
            bass = basses.index(tuple(sorted(p["bass"]))) if p["bass"] else -1
            for o, d in enumerate(p["degrees"]):
                group = [d] if n == 0 else p["degrees"]
                opts = [str(x) for x in group] + ["cast(null as int)"] * (width - len(group))
                rows.append(f"struct({i['idiom']} as idiom, {n} as pos, {d} as deg, {0 if n == 0 else o} as rank, {len(group)} as n_opts, "
                            f"{feat} as feat, {bass} as bset, " + ", ".join(f"{x} as o{k}" for k, x in enumerate(opts)) + ")")
    return f"array({', '.join(rows)})" if rows else ""


def score_positions(evidence: DataFrame, params: dict, idioms: list[dict]) -> DataFrame:
    """Rows (run, idiom, position, tonic) whose evidence reaches the floor.

    Positions defined by roots start from the likely roots of the run, positions defined by the bass
    from the likely bass; an option counts only where it is the likeliest of its position.
    """
    q, floor = params["quality"], params["named_progressions"]["min_position_factor"]
    classes, basses = _sets(idioms, "classes"), _sets(idioms, "bass")
    width = max(len(p["degrees"]) for i in idioms for p in i["positions"])
    opts = ", ".join(f"o{k}" for k in range(width))
    names = f"idiom, pos, deg, rank, n_opts, feat, bset, {opts}"
    rp = [f"if(o{k} is null, -1D, rps[pmod(tonic + o{k}, 12)])" for k in range(width)]
    wins = " and ".join(f"(rank = {k} or p{k} < own or (p{k} = own and rank < {k}))" for k in range(width))
    total = " + ".join(f"greatest(p{k}, 0D)" for k in range(width))
    k = "case feat " + " ".join(f"when {j} then k.k{j}" for j in range(len(classes))) + " end" if classes else \
        "cast(null as struct<tie:bigint,seg:int,v:double,m:double,c:double>)"
    # rows are multiplied by positions, so they carry twelve probabilities and one root's evidence, not the map
    base = "song_id, run, root, state, seg_first, seg_last, u, walls, rps"
    source = f"(select {base.replace(', rps', '')}, transform(sequence(0, 11), i -> coalesce(try_element_at(rk, i).rp, 0D)) as rps, "
    none = "cast(null as double)"
    parts, tables = [], {"e": evidence}
    if _positions(idioms, False):
        least = floor / width
        parts.append(f"""
            select {base}, {names}, cast(pmod(pc - deg, 12) as int) as tonic, {none} as bass, k
            from (select *, inline({_positions(idioms, False)}) as ({names})
                  from {source} explode(rk) as (pc, k) from {{e}}) where k.rp >= {least}D)
            where if(pos = 0, pc = root, state = 'use') and k.rp >= {floor}D / n_opts""")
    if basses:
        by_tonic = "case bset " + " ".join(f"when {j} then bass{j}" for j in range(len(basses))) + " end"
        parts.append(f"""
            select {base}, {names}, tonic, bass_by_tonic[tonic] as bass, try_element_at(rk, cast(pmod(tonic + deg, 12) as int)) as k
            from (select *, explode(filter(sequence(0, 11), i -> bass_by_tonic[i] >= {floor}D)) as tonic
                  from (select *, {by_tonic} as bass_by_tonic from (select *, inline({_positions(idioms, True)}) as ({names})
                        from {source} rk, {', '.join(f'bass{j}' for j in range(len(basses)))} from {{e}}))))
            where if(pos = 0, tonic = pmod(root - deg, 12), state = 'use')""")
    quality = (f"if(feat < 0, 1D, greatest({q['base']}D + (1 - {q['base']}D) * coalesce(kk.m, 0D) - {q['contradict_penalty']}D * coalesce(kk.c, 0D), 0D))")
    return seq.sql(f"""
        with t as ({' union all '.join(parts)}),
        p as (select *, {', '.join(f'{e} as p{n}' for n, e in enumerate(rp))} from t),
        w as (select *, least(1D, {total}) as p_root, {k} as kk from (select *, coalesce(k.rp, 0D) as own from p) where {wins}),
        f as (select *, if(bset >= 0, bass * ({q['base']}D + (1 - {q['base']}D) * p_root), p_root) * {quality} as f from w)
        select song_id, run, seg_first, seg_last, u, walls, idiom, pos, tonic, deg, f,
               if(feat < 0, coalesce(k.any_seg, seg_last), coalesce(kk.seg, seg_last)) as seg
        from f where f >= {floor}D""", **tables)


def match_progressions(evidence: DataFrame, params: dict, idioms: list[dict]) -> DataFrame:
    """All matches before de-duplication: representative segments, runs, used degrees, confidence."""
    least = params["general"]["min_event_confidence"]
    scored = seq.stage(score_positions(evidence, params, idioms))
    spark = evidence.sparkSession
    table = spark.createDataFrame([(i["idiom"], i["name"], i["alias"], i["use_key_prior"], i["min_length"]) for i in idioms],
                                  "idiom int, name string, alias string, use_key_prior boolean, min_length int")
    return seq.sql(f"""
        with s as (select *, u - pos as u0, struct(pos, run, seg, deg, f, seg_first, seg_last) as step from {{s}}),
        more as (select song_id, idiom, tonic, walls, u0, sort_array(collect_list(step)) as steps
                 from s where pos > 0 group by song_id, idiom, tonic, walls, u0),
        m as (select h.song_id, h.idiom, h.tonic, h.run, concat(array(h.step), filter(coalesce(m.steps, array()),
                     (z, i) -> z.pos = i + 1)) as steps
              from s h left join more m on m.song_id = h.song_id and m.idiom = h.idiom and m.tonic = h.tonic
                and m.walls = h.walls and m.u0 = h.u0 where h.pos = 0),
        c as (select *, exp(aggregate(steps, 0D, (a, z) -> a + ln(z.f)) / size(steps)) as conf from m)
        select /*+ broadcast(i) */ c.song_id, c.idiom, i.name, i.alias, i.use_key_prior, c.tonic, c.run,
               transform(steps, z -> z.seg) as segs, transform(steps, z -> z.run) as runs, transform(steps, z -> z.deg) as degrees,
               {th.rounded('conf')} as conf
        from c join {{i}} i on i.idiom = c.idiom where size(steps) >= i.min_length and conf >= {least}D""", s=scored, i=table)


def drop_overlaps(matches: DataFrame) -> DataFrame:
    """Among overlapping matches of one name keep the longest, then most confident, then earliest.

    Matches that do not overlap never compete, so each stretch of overlapping spans is one group.
    """
    return seq.sql("""
        with s as (select *, array_min(segs) as lo, array_max(segs) as hi from {m}),
        b as (select *, max(hi) over (partition by song_id, name order by lo, hi
                          rows between unbounded preceding and 1 preceding) as before from s),
        g as (select *, sum(if(before >= lo, 0, 1)) over (partition by song_id, name order by lo, hi
                          rows between unbounded preceding and current row) as grp from b),
        k as (select song_id, name, aggregate(
                 sort_array(collect_list(struct(-size(segs) as a, -conf as b, segs[0] as c, idiom, run, tonic, segs, runs, degrees,
                                                conf, alias, use_key_prior))),
                 cast(array() as array<struct<a:int,b:double,c:int,idiom:int,run:int,tonic:int,segs:array<int>,runs:array<int>,
                                              degrees:array<int>,conf:double,alias:string,use_key_prior:boolean>>),
                 (acc, z) -> if(exists(acc, y -> arrays_overlap(y.segs, z.segs)), acc, concat(acc, array(z)))) as kept
              from g group by song_id, name, grp)
        select song_id, name, x.alias, x.idiom, x.tonic, x.run, x.segs, x.runs, x.degrees, x.conf, x.use_key_prior
        from (select song_id, name, explode(kept) as x from k)""", m=matches)


def loop_segments(matches: DataFrame, evidence: DataFrame, params: dict) -> DataFrame:
    """Segments owned by a progression: its runs, a restart right after it and a pickup right before it."""
    least = params["named_progressions"]["loop_root_prob"]
    return seq.sql(f"""
        with m as (select song_id, tonic, runs, runs[0] as head, element_at(runs, -1) as tail, degrees[0] as d0,
                          element_at(degrees, -1) as d1 from {{m}}),
        owned as (select song_id, explode(runs) as run from m),
        edge as (select m.song_id, e.next_run as run, cast(pmod(tonic + d0, 12) as int) as pc from m
                 join {{e}} e on e.song_id = m.song_id and e.run = m.tail
                 union all
                 select m.song_id, e.prev_run, cast(pmod(tonic + d1, 12) as int) from m
                 join {{e}} e on e.song_id = m.song_id and e.run = m.head),
        hit as (select x.song_id, x.run from edge x join {{e}} e on e.song_id = x.song_id and e.run = x.run
                where coalesce(try_element_at(e.rk, x.pc).rp, 0D) >= {least}D),
        r as (select song_id, run from owned union select song_id, run from hit)
        select r.song_id, explode(sequence(e.seg_first, e.seg_last)) as seg from r
        join {{e}} e on e.song_id = r.song_id and e.run = r.run""", m=matches, e=evidence)


def key_prior(matches: DataFrame, evidence: DataFrame, params: dict) -> DataFrame:
    """Emission bonus of the reference key on the segments of progressions that ask for it (max, not sum)."""
    w = params["named_progressions"]["key_prior"]
    return seq.sql(f"""
        with m as (select song_id, tonic, conf, explode(runs) as run from {{m}} where use_key_prior),
        s as (select m.song_id, m.tonic as key_idx, m.conf, explode(sequence(e.seg_first, e.seg_last)) as seg
              from m join {{e}} e on e.song_id = m.song_id and e.run = m.run)
        select song_id, seg, key_idx, max({w}D * conf) as bonus from s group by song_id, seg, key_idx""", m=matches, e=evidence)


def describe_progressions(matches: DataFrame, segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Named progressions with span, numerals in the reference key and whether they biased the key."""
    return seq.sql(f"""
        with x as (select song_id, name, run, idiom, tonic, posexplode(segs) as (pos, seg) from {{m}}),
        d as (select x.song_id, x.name, x.run, x.idiom, x.tonic, min_by(s.start, pos) as start, max_by(s.end, pos) as end,
                     transform(sort_array(collect_list(struct(pos, coalesce({th.roman_display(
                         's.top.root', 's.top.quality', 's.top.bass', 'x.tonic')}, s.top.quality) as n))), z -> z.n) as numerals,
                     first(k.given) as given
              from x join {{s}} s on s.song_id = x.song_id and s.seg = x.seg
              join {{k}} k on k.song_id = x.song_id and k.seg = x.seg
              group by x.song_id, x.name, x.run, x.idiom, x.tonic)
        select m.song_id, m.name, m.alias, d.start, d.end, m.segs, {th.key_name('m.tonic')} as reference_key, d.numerals,
               m.conf, m.use_key_prior and not d.given as key_prior_applied
        from {{m}} m join d on d.song_id = m.song_id and d.name = m.name and d.run = m.run and d.idiom = m.idiom
             and d.tonic = m.tonic""", m=matches, s=segments, k=keys.select("song_id", "seg", "given"))
