"""Evidence of root runs: what every run offers on each of the twelve roots, and its neighbours' view.

``run_context`` is the one table the rules read: a row per rooted run with maps ``root -> evidence``
of the run itself, the usable runs before it and the one after it.  Maps hold at most twelve
entries, so rows stay small however long a run or song is, and every rule is a narrow expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza import theory as th
from cadenza.operators import sequence as seq
from cadenza.operators.segments import seg_candidates


def _weight_case(quality: str, weights: dict[str, float]) -> str:
    cases = " ".join(f"when '{q}' then {w}D" for q, w in weights.items())
    return f"case {quality} {cases} else 0D end"


def dominant_weight(root: str, quality: str, key_idx: str, weights: dict[str, float]) -> str:
    """Weight of a chord as an applied dominant: 0 unless its third, seventh or raised fifth leaves the key."""
    cases = []
    for q, w in weights.items():
        tones = ([] if q == "7sus4" else [4]) + ([10] if q in ("7", "aug7", "7sus4") else []) + (
            [8] if q in ("aug", "aug7") else [])
        row = [float(w) if any(not th.diatonic_mask(0, minor) >> ((deg + t) % 12) & 1 for t in tones) else 0.0
               for minor in (False, True) for deg in range(12)]
        cases.append(f"when '{q}' then {th.pick(row, f'if({key_idx} >= 12, 12, 0) + ' + th.degree(root, key_idx))}")
    return f"case {quality} {' '.join(cases)} else 0D end"


def borrowed_features(entries: list[dict]) -> dict[tuple[bool, tuple[str, ...]], str]:
    """Column name per distinct (quality required, class set)."""
    out: dict[tuple[bool, tuple[str, ...]], str] = {}
    for e in entries:
        k = (e["required"], tuple(sorted(e["classes"])))
        out.setdefault(k, f"b{len(out)}")
    return out


def segments_with_keys(segments: DataFrame, keys: DataFrame) -> DataFrame:
    return seq.sql("""select s.*, k.key_idx, k.key_prob, k.given from {s} s
                      join {k} k on k.song_id = s.song_id and k.seg = s.seg""", s=segments, k=keys)


def class_masses(candidates: DataFrame, classes: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """Per (segment, root): probability, mass of the chord classes and its share; roots under ``least`` are left out."""
    named = ", ".join(f"'{c}'" for c in classes)
    return seq.sql(f"""
        select *, mass / prob as share from (
            select song_id, seg, root, sum(prob) as prob, sum(if(qclass in ({named}), prob, 0D)) as mass
            from {{c}} where root is not null group by song_id, seg, root) where prob >= {least}D""", c=candidates)


def root_masses(keyed: DataFrame, runs: DataFrame, params: dict) -> DataFrame:
    """Per (segment, root): probability, mass by chord class and by rule weight."""
    p = params
    c = seg_candidates(keyed, "run", "key_idx", "top").where("root is not null")
    last = seq.sql("""select r.song_id, r.run, r.seg_first, r.seg_last, k.key_idx as kl, k.top.root as ltr, k.top.quality as ltq
                      from {r} r join {k} k on k.song_id = r.song_id and k.seg = r.seg_last where r.root is not null""",
                   r=runs, k=keyed)
    cls = ", ".join(f"sum(if(qclass = '{x}', prob, 0D)) as {x}" for x in ("maj", "min", "dom", "dim", "hdim", "aug", "sus"))
    chrom = ", ".join(f"sum(if(off and qclass = '{x}', prob, 0D)) as x{x}" for x in th.CLASSES)
    w = p["secondary_dominant"]["weights"]
    return seq.sql(f"""
        with j as (select c.*, l.seg_first, l.seg_last, l.kl, l.ltr, l.ltq, c.core_mask & ~{th.key_mask('l.kl')} <> 0 as off
                   from {{c}} c join {{l}} l on l.song_id = c.song_id and l.run = c.run)
        select song_id, run, seg, root, first(seg_first) as seg_first, first(seg_last) as seg_last,
               first(key_idx) as ks, first(kl) as kl, first(ltr) as ltr, first(ltq) as ltq,
               first(top.root) as tr, first(top.quality) as tq, sum(prob) as rp, max(prob) as maxp, {cls}, {chrom},
               sum(if(off, prob, 0D)) as xall, sum(if({th.has_seventh('quality')}, prob, 0D)) as sev,
               sum(prob * {dominant_weight('root', 'quality', 'kl', w)}) as dw,
               sum(if({dominant_weight('root', 'quality', 'key_idx', w)} > 0, prob, 0D)) as dx,
               sum(prob * {_weight_case('quality', p['secondary_leading_tone']['weights'])}) as lt,
               sum(prob * {_weight_case('quality', p['tritone_sub']['weights'])}) as tt
        from j group by song_id, run, seg, root""", c=c, l=last)


def root_evidence(masses: DataFrame, params: dict, entries: list[dict]) -> DataFrame:
    """Per (run, root): best segments for every role.  Ties go to the last segment; a role without any
    mass points at the run's last segment."""
    least = params["general"]["min_root_prob"]
    b = params["borrowed"]["quality_base"]
    pen = params["quality"]["contradict_penalty"]

    def ties(value: str) -> str:
        return f"cast(floor(({value}) * 1e9D + 0.5D) as bigint)"      # equal up to summation noise

    def best(name: str, value: str, fields: dict[str, str]) -> str:
        rest = "".join(f", {e} as {n}" for n, e in fields.items())
        return f"max(struct({ties(value)} as tie, seg, {value} as v{rest}, rp, tr, tq)) as {name}"

    feats = []
    for (required, classes), name in borrowed_features(entries).items():
        mass = " + ".join(f"x{c}" for c in classes)
        if required:
            feats.append(f"max(struct({ties(mass)} as tie, seg, {mass} as v, ({mass}) / rp as m)) as {name}")
        else:
            contra = "min + dim + hdim" if set(classes) <= {"maj", "dom"} else "maj + dom"
            v = f"xall * greatest({b}D + (1 - {b}D) * ({mass}) / rp - {pen}D * ({contra}) / rp, 0D)"
            feats.append(f"max(struct({ties(v)} as tie, -seg as seg, {v} as v, ({mass}) / rp as m)) as {name}")
    raw = seq.sql(f"""
        select song_id, run, root, first(seg_last) as seg_last, first(kl) as kl, first(ltr) as ltr, first(ltq) as ltq,
          max(rp) as rp, min(if(rp >= {least}D, struct(seg, -rp as nrp, -maxp as np), null)) as ord,
          {best('ii', 'min + hdim + dim', {'c': '(maj + dom + aug) / rp', 'low': '(hdim + dim) / rp'})},
          {best('vv', 'dom + maj + aug', {'s': 'sus / rp', 'c': '(min + dim + hdim) / rp', 'x': 'dx / rp', 'k': 'ks'})},
          {best('md', 'maj + dom', {'c': '(min + dim + hdim) / rp', 'sev': 'sev / rp'})},
          max(struct({ties('dw')} as tie, seg, dw as v, tr, tq)) as dw, max(struct({ties('lt')} as tie, seg, lt as v, tr, tq)) as lt,
          max(struct({ties('tt')} as tie, seg, tt as v, tr, tq)) as tt,
          max(if(seg = seg_first, struct((maj + min) / rp as ok, (dim + hdim) / rp as bad, maj / rp as maj, min / rp as min,
                                         (maj + dom) / rp as md), null)) as fst,
          max(min + hdim + dim) as pre_ii, max(min + hdim) as pre_ii2, max(maj + min) as pre_iv, {', '.join(feats)}
        from {{m}} group by song_id, run, root""", m=masses)

    def settled(name: str, zeros: dict[str, str]) -> str:
        rest = "".join(f", {z} as {n}" for n, z in zeros.items())
        return (f"if({name}.v > 0 or {name}.seg = seg_last, {name}, "
                f"struct(0L as tie, seg_last as seg, 0D as v{rest}, 1D as rp, ltr as tr, ltq as tq)) as {name}")

    keep = ", ".join(borrowed_features(entries).values())
    return raw.selectExpr("song_id", "run", "root", "rp", "ord", settled("ii", {"c": "0D", "low": "0D"}),
                          settled("vv", {"s": "0D", "c": "0D", "x": "0D", "k": "kl"}),
                          settled("md", {"c": "0D", "sev": "0D"}), "dw", "lt", "tt", "fst", "pre_ii", "pre_ii2",
                          "pre_iv", *keep.split(", "))


def run_context(keyed: DataFrame, runs: DataFrame, params: dict, entries: list[dict], size: int | None = seq.BLOCK_ROWS) -> DataFrame:
    """One row per rooted run with its own, previous, second previous and next evidence maps."""
    masses = root_masses(keyed, runs, params)
    ev = root_evidence(masses, params, entries)
    own = ["rp", "ord", "vv", "md", "dw", "lt", "tt", "fst", *borrowed_features(entries).values()]
    prev = ["rp", "ii", "md", "pre_ii", "pre_ii2", "pre_iv"]
    nxt = ["rp", "ord", "fst"]

    def as_map(fields: list[str], name: str) -> str:
        return f"map_from_entries(collect_list(struct(root, struct({', '.join(fields)})))) as {name}"

    maps = seq.stage(seq.sql(f"""
        select song_id, run, {as_map(own, 'own')}, {as_map(prev, 'pv')}, {as_map(['rp', 'md'], 'pv2')}, {as_map(nxt, 'nx')}
        from {{e}} group by song_id, run""", e=ev), size)
    info = seq.sql(f"""
        select r.song_id, r.run, r.root, r.seg_first, r.seg_last, r.prev_run, r.next_run, f.key_idx as kf,
               l.key_idx as kl, l.key_prob as pl, {th.qclass('f.top.quality')} as fcls
        from {{r}} r join {{k}} f on f.song_id = r.song_id and f.seg = r.seg_first
        join {{k}} l on l.song_id = r.song_id and l.seg = r.seg_last where r.root is not null""", r=runs, k=keyed)
    return seq.sql("""
        select i.song_id, i.run, i.root, i.seg_first, i.seg_last, i.kf, i.kl, i.pl, m.own,
               i.prev_run is not null as has_prev, p.pv, q.pv2,
               i.next_run is not null as has_next, n.nx, ni.seg_first as nx_seg, ni.kf as nx_kf, ni.fcls as nx_cls
        from {i} i join {m} m on m.song_id = i.song_id and m.run = i.run
        left join {m} p on p.song_id = i.song_id and p.run = i.prev_run
        left join {i} pi on pi.song_id = i.song_id and pi.run = i.prev_run
        left join {m} q on q.song_id = i.song_id and q.run = pi.prev_run
        left join {m} n on n.song_id = i.song_id and n.run = i.next_run
        left join {i} ni on ni.song_id = i.song_id and ni.run = i.next_run""", i=info, m=maps)
