"""Scoring estimates against references: interval joins, event matching, chord and key scores.

Interval joins carry a time bucket next to ``song_id``, so a long song is spread over many tasks
and no bucket pairs more than the intervals that really meet in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadenza import theory as th
from cadenza.operators import sequence as seq
from cadenza.operators.alignment import align_sequences  # noqa: F401

BUCKET = 64.0


# ------------------------------------------------------------------------------ interval joins

def overlap_join(a: DataFrame, b: DataFrame, width: float = BUCKET) -> DataFrame:
    """Pairs of intervals of one song with a positive overlap: struct columns ``a``, ``b`` and ``w``.

    Both sides need song_id, start and end.  A pair is emitted in the first bucket both touch.
    """
    def bucketed(name: str) -> str:
        return (f"select struct(*) as {name}, song_id, explode(sequence(cast(floor(start / {width}D) as bigint), "
                f"cast(floor(end / {width}D) as bigint))) as slot from {{{name}}}")

    return seq.sql(f"""
        with x as ({bucketed('a')}), y as ({bucketed('b')})
        select x.song_id, a, b, least(a.end, b.end) - greatest(a.start, b.start) as w
        from x join y on x.song_id = y.song_id and x.slot = y.slot
        where a.start < b.end and b.start < a.end and x.slot = cast(floor(greatest(a.start, b.start) / {width}D) as bigint)""",
                   a=a, b=b)


def point_lookup(points: DataFrame, intervals: DataFrame, width: float = BUCKET) -> DataFrame:
    """First interval (by start) that contains each point ``at``: struct columns ``p`` and ``i`` (null if none)."""
    return seq.sql(f"""
        with x as (select struct(*) as p, song_id, monotonically_increasing_id() as id, cast(floor(at / {width}D) as bigint) as slot from {{p}}),
             y as (select struct(*) as i, song_id, explode(sequence(cast(floor(start / {width}D) as bigint),
                          cast(floor(end / {width}D) as bigint))) as slot from {{i}})
        select x.song_id, x.p, min_by(y.i, y.i.start) as i from x left join y on x.song_id = y.song_id and x.slot = y.slot
             and y.i.start <= x.p.at and x.p.at < y.i.end group by x.song_id, x.id, x.p""", p=points, i=intervals)


def nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Closest grid time for every point (ties: the earlier grid index): adds ``grid_idx``, ``grid_at``.

    The two neighbours of a point in the merged time order are enough, so nothing is paired off.
    """
    near = "if(hi is null or (lo is not null and p.at - lo.at <= hi.at - p.at), struct(lo.at as at, -lo.neg as idx), hi)"
    return seq.sql(f"""
        with u as (select song_id, at, struct(*) as p, cast(null as int) as idx from {{p}}
                   union all select song_id, cast(at as double), null, cast(grid_idx as int) from {{g}}),
        n as (select *, max(if(idx is null, null, struct(at, -idx as neg))) over (partition by song_id order by at, if(idx is null, 1, 0)
                          rows between unbounded preceding and current row) as lo,
                     min(if(idx is null, null, struct(at, idx))) over (partition by song_id order by at desc, if(idx is null, 1, 0)
                          rows between unbounded preceding and current row) as hi from u)
        select p.*, {near}.idx as grid_idx, {near}.at as grid_at from n where p is not null""", p=points, g=grid)


# ------------------------------------------------------------------------------ event matching

def match_candidates(gold: DataFrame, pred: DataFrame, params: dict) -> DataFrame:
    """Same-type pairs with match quality: overlap share of the shorter span, or distance for point events.

    ``gold(song_id, gold_id, type, start, end, label)``, ``pred(... pred_id, confidence ...)``.
    """
    m = params["match"]
    tol = m["point_tolerance"]
    wide = tol + 1.0
    slots = f"explode(sequence(cast(floor((start - {wide}D) / {BUCKET}D) as bigint), cast(floor((end + {wide}D) / {BUCKET}D) as bigint)))"
    return seq.sql(f"""
        with g as (select *, {slots} as slot from {{g}}), p as (select *, {slots} as slot from {{p}}),
        j as (select g.song_id, g.type, g.gold_id, p.pred_id, p.confidence, g.start as gs, g.end as ge, p.start as ps, p.end as pe
              from g join p on p.song_id = g.song_id and p.type = g.type and p.slot = g.slot
              where g.slot = cast(floor((greatest(g.start, p.start) - {wide}D) / {BUCKET}D) as bigint)),
        q as (select *, if(ge <= gs or pe <= ps, if(abs(gs - ps) <= {tol}D, 1 - abs(gs - ps) / ({tol}D + 1e-9D), -1D),
                           if((least(ge, pe) - greatest(gs, ps)) / least(ge - gs, pe - ps) >= {m['min_overlap']}D,
                              (least(ge, pe) - greatest(gs, ps)) / least(ge - gs, pe - ps), -1D)) as quality from j)
        select * from q where quality >= 0""", g=gold, p=pred)


def match_events(gold: DataFrame, pred: DataFrame, params: dict) -> DataFrame:
    """One-to-one greedy matching: most confident prediction first takes its best free gold event.

    Only events that meet in time compete, so every stretch of touching candidates is folded alone.
    """
    cand = seq.stage(match_candidates(gold, pred, params))
    pair = "struct<gold_id:bigint,pred_id:bigint>"
    return seq.sql(f"""
        with c as (select *, least(gs, ps) as lo, greatest(ge, pe) as hi from {{c}}),
        b as (select *, max(hi) over (partition by song_id, type order by lo, hi rows between unbounded preceding and 1 preceding) as before from c),
        k as (select *, sum(if(before > lo, 0, 1)) over (partition by song_id, type order by lo, hi
                         rows between unbounded preceding and current row) as grp from b),
        one as (select song_id, type, grp, pred_id, first(confidence) as confidence,
                       sort_array(collect_list(struct(-quality as q, cast(gold_id as bigint) as gold_id))) as options
                from k group by song_id, type, grp, pred_id),
        f as (select song_id, type, aggregate(
                 sort_array(collect_list(struct(-confidence as c, cast(pred_id as bigint) as pred_id, options))),
                 cast(array() as array<{pair}>),
                 (acc, p) -> transform(array(get(filter(p.options, o -> not exists(acc, a -> a.gold_id = o.gold_id)), 0)),
                     o -> if(o is null, acc, concat(acc, array(struct(o.gold_id as gold_id, p.pred_id as pred_id)))))[0]) as pairs
              from one group by song_id, type, grp)
        select song_id, type, x.gold_id, x.pred_id from (select song_id, type, explode(pairs) as x from f)""", c=cand)


def missed_gold(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    return seq.sql("select g.* from {g} g left anti join {m} m on m.song_id = g.song_id and m.gold_id = g.gold_id", g=gold, m=pairs)


def false_positives(pred: DataFrame, pairs: DataFrame) -> DataFrame:
    return seq.sql("select p.* from {p} p left anti join {m} m on m.song_id = p.song_id and m.pred_id = p.pred_id", p=pred, m=pairs)


_RATIOS = """tp, n_gold, n_pred, tp / nullif(n_pred, 0) as precision, tp / nullif(n_gold, 0) as recall,
    case when n_pred = 0 or n_gold = 0 then null when tp = 0 then 0D
         else 2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold) end as f1"""


def event_scores(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and label accuracy per song: by type and overall (type null)."""
    return seq.sql(f"""
        with u as (select song_id, type, 1 as g, 0 as p, 0 as t, 0 as lab, 0 as hit from {{g}}
                   union all select song_id, type, 0, 1, 0, 0, 0 from {{p}}
                   union all select m.song_id, m.type, 0, 0, 1, if(g.label is not null and g.label <> '', 1, 0),
                                    if(g.label is not null and g.label <> '' and g.label = p.label, 1, 0)
                   from {{m}} m join {{g}} g on g.song_id = m.song_id and g.gold_id = m.gold_id
                   join {{p}} p on p.song_id = m.song_id and p.pred_id = m.pred_id),
        s as (select song_id, type, sum(t) as tp, sum(g) as n_gold, sum(p) as n_pred, sum(lab) as labelled, sum(hit) as hits
              from u group by grouping sets ((song_id, type), (song_id)))
        select song_id, type, {_RATIOS}, hits / nullif(labelled, 0) as label_accuracy from s""", g=gold, p=pred, m=pairs)


def corpus_event_scores(scores: DataFrame) -> DataFrame:
    """Corpus totals of the counts, ratios recomputed: by type and overall (type null)."""
    return seq.sql(f"""
        with s as (select type, sum(tp) as tp, sum(n_gold) as n_gold, sum(n_pred) as n_pred, count(*) as songs from {{s}} group by type)
        select type, songs, {_RATIOS} from s""", s=scores)


def attribute_errors(gold: DataFrame, oracle_pairs: DataFrame, system_pairs: DataFrame, oracle_fp: DataFrame,
                     system_fp: DataFrame, params: dict) -> DataFrame:
    """Where errors come from: each gold event and each false positive of the system gets a category.

    A system false positive is an analysis error when any false positive of the oracle run matches it.
    """
    again = match_candidates(oracle_fp.withColumnRenamed("pred_id", "gold_id"), system_fp, params).select("song_id", "pred_id").distinct()
    return seq.sql("""
        select g.song_id, g.type, 'gold' as side, g.gold_id as id,
               case when o.gold_id is not null and s.gold_id is not null then 'ok' when o.gold_id is not null then 'recognition_miss'
                    when s.gold_id is not null then 'analysis_miss_but_system_hit' else 'analysis_miss' end as category
        from {g} g left join {o} o on o.song_id = g.song_id and o.gold_id = g.gold_id
        left join {s} s on s.song_id = g.song_id and s.gold_id = g.gold_id
        union all
        select f.song_id, f.type, 'pred', f.pred_id, if(a.pred_id is not null, 'analysis_fp', 'recognition_fp')
        from {f} f left join {a} a on a.song_id = f.song_id and a.pred_id = f.pred_id""",
                   g=gold, o=oracle_pairs, s=system_pairs, f=system_fp, a=again)


# ------------------------------------------------------------------------------ chords

def top_intervals(frames: DataFrame, size: int | None = None) -> DataFrame:
    """Most probable candidate per frame, touching equal labels merged (for scoring)."""
    from cadenza.functions import labels as lb
    f = frames.selectExpr("song_id", "frame_idx", "time", "duration",
                          "get(array_sort(candidates, (x, y) -> case when x.prob > y.prob then -1 when x.prob < y.prob then 1 else 0 end), 0).label as label")
    dim = lb.chord_dim(f)
    f = seq.sql("""select f.song_id, f.frame_idx, f.time as start, f.time + f.duration as end,
                          if(coalesce(d.ok, false), d.harte, 'X') as harte, d.root, d.quality
                   from {f} f left join {d} d on d.label = f.label""", f=f, d=dim)
    if size is not None:
        f = seq.stage(f)
    m = seq.islands(f, "frame_idx", "p.harte = harte and abs(p.end - start) < 1e-6D", "struct(harte, end)", "idx", size)
    return seq.sql("""select song_id, idx, first(harte) as harte, first(root) as root, coalesce(first(quality), 'X') as quality,
                             min(start) as start, max(end) as end from {m} group by song_id, idx""", m=m)


def chord_comparison(a: str, b: str) -> dict[str, str]:
    """SQL score 1 / 0 / null (out of vocabulary) of estimate ``b`` against reference ``a`` per level.

    Both sides need root and quality; masks are relative to the root.
    """
    def m(x: str) -> str:
        return f"coalesce({th.lookup({q: th.mask(r['semis']) for q, r in th.QUALITIES.items()}, x + '.quality')}, 0)"

    same_root = f"({a}.root <=> {b}.root)"
    known = f"{a}.quality <> 'X'"
    no_x = f"{b}.quality <> 'X'"
    ra, rb = m(a), m(b)
    low = 0b11111111

    def score(cond: str, vocabulary: str = "true") -> str:
        return f"if({known} and {vocabulary}, if({no_x} and {cond}, 1D, 0D), null)"

    triad_vocab = f"({a}.root is null or ({ra} & {low}) in ({th.mask((0, 4, 7))}, {th.mask((0, 3, 7))}))"
    seventh_vocab = (f"({a}.root is null or {ra} in (" + ", ".join(str(th.mask(th.QUALITIES[q]["semis"])) for q in
                                                                  ("maj", "min", "maj7", "7", "min7")) + "))")
    shared = f"bit_count({th.rotl12('(' + ra + ')', f'coalesce({a}.root, 0)')} & {th.rotl12('(' + rb + ')', f'coalesce({b}.root, 0)')})"
    return {
        "root": score(same_root), "thirds": score(f"{same_root} and ({ra} & 8) = ({rb} & 8)"),
        "triads": score(f"{same_root} and ({ra} & {low}) = ({rb} & {low})"), "tetrads": score(f"{same_root} and {ra} = {rb}"),
        "majmin": score(f"{same_root} and ({ra} & {low}) = ({rb} & {low})", triad_vocab),
        "sevenths": score(f"{same_root} and {ra} = {rb}", seventh_vocab),
        "mirex": score(f"(({a}.root is null and {b}.root is null) or {shared} >= 3)", f"({a}.root is null or bit_count({ra}) >= 3)"),
    }


COMPARED = ["root", "thirds", "triads", "tetrads", "majmin", "sevenths", "mirex"]
LEVELS = [*COMPARED, "seg"]


def chord_scores(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """Duration-weighted chord scores per song over overlapping reference and estimate intervals, and the segmentation score.

    Intervals come merged, as ``top_intervals`` gives them.
    """
    from cadenza.operators.segmentation import segmentation_score
    j = overlap_join(reference.select("song_id", "start", "end", "root", "quality"),
                     estimate.select("song_id", "start", "end", "root", "quality"))
    cmp_ = chord_comparison("a", "b")
    j = j.selectExpr("song_id", "w", *[f"{e} as {n}" for n, e in cmp_.items()])
    aggs = ", ".join(f"sum({n} * w) / nullif(sum(if({n} is null, 0D, w)), 0D) as {n}" for n in COMPARED)
    scores = seq.sql(f"select song_id, {aggs}, sum(w) as duration from {{j}} group by song_id", j=j)
    named = [df.selectExpr("song_id", "start", "end", "cast(null as string) as label") for df in (reference, estimate)]
    return seq.sql("select s.*, g.seg from {s} s left join {g} g on g.song_id = s.song_id", s=scores, g=segmentation_score(*named))


def corpus_chord_scores(scores: DataFrame) -> DataFrame:
    """Duration-weighted corpus means."""
    return seq.sql(
        "select count(*) as songs, " + ", ".join(f"sum({n} * duration) / sum(if({n} is null, 0D, duration)) as {n}" for n in LEVELS)
        + " from {s}", s=scores)


# ------------------------------------------------------------------------------ keys and numerals

def local_key_scores(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Overlap-weighted local key agreement: weighted score, exact, tonic.  ``spans(song_id, start, end, key_idx)``."""
    k = keyed.where("top.quality not in ('N', 'X')").selectExpr("song_id", "start", "end", "key_idx")
    j = overlap_join(spans.select("song_id", "start", "end", "key_idx"), k)
    score = th.key_score_table(keyed.sparkSession)
    return seq.sql("""
        select /*+ broadcast(s) */ j.song_id, sum(w * s.key_score) / sum(w) as weighted,
               sum(if(a.key_idx = b.key_idx, w, 0D)) / sum(w) as exact, sum(if(a.key_idx % 12 = b.key_idx % 12, w, 0D)) / sum(w) as tonic,
               sum(w) as duration
        from {j} j join {s} s on s.ref_idx = j.a.key_idx and s.est_idx = j.b.key_idx group by j.song_id""", j=j, s=score)


def numeral_agreement(oracle: DataFrame, system: DataFrame) -> DataFrame:
    """Time-weighted agreement of numerals (strict display, degree only) between two keyed segmentations."""
    def side(k: DataFrame) -> DataFrame:
        return k.where("top.root is not null").selectExpr(
            "song_id", "start", "end", f"{th.roman_display('top.root', 'top.quality', 'top.bass', 'key_idx')} as display",
            f"{th.degree('top.root', 'key_idx')} as degree")

    j = overlap_join(side(oracle), side(system))
    return seq.sql("""select song_id, sum(if(a.display = b.display, w, 0D)) / sum(w) as strict,
                             sum(if(a.degree = b.degree, w, 0D)) / sum(w) as degree, sum(w) as duration
                      from {j} group by song_id""", j=j)


def home_key(spans: DataFrame) -> DataFrame:
    """Longest-held key per song (ties: the key seen first)."""
    return seq.sql("""
        with d as (select song_id, key_idx, sum(end - start) as held, min(start) as seen from {s} group by song_id, key_idx)
        select song_id, max_by(key_idx, struct(held, -seen)) as key_idx, max(held) as held from d group by song_id""", s=spans)


def expert_scores(keyed: DataFrame, numerals: DataFrame, functions: DataFrame) -> DataFrame:
    """Agreement with expert numerals ``numerals(song_id, start, end, value)`` per song.

    Degree hits at the span's midpoint; applied dominants / leading-tone chords found and confirmed by
    any overlap of our functional labels ``functions(song_id, seg, functions)``.  Every song with expert
    numerals has a row, also without a hit.
    """
    from cadenza.functions import labels as lb
    spans = numerals.selectExpr("*", f"{lb.numeral_degree('value')} as degree", f"{lb.applied_target('value')} as target",
                                "(start + end) / 2 as at")
    hits = point_lookup(spans.where("degree is not null").select("song_id", "start", "at", "degree"), keyed.selectExpr(
        "song_id", "start", "end", f"{th.degree('top.root', 'key_idx')} as degree"))
    tails = "filter(functions, f -> f like 'V%/%' or f like 'vii%/%')"
    pred = seq.sql(f"""select k.song_id, k.start, k.end, {lb.numeral_degree("split_part(get(hit, 0), '/', 2)")} as target
                       from (select song_id, seg, {tails} as hit from {{f}}) f
                       join {{k}} k on k.song_id = f.song_id and k.seg = f.seg where size(hit) > 0""", f=functions, k=keyed)
    gold = seq.stage(spans.where("target is not null").selectExpr("song_id", "start", "end", "target", "monotonically_increasing_id() as span"))
    both = overlap_join(gold, pred)
    return seq.sql("""
        with h as (select song_id, count(*) as numeral_n, sum(if(p.degree = i.degree, 1, 0)) as numeral_hits
                   from {h} where i.degree is not null group by song_id),
        g as (select song_id, count(*) as gold from {g} group by song_id), p as (select song_id, count(*) as pred from {p} group by song_id),
        r as (select song_id, count(distinct a.span) as tp_recall, count(distinct if(a.target = b.target, a.span, null)) as target_ok,
                     count(distinct b.start) as tp_precision from {b} group by song_id),
        s as (select distinct song_id from {s})
        select s.song_id, coalesce(numeral_n, 0) as numeral_n, coalesce(numeral_hits, 0) as numeral_hits, coalesce(gold, 0) as applied_gold, coalesce(pred, 0) as applied_pred,
               coalesce(tp_recall, 0) as applied_tp_recall, coalesce(tp_precision, 0) as applied_tp_precision,
               coalesce(target_ok, 0) as applied_target_ok
        from s left join h on h.song_id = s.song_id left join g on g.song_id = s.song_id
        left join p on p.song_id = s.song_id left join r on r.song_id = s.song_id""", h=hits, g=gold, p=pred, b=both, s=numerals)


def expert_summary(rows: DataFrame) -> DataFrame:
    """Corpus roll-up of ``expert_scores``: degree accuracy, recall, precision and target agreement of applied chords."""
    return seq.sql("""
        select count(*) as songs, sum(numeral_hits) / nullif(sum(numeral_n), 0) as numeral_degree_acc,
               sum(applied_gold) as applied_gold, sum(applied_pred) as applied_pred,
               sum(applied_tp_recall) / nullif(sum(applied_gold), 0) as applied_recall,
               sum(applied_tp_precision) / nullif(sum(applied_pred), 0) as applied_precision,
               sum(applied_target_ok) / nullif(sum(applied_tp_recall), 0) as target_agreement from {r}""", r=rows)


# ------------------------------------------------------------------------------ corpus report

def evaluation_report(chords: DataFrame, errors: dict[str, DataFrame], numerals: DataFrame, local_keys: DataFrame,
                      attribution: DataFrame) -> DataFrame:
    """Corpus figures as rows ``(measure, value)`` from the per-song score tables.

    Chord scores and local keys weigh by duration, symbol error rates (``errors``: level -> alignment) by the
    number of reference chords, numeral agreement by song; error categories are counted.
    """
    def rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        pairs = ", ".join(f"'{name}', cast({value} as double)" for name, value in columns.items())
        return df.selectExpr(f"stack({len(columns)}, {pairs}) as (measure, value)")

    out = rows(corpus_chord_scores(chords), {"songs": "songs"} | {f"chord {n}": n for n in ("root", "majmin", "sevenths", "mirex", "seg")})
    for level, aligned in errors.items():
        rate = aligned.selectExpr("sum(cost) / nullif(sum(n_ref), 0) as x")
        out = out.unionByName(rows(rate, {f"symbol error {level}": "x"}))
    means = numerals.selectExpr("avg(strict) as strict", "avg(degree) as degree")
    out = out.unionByName(rows(means, {"numeral agreement": "strict", "numeral degree agreement": "degree"}))
    kinds = ("weighted", "exact", "tonic")
    keys = local_keys.selectExpr(*[f"sum({k} * duration) / nullif(sum(duration), 0) as {k}" for k in kinds])
    out = out.unionByName(rows(keys, {f"local key {k}": k for k in kinds}))
    counted = attribution.groupBy("category").count()
    return out.unionByName(counted.selectExpr("concat('errors ', category) as measure", "cast(count as double) as value"))


# ------------------------------------------------------------------------------ sweeps

def best_parameters(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Best grid point whose key score stays within ``tolerance`` of the default's, else the default.

    ``rows(param_id, is_default, objective, local_key)``.
    """
    return seq.sql(f"""
        with d as (select max_by(struct(param_id, objective), is_default) as base, max(if(is_default, local_key, null)) as floor from {{r}}),
        ok as (select r.* from {{r}} r cross join d where not r.is_default and (d.floor is null or r.local_key is null
               or r.local_key >= d.floor - {tolerance}D)),
        b as (select max_by(struct(param_id, objective), struct(objective, -param_id)) as top from ok)
        select coalesce(b.top.param_id, d.base.param_id) as param_id, coalesce(b.top.objective, d.base.objective) as objective
        from d cross join b""", r=rows)


def segmentation_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of time on which two labelled segmentations carry the same label."""
    j = overlap_join(a.select("song_id", "start", "end", "label"), b.select("song_id", "start", "end", "label"))
    return seq.sql("select song_id, sum(if(a.label = b.label, w, 0D)) / sum(w) as agreement from {j} group by song_id", j=j)
