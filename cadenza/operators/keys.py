"""Local keys: emissions by SQL aggregation, then a 24-state chain decoded per song block.

The chain (stay 0, switch -penalty) is sequential inside a song.  Songs that fit one block are
decoded in one pass, many songs per Arrow batch.  Longer songs are cut into blocks: every block is
first reduced to a 24 x 24 transfer matrix, the matrices are combined in groups of bounded size
(a tree, so no task ever holds a whole song), and the vectors entering each block then let all
blocks be decoded independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadenza import theory as th
from cadenza.operators import sequence as seq
from cadenza.operators.segments import seg_candidates

K = 24
GROUP = 128          # block matrices combined per task
TIE = 1e-9           # scores closer than this are equal


# ------------------------------------------------------------------------------ emissions

def emission_parts(segments: DataFrame, params: dict) -> DataFrame:
    """Per segment: likelihood of the 24 keys and major / minor / dominant mass on the 12 roots.

    One aggregation with fixed columns (no array explosion, partial sums before any shuffle).
    """
    fit = th.fit_table(segments.sparkSession, params["key"]["seventh_off_scale_penalty"])
    cands = seg_candidates(segments, "beats")
    like = ", ".join(f"coalesce(sum(if(c.prob > 0, c.prob * f.key_like[{k}], null)), 0D)" for k in range(K))

    def mass(cls: str) -> str:
        return ", ".join(f"sum(if(c.root = {r} and c.qclass = '{cls}', c.prob, 0D))" for r in range(12))

    return seq.sql(f"""
        select /*+ broadcast(f) */ c.song_id, c.seg, first(c.beats) as beats, sum(if(c.prob > 0, c.prob, 0D)) as total,
               sum(if(c.root is null, c.prob, 0D)) as silent, max(if(c.root is not null and c.prob > 0, 1, 0)) as rooted,
               array({like}) as like, array({mass('maj')}) as maj, array({mass('min')}) as min, array({mass('dom')}) as dom
               {leading_tone(params)}
        from {{c}} c left join {{f}} f on c.root = f.root and c.quality = f.quality
        group by c.song_id, c.seg""", c=cands, f=fit)


def leading_tone(params: dict) -> str:
    if not params["key"]["minor_leading_tone_bonus"]:
        return ""
    dim = ", ".join(f"sum(if(c.root = {r} and c.qclass = 'dim', c.prob, 0D))" for r in range(12))
    return f", array({dim}) as dim"


def before_cadence(parts: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """Adds ``prev_v``: per root, the dominant mass of the segment before (dominants and a share of major chords)."""
    if size is not None:
        parts = seq.stage(parts)
    cadence = f"transform(sequence(0, 11), i -> dom[i] + {params['key']['cadence_triad_factor']}D * maj[i])"
    return seq.neighbour(parts.selectExpr("*", f"{cadence} as v"), "seg", "v", "prev_v", size)


def boundary_segments(parts: DataFrame) -> DataFrame:
    """First and last segment of every song that holds a rooted chord."""
    return seq.sql("""select song_id, min(if(rooted = 1, seg, null)) as first_seg, max(if(rooted = 1, seg, null)) as last_seg
                      from {p} group by song_id""", p=parts)


def key_weight(params: dict) -> str:
    """Weight of a segment's evidence by its length in beats."""
    k = params["key"]
    return f"least(greatest(beats / {k['beats_per_weight_unit']}D, {k['weight_min']}D), {k['weight_max']}D)"


def emissions(segments: DataFrame, params: dict, size: int | None = None, exempt: DataFrame | None = None,
              prior: DataFrame | None = None) -> DataFrame:
    """Log evidence of the 24 keys per segment: ``(song_id, seg, beats, emission ARRAY<DOUBLE>)``.

    ``exempt(song_id, seg)``: segments without boundary bonus.  ``prior(song_id, seg, key_idx, bonus)``.
    """
    k = params["key"]
    parts = before_cadence(emission_parts(segments, params), params, size)
    ends = []
    if k["boundary_tonic_bonus"]:
        ends = {"both": ["first_seg", "last_seg"], "first": ["first_seg"], "last": ["last_seg"]}[k["boundary_positions"]]
    weight = key_weight(params)
    exprs = []
    for i in range(K):
        r, minor = i % 12, i >= 12
        ton = f"{'min' if minor else 'maj'}[{r}]"
        e = f"ln(like[{i}] / total + silent / total)"
        if minor:
            e += f" + ({k['minor_bias']}D)"
            if k["minor_leading_tone_bonus"]:
                five, seven = (r + 7) % 12, (r + 11) % 12
                e += f" + {k['minor_leading_tone_bonus']}D * (maj[{five}] + dom[{five}] + dim[{seven}])"
        body = (f"{weight} * ({e}) + {k['cadence_bonus']}D * coalesce(prev_v[{(r + 7) % 12}], 0D) * {ton}")
        exprs.append(f"if(rooted = 1, {body}, 0D) + if(at_end, {k['boundary_tonic_bonus']}D * {ton}, 0D)")
    at_end = " or ".join(f"p.seg = e.{c}" for c in ends) or "false"
    tables = {"p": parts, "e": boundary_segments(parts)}
    not_exempt = ""
    if exempt is not None:
        tables["x"] = exempt
        not_exempt = "left join (select distinct song_id, seg, true as hit from {x}) x on x.song_id = p.song_id and x.seg = p.seg"
        at_end = f"({at_end}) and x.hit is null"
    out = seq.sql(f"""
        with m as (select p.*, coalesce({at_end}, false) as at_end from {{p}} p join {{e}} e on e.song_id = p.song_id {not_exempt})
        select song_id, seg, beats, rooted, array({', '.join(exprs)}) as emission from m""", **tables)
    if prior is None:
        return out
    return seq.sql("""
        with b as (select song_id, seg, map_from_entries(collect_list(struct(key_idx, bonus))) as m
                   from {b} group by song_id, seg)
        select o.song_id, o.seg, o.beats, o.rooted, if(b.m is null, o.emission,
               transform(o.emission, (x, i) -> x + coalesce(try_element_at(b.m, i), 0D))) as emission
        from {o} o left join b on b.song_id = o.song_id and b.seg = o.seg""", o=out, b=prior)


# ------------------------------------------------------------------------------ chain helpers

def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _mix(x: np.ndarray, penalty: float) -> np.ndarray:
    """Log-sum over predecessors along the last axis: stay free, any other key -penalty."""
    m = x.max(axis=-1, keepdims=True)
    e = np.exp(x - m)
    p = np.exp(-penalty)
    return m + np.log((1 - p) * e + p * e.sum(axis=-1, keepdims=True))


def _best(x: np.ndarray, penalty: float) -> np.ndarray:
    return np.maximum(x, x.max(axis=-1, keepdims=True) - penalty)


def _first_max(x: np.ndarray) -> np.ndarray:
    """Lowest index among equal maxima (equal up to rounding noise, so block layout does not matter)."""
    return (x >= x.max(axis=1, keepdims=True) - TIE).argmax(axis=1)


def _best_path(E: np.ndarray, lengths: np.ndarray, penalty: float, enter_max: np.ndarray | None
               ) -> tuple[np.ndarray, np.ndarray]:
    """Final scores and back pointers; on ties staying in the key wins."""
    S, T, _ = E.shape
    score = E[:, 0].copy()
    same = np.arange(K, dtype=np.int16)[None, :]
    back = np.broadcast_to(same, (S, T, K)).copy()
    for t in range(0 if enter_max is not None else 1, T):
        src = enter_max if t == 0 else score
        top = _first_max(src)
        jump = np.take_along_axis(src, top[:, None], 1) - penalty
        stay = src >= jump - TIE
        back[:, t] = np.where(stay, same, top[:, None].astype(np.int16))
        score = np.where((t < lengths)[:, None], np.where(stay, src, jump) + E[:, t], score)
    return score, back


def _decode(E: np.ndarray, lengths: np.ndarray, penalty: float, enter: np.ndarray | None, leave: np.ndarray | None,
            enter_max: np.ndarray | None, end_state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Path and posteriors of padded songs E [S, T, K]; enter / leave / end_state carry the rest of a long song."""
    S, T, _ = E.shape
    score, back = _best_path(E, lengths, penalty, enter_max)
    alpha = np.zeros_like(E)
    for t in range(T):
        if t == 0 and enter is None:
            alpha[:, 0] = E[:, 0]
        else:
            alpha[:, t] = _mix(enter if t == 0 else alpha[:, t - 1], penalty) + E[:, t]
    beta = np.zeros_like(E)
    last = lengths - 1
    rows = np.arange(S)
    if leave is not None:
        beta[rows, last] = leave
    for t in range(T - 2, -1, -1):
        stepped = _mix(beta[:, t + 1] + E[:, t + 1], penalty)
        beta[:, t] = np.where((t < last)[:, None], stepped, beta[:, t])
    g = alpha + beta
    post = np.exp(g - _lse(g, 2)[:, :, None])
    path = np.zeros((S, T), dtype=np.int32)
    k = _first_max(score) if end_state is None else end_state
    for t in range(T - 1, -1, -1):
        inside = t <= last
        path[:, t] = np.where(inside, k, 0)
        k = np.where(inside, back[rows, t, k], k)
    return path, post


def _padded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    lengths = rows["n"].to_numpy()
    E = np.zeros((len(rows), int(lengths.max()), K))
    for i, flat in enumerate(rows["emission"]):
        E[i, :lengths[i]] = np.asarray(flat, dtype=float).reshape(-1, K)
    return E, lengths


def _vector(rows: pd.DataFrame, name: str) -> np.ndarray | None:
    return np.stack(rows[name].to_numpy()) if name in rows.columns else None


def _decoder(penalty: float, key_type: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            order = pdf["n"].argsort(kind="stable").to_numpy()
            for lo in range(0, len(order), 64):       # similar lengths together: little padding
                rows = pdf.iloc[order[lo:lo + 64]].reset_index(drop=True)
                E, lengths = _padded(rows)
                end = rows["end_state"].to_numpy() if "end_state" in rows.columns else None
                path, post = _decode(E, lengths, penalty, _vector(rows, "enter"), _vector(rows, "leave"),
                                     _vector(rows, "enter_max"), end)
                yield pd.DataFrame({
                    "song_id": rows["song_id"], "first_seg": rows["first_seg"],
                    "path": [path[i, :n].tolist() for i, n in enumerate(lengths)],
                    "post": [post[i, :n].ravel() for i, n in enumerate(lengths)]})

    return run, f"song_id {key_type}, first_seg int, path array<int>, post array<double>"


def _blocks(emission: DataFrame, size: int | None) -> DataFrame:
    """One row per (song, block): the block's emissions in segment order, flattened."""
    blk, by = ("0", "song_id") if size is None else (f"cast(seg div {size} as int)", "song_id, blk")
    return seq.sql(f"""
        select song_id, first(blk) as blk, min(seg) as first_seg, cast(count(*) as int) as n,
               flatten(transform(sort_array(collect_list(struct(seg, emission))), x -> x.emission)) as emission
        from (select *, {blk} as blk from {{e}}) group by {by}""", e=emission)


def decode_keys(emission: DataFrame, params: dict, size: int | None = None) -> DataFrame:
    """Best key path and posterior of every key: ``(song_id, seg, path_idx, post ARRAY<DOUBLE>)``."""
    penalty = params["key"]["switch_penalty"]
    blocks = _blocks(emission, size)
    key_type = emission.schema["song_id"].dataType.simpleString()
    if size is None:
        run, schema = _decoder(penalty, key_type)
        out = blocks.select("song_id", "first_seg", "n", "emission").mapInPandas(run, schema)
    else:
        out = _decode_long(blocks, penalty, key_type)
    return out.selectExpr("song_id", "first_seg", "post", "posexplode(path) as (i, path_idx)").selectExpr(
        "song_id", "cast(first_seg + i as int) as seg", "path_idx", f"slice(post, i * {K} + 1, {K}) as post")


# ------------------------------------------------------------------------------ long songs

def _transfer(penalty: float, key_type: str):
    """Block -> transfer matrices (max and log-sum): entry state before the block to state at its end."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                E = np.asarray(row.emission, dtype=float).reshape(-1, K)
                start = np.full((K, K), -1e30)
                np.fill_diagonal(start, 0.0)
                hi, lo = start.copy(), start.copy()
                for t in range(len(E)):
                    if t == 0 and row.blk == 0:
                        hi = lo = np.tile(E[0], (K, 1))
                        continue
                    hi = _best(hi, penalty) + E[t]
                    lo = _mix(lo, penalty) + E[t]
                out.append((row.song_id, row.blk, hi.ravel(), lo.ravel()))
            yield pd.DataFrame(out, columns=["song_id", "blk", "hi", "lo"])

    return run, f"song_id {key_type}, blk int, hi array<double>, lo array<double>"


def _chain(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    x = a[:, :, None] + b[None, :, :]
    return x.max(axis=1) if best else _lse(x, 1)


def _combine(key_type: str):
    """Product of a group of consecutive matrices."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        hi = lo = None
        for h, w in zip(pdf["hi"], pdf["lo"]):
            h, w = np.reshape(h, (K, K)), np.reshape(w, (K, K))
            hi = h if hi is None else _chain(hi, h, True)
            lo = w if lo is None else _chain(lo, w, False)
        return pd.DataFrame([(pdf["song_id"].iloc[0], int(pdf["grp"].iloc[0]), hi.ravel(), lo.ravel())],
                            columns=["song_id", "blk", "hi", "lo"])

    return run, f"song_id {key_type}, blk int, hi array<double>, lo array<double>"


_VECTORS = ["enter_max", "enter", "leave"]


def _spread(key_type: str):
    """Within one group: vectors at the group's edges -> vectors at every member's edges."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk").reset_index(drop=True)
        n = len(pdf)
        hi = [np.reshape(x, (K, K)) for x in pdf["hi"]]
        lo = [np.reshape(x, (K, K)) for x in pdf["lo"]]
        v, w = np.asarray(pdf["enter_max"].iloc[0]), np.asarray(pdf["enter"].iloc[0])
        ins = []
        for i in range(n):
            ins.append((v, w))
            v, w = (v[:, None] + hi[i]).max(axis=0), _lse(w[:, None] + lo[i], 0)
        w = np.asarray(pdf["leave"].iloc[0])
        outs = [w] * n
        for i in range(n - 1, -1, -1):
            outs[i] = w
            w = _lse(lo[i] + w[None, :], 1)
        return pd.DataFrame({"song_id": pdf["song_id"], "blk": pdf["blk"], "enter_max": [a for a, _ in ins],
                             "enter": [b for _, b in ins], "leave": outs})

    return run, f"song_id {key_type}, blk int, " + ", ".join(f"{v} array<double>" for v in _VECTORS)


def _edge_vectors(mats: DataFrame, key_type: str) -> DataFrame:
    """(song_id, blk) -> vectors entering and leaving the block, by a tree of bounded groups."""
    if mats.where("blk > 0").isEmpty():
        return mats.selectExpr("song_id", "blk", *[f"array_repeat(0D, {K}) as {v}" for v in _VECTORS])
    grouped = mats.selectExpr("*", f"cast(blk div {GROUP} as int) as grp")
    run, schema = _combine(key_type)
    tops = seq.stage(grouped.groupBy("song_id", "grp").applyInPandas(run, schema))
    above = _edge_vectors(tops, key_type)
    run, schema = _spread(key_type)
    joined = grouped.join(above.withColumnRenamed("blk", "grp"), ["song_id", "grp"])
    return seq.stage(joined.groupBy("song_id", "grp").applyInPandas(run, schema))


def _trace_maps(penalty: float, key_type: str):
    """Block -> map from the key at its end to the key at the end of the block before, and its best final key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                E = np.asarray(row.emission, dtype=float).reshape(1, -1, K)
                enter = np.asarray(row.enter_max)[None, :] if row.blk > 0 else None
                score, back = _best_path(E, np.array([E.shape[1]]), penalty, enter)
                m = np.arange(K)
                for t in range(E.shape[1] - 1, -1, -1):
                    m = back[0, t, m]
                out.append((row.song_id, row.blk, m.tolist(), int(_first_max(score)[0])))
            yield pd.DataFrame(out, columns=["song_id", "blk", "m", "final"])

    return run, f"song_id {key_type}, blk int, m array<int>, final int"


def _end_states(maps: DataFrame, key_type: str) -> DataFrame:
    """(song_id, blk) -> key at the end of the block, following the maps back from the song's end."""
    grouped = maps.selectExpr("*", f"cast(blk div {GROUP} as int) as grp")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ascending=False)
        m = np.arange(K)
        for one in pdf["m"]:
            m = np.asarray(one)[m]
        return pd.DataFrame([(pdf["song_id"].iloc[0], int(pdf["grp"].iloc[0]), m.tolist(), int(pdf["final"].iloc[0]))],
                            columns=["song_id", "blk", "m", "final"])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ascending=False).reset_index(drop=True)
        k, ends = int(pdf["end_state"].iloc[0]), []
        for one in pdf["m"]:
            ends.append(k)
            k = int(one[k])
        return pd.DataFrame({"song_id": pdf["song_id"], "blk": pdf["blk"], "end_state": ends})

    if maps.where("blk > 0").isEmpty():
        return maps.selectExpr("song_id", "blk", "final as end_state")
    tops = seq.stage(grouped.groupBy("song_id", "grp").applyInPandas(
        combine, f"song_id {key_type}, blk int, m array<int>, final int"))
    above = _end_states(tops, key_type).withColumnRenamed("blk", "grp")
    return seq.stage(grouped.join(above, ["song_id", "grp"]).groupBy("song_id", "grp").applyInPandas(
        spread, f"song_id {key_type}, blk int, end_state int"))


def _decode_long(blocks: DataFrame, penalty: float, key_type: str) -> DataFrame:
    blocks = seq.stage(blocks)
    run, schema = _transfer(penalty, key_type)
    mats = seq.stage(blocks.select("song_id", "blk", "emission").mapInPandas(run, schema))
    full = blocks.join(_edge_vectors(mats, key_type), ["song_id", "blk"])
    run, schema = _trace_maps(penalty, key_type)
    maps = seq.stage(full.select("song_id", "blk", "emission", "enter_max").mapInPandas(run, schema))
    full = full.join(_end_states(maps, key_type), ["song_id", "blk"])
    run, schema = _decoder(penalty, key_type)
    cols = ["song_id", "first_seg", "n", "emission", "leave", "end_state"]
    inner = full.where("blk > 0").select(*cols, "enter_max", "enter").mapInPandas(run, schema)
    return full.where("blk = 0").select(*cols).mapInPandas(run, schema).unionByName(inner)


# ------------------------------------------------------------------------------ regions

def path_regions(emission: DataFrame, path: DataFrame, size: int | None = None) -> DataFrame:
    """Segments with key path and region number."""
    j = path.join(emission, ["song_id", "seg"])
    if size is not None:
        j = seq.stage(j)
    return seq.islands(j, "seg", "p.path_idx = path_idx", "struct(path_idx)", "region", size)


def merge_short_regions(regions: DataFrame, params: dict) -> DataFrame:
    """Regions shorter than min_region_beats take over the better neighbouring key, shortest first.

    Input ``(song_id, region, key_idx, beats, esum ARRAY<DOUBLE>)``, output adds ``merged_idx``.
    A long region never changes, so stretches of short regions between two long ones are
    independent: each stretch (with its two borders) is one group.
    """
    least = params["key"]["min_region_beats"]
    key_type = regions.schema["song_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("region").reset_index(drop=True)
        es = np.stack(pdf["esum"].to_numpy())
        parts = [[[i], float(b), int(k)] for i, (b, k) in enumerate(zip(pdf["beats"], pdf["key_idx"]))]
        while len(parts) > 1:
            short = [(p[1], i) for i, p in enumerate(parts) if p[1] < least]
            if not short:
                break
            i = min(short)[1]
            gain = es[parts[i][0]].sum(axis=0)
            sides = [parts[j][2] for j in (i - 1, i + 1) if 0 <= j < len(parts)]
            parts[i][2] = max(sides, key=lambda k: gain[k])
            joined = []
            for p in parts:
                if joined and joined[-1][2] == p[2]:
                    joined[-1] = [joined[-1][0] + p[0], joined[-1][1] + p[1], p[2]]
                else:
                    joined.append(p)
            parts = joined
        merged = np.zeros(len(pdf), dtype=int)
        for members, _, k in parts:
            merged[members] = k
        inner = pdf["inner"].to_numpy(dtype=bool)
        return pd.DataFrame({"song_id": pdf["song_id"], "region": pdf["region"], "merged_idx": merged})[inner]

    # stretch number of a short region = number of long regions before it; borders join both stretches
    marked = seq.sql(f"""
        select *, sum(if(beats >= {least}D, 1, 0)) over (partition by song_id order by region
                    rows between unbounded preceding and current row) as longs from {{r}}""", r=regions)
    grouped = seq.sql(f"""
        with s as (select distinct song_id, longs from {{m}} where beats < {least}D)
        select m.song_id, s.longs as stretch, m.region, m.key_idx, m.beats, m.esum, m.beats < {least}D as inner
        from {{m}} m join s on s.song_id = m.song_id
             and (m.longs = s.longs or (m.beats >= {least}D and m.longs = s.longs + 1))""", m=marked)
    fixed = grouped.groupBy("song_id", "stretch").applyInPandas(
        run, f"song_id {key_type}, region int, merged_idx int")
    return seq.sql("""select r.*, coalesce(f.merged_idx, r.key_idx) as merged_idx
                      from {r} r left join {f} f on f.song_id = r.song_id and f.region = r.region""", r=regions, f=fixed)


def segment_keys(segments: DataFrame, params: dict, size: int | None = None, exempt: DataFrame | None = None,
                 prior: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """Final key per segment: ``(song_id, seg, key_idx, key_prob, post, given)``.

    ``given(song_id, key_idx)`` fixes the key of its songs with probability 1.
    """
    if given is not None:
        # songs with a told key need no emissions and no decoding
        told = given.where("key_idx is not null")
        rest = seq.stage(segments.join(told, "song_id", "left_anti"), size)
        return segment_keys(rest, params, size, exempt, prior).unionByName(given_segment_keys(segments, told))
    e = seq.stage(emissions(segments, params, size, exempt, prior), size)
    path = seq.stage(decode_keys(e, params, size), size)
    marked = path_regions(e.select("song_id", "seg", "beats", "emission"), path, size)
    if size is not None:  # whole songs lie together in both tables, so the second reader repeats a join rather than reads a copy
        marked = seq.stage(marked)
    esum = ", ".join(f"sum(emission[{k}])" for k in range(K))
    regions = seq.sql(f"""
        select song_id, region, first(path_idx) as key_idx, sum(beats) as beats, array({esum}) as esum
        from {{m}} group by song_id, region""", m=marked)
    merged = merge_short_regions(regions, params)
    return seq.sql("""
        select m.song_id, m.seg, r.merged_idx as key_idx, m.post[r.merged_idx] as key_prob, m.post, false as given
        from {m} m join {r} r on r.song_id = m.song_id and r.region = m.region""",
                  m=marked, r=merged.select("song_id", "region", "merged_idx"))


def given_segment_keys(segments: DataFrame, given: DataFrame) -> DataFrame:
    """Keys of songs whose key is told: posterior 1 on that key."""
    return seq.sql(f"""
        select s.song_id, s.seg, g.key_idx, 1D as key_prob,
               transform(sequence(0, {K - 1}), i -> if(i = g.key_idx, 1D, 0D)) as post, true as given
        from {{s}} s join {{g}} g on g.song_id = s.song_id""", s=segments, g=given)


def key_regions(segments: DataFrame, keys: DataFrame, size: int | None = None) -> DataFrame:
    """Maximal stretches of one key: span, segment range and mean key probability."""
    j = seq.sql("""select s.song_id, s.seg, s.start, s.end, s.beats, k.key_idx, k.key_prob
                   from {s} s join {k} k on k.song_id = s.song_id and k.seg = s.seg""", s=segments, k=keys)
    if size is not None:
        j = seq.stage(j)
    r = seq.islands(j, "seg", "p.key_idx = key_idx", "struct(key_idx)", "region", size)
    return seq.sql("""select song_id, region, first(key_idx) as key_idx, min(seg) as seg_first, max(seg) + 1 as seg_until,
                             min_by(start, seg) as start, max_by(end, seg) as end, sum(beats) as beats,
                             avg(key_prob) as prob
                      from {r} group by song_id, region""", r=r)


def global_keys(segments: DataFrame, keys: DataFrame, params: dict, top: int = 4) -> DataFrame:
    """Keys ranked by posterior-weighted beats per song, with the ambiguity flag (rank 0 = home key)."""
    ratio = params["key"]["ambiguity_ratio"]
    mass = ", ".join(f"sum(post[{i}] * beats)" for i in range(K))
    return seq.sql(f"""
        with j as (select s.song_id, s.beats, k.post, k.given, sort_array(k.post, false) as hi
                   from {{s}} s join {{k}} k on k.song_id = s.song_id and k.seg = s.seg where s.top.root is not null),
             a as (select song_id, array({mass}) as mass, sum(beats) as beats, first(given) as given,
                          sum(if(hi[1] >= {ratio}D * hi[0], beats, 0D)) as unclear from j group by song_id),
             b as (select song_id, given, not given and unclear / beats > 0.5 as ambiguous,
                          slice(sort_array(transform(mass, (m, i) -> struct(-m / beats as neg, i as key_idx))), 1, {top}) as ranked
                   from a)
        select song_id, ambiguous, if(given, 'given', 'estimated') as source, pos as rank, x.key_idx, -x.neg as prob
        from (select *, posexplode(ranked) as (pos, x) from b)""", s=segments, k=keys)
