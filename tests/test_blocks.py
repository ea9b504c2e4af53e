"""Steps along a song give the same in blocks of any size as one plain pass over it."""

import random
import re

import numpy as np
import pytest

from cadenza import params as P
from cadenza.operators import meter, structure as st
from cadenza.operators import sequence as seq

PARAMS = P.with_overrides()


@pytest.mark.parametrize("size", [2, 5, 4096])
def test_orbit(spark, size):
    r = random.Random(size)
    songs = {k: [None if i + 1 >= n or r.random() < 0.02 else min(n - 1, i + r.randint(1, 4)) for i in range(n)] for k, n in enumerate([1, 2, 30, 200])}
    nodes = seq.stage(spark.createDataFrame([(k, 10 * i, None if s is None else 10 * s) for k, x in songs.items() for i, s in enumerate(x)], "song_id int, idx long, succ long"))
    got = sorted((x.song_id, x.idx) for x in seq.orbit(nodes, size).collect())
    want = []
    for k, succ in songs.items():
        i = 0
        while i is not None:
            want.append((k, 10 * i))
            i = succ[i]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [3, 4096])
def test_orbit_hands_python_many_songs_at_a_time(spark, size):
    """One call per batch of blocks, not one per song: 3000 short songs were 3000 calls in one task."""
    nodes = seq.stage(spark.range(3000 * 7).selectExpr("id div 7 as song_id", "id % 7 as idx", "if(id % 7 + 2 < 7, id % 7 + 2, null) as succ"))
    reached = seq.orbit(nodes, size)
    assert "FlatMapGroups" not in reached._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.song_id, x.idx) for x in reached.collect()) == [(s, i) for s in range(3000) for i in (0, 2, 4, 6)]


def plain_bars(downs, p, d, duration):
    """Bar lines and irregular bars by one fold over the downbeats."""
    def whole(gap):
        return np.rint(gap / d) >= 1 and abs(gap - np.rint(gap / d) * d) < 0.5 * p

    bars, odd = [downs[0]], []
    for at, nxt in zip(downs[1:], [*downs[2:], None]):
        gap = at - bars[-1]
        if np.rint(gap / p) < 2 or not whole(gap) and nxt is not None and whole(nxt - bars[-1]):
            continue
        if not whole(gap):
            odd.append((len(bars), int(np.rint(gap / p))))
            bars.append(at)
            continue
        k, last = int(np.rint(gap / d)), bars[-1]
        bars += [*(last + gap * j / k for j in range(1, k)), at]
    more = int(np.ceil((duration - 0.5 * p - bars[-1]) / d) - 1)
    return bars + [bars[-1] + j * d for j in range(1, more + 1)], odd


@pytest.mark.parametrize("size,ahead", [(4096, 6), (3, 1), (2, 2)])
def test_bar_repair(spark, monkeypatch, size, ahead):
    monkeypatch.setattr(meter, "AHEAD", ahead)
    r = random.Random(7)
    songs = {}
    for k, n in enumerate([1, 3, 20, 90]):
        at, downs = 1.0, []
        for _ in range(n):
            downs.append(at)
            downs += [at + r.uniform(0.1, 1.9) for _ in range(r.choice([0, 0, 0, 1, 3]))]
            at += r.choice([2.0, 2.0, 2.0, 2.02, 4.0, 6.01, 1.5, 2.6])
        songs[k] = sorted(downs), at + 5
    tempos = spark.createDataFrame([(k, 0.5, 2.0, 4, True) for k in songs] + [(9, 0.5, 2.0, 4, False)], "song_id int, beat_period double, bar_period double, beats_per_bar int, has_downbeats boolean")
    beats = spark.createDataFrame([(9, 0.7), (9, 1.2)], "song_id int, at double")
    downs = spark.createDataFrame([(k, x) for k, (xs, _) in songs.items() for x in xs] + [(9, 99.0)], "song_id int, at double")
    ends = spark.createDataFrame([(k, e) for k, (_, e) in songs.items()] + [(9, 4.0)], "song_id int, duration double")
    got = {x.song_id: x for x in meter.repair_bars(tempos, beats, downs, ends, size).collect()}
    for k, (xs, end) in (songs | {9: ([0.7], 4.0)}).items():
        bars, odd = plain_bars(xs, 0.5, 2.0, end)
        assert got[k].bars == pytest.approx(bars, abs=1e-9) and [(x.bar, x.beats) for x in got[k].irregular] == odd


def plain_cuts(nov):
    s = PARAMS["structure"]
    n = len(nov)
    best, back = [0.0], [0]
    for j in range(1, n + 1):
        scores = []
        for i in range(j):
            length = s["length_prior"].get(j - i, s["prior_multiple_of_4"] if (j - i) % 4 == 0 else s["prior_other"])
            free = j - i >= s["min_bars"] or i == 0 or j == n
            scores.append(best[i] + length + (s["novelty_weight"] * nov[j] if j < n else 0.0) - s["boundary_cost"] if free else -1e300)
        back.append(int(np.argmax(scores)))
        best.append(max(scores))
    cuts = [n]
    while cuts[0]:
        cuts.insert(0, back[cuts[0]])
    return cuts


@pytest.mark.parametrize("size", [4096, 7, 1])
def test_section_cuts(spark, size):
    rng = np.random.default_rng(2)
    songs = {k: np.round(np.maximum(rng.normal(0.1, 0.4, n), 0), 3) for k, n in enumerate([1, 3, 9, 40, 120])}
    nov = spark.createDataFrame([(k, i, float(x)) for k, v in songs.items() for i, x in enumerate(v)], "song_id int, bar_no int, novelty double")
    got = {}
    for x in sorted(st.segment_bars(nov, PARAMS, size).collect(), key=lambda x: x.sec):
        got.setdefault(x.song_id, [0]).append(x.end_bar)
        assert x.start_bar == got[x.song_id][-2] and x.n == len(songs[x.song_id])
    assert got == {k: plain_cuts(v) for k, v in songs.items()}


def bar_rows(spark):
    rng = np.random.default_rng(4)
    songs = {k: (rng.random((n, 24)) * (rng.random((n, 24)) < 0.3), np.round(rng.normal(0, 1, (n, 3)), 1)) for k, n in enumerate([1, 2, 5, 23, 40])}
    songs[9] = (np.zeros((4, 24)), np.ones((4, 3)))
    for v, _ in songs.values():
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    rows = [(k, i, a.tolist(), b.tolist()) for k, (v, t) in songs.items() for i, (a, b) in enumerate(zip(v, t))]
    return songs, spark.createDataFrame(rows, "song_id int, bar_no int, v array<double>, timbre array<double>")


def plain_sigma(t):
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(axis=2))
    return float(np.median(d[d > 0])) if (d > 0).any() else 1.0


@pytest.mark.parametrize("tile", [512, 8, 3])
def test_timbre_scale(spark, tile):
    songs, wins = bar_rows(spark)
    assert {x.song_id: x.sigma for x in st.timbre_scale(wins, tile).collect()} == {k: plain_sigma(t) for k, (_, t) in songs.items()}


@pytest.mark.parametrize("size", [None, 2, 3])
def test_segment_masses_add_up_in_frame_order(spark, size):
    from cadenza.operators import segments as sg
    r = random.Random(1)
    probs = [[round(r.uniform(0.5, 0.7), 3) for _ in range(n)] for n in range(1, 41)]
    rows = [(k, i, float(i), 1.0, "beat", [("C:maj", p), ("A:min", round(0.9 - p, 3))]) for k, x in enumerate(probs) for i, p in enumerate(x)]
    r.shuffle(rows)
    frames = spark.createDataFrame(rows, "song_id int, frame_idx int, time double, duration double, time_unit string, candidates array<struct<label:string,prob:double>>")
    got = {s.song_id: s.p for s in sg.build_segments(frames.repartition(7), PARAMS, size).selectExpr("song_id", "top.prob as p").collect()}
    for k, x in enumerate(probs):
        total = 0.0
        for p in x:
            total += p
        assert got[k] == total / len(x)
    # nothing sorts the frames of a chord again on their way into the sums, as a sort that spills leaves equal keys in any order
    plan = sg.build_segments(frames, PARAMS, size)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_sum\(\(_extract_prob[^\n]*\n[ :+-]*Sort \[song_id[^\n]*harte[^\n]*frame_idx[^\n]*pos", plan), plan


def test_written_tables_are_broadcast_by_measured_size_only(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    big = seq.stage(spark.range(1_000_000).selectExpr("id % 8 as song_id", "cast(id % 1000 as int) as seg", "'text' as a", "'text' as b"))
    few = seq.stage(spark.range(1000).selectExpr("id % 8 as song_id", "cast(id as int) as seg"))
    pairs = few.join(big.select("song_id", "seg"), ["song_id", "seg"])
    assert "BroadcastExchange" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
    assert pairs.count() == 1_000_000 // 1000 * 1000 * 8 // 8
    small = few.join(few.selectExpr("song_id", "seg as other"), ["song_id"])
    small.write.format("noop").mode("overwrite").save()
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") != "-1"


@pytest.mark.parametrize("size,batch", [(2, 3), (5, 10_000), (1024, 4), (1024, 10_000)])
@pytest.mark.parametrize("offsets,shifts", [(range(1, 3), range(12)), (range(-4, 5), range(1))])
def test_repetition_band(spark, size, batch, offsets, shifts):
    rng = np.random.default_rng(size)
    songs = {f"s{k}": rng.random((n, 24)) - 0.2 for k, n in enumerate([1, 2, 3, 9, 14])}
    wins = spark.createDataFrame([(k, i, x.tolist()) for k, v in songs.items() for i, x in enumerate(v)], "song_id string, bar_no int, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = st.repetition(wins, offsets, shifts, size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(x.song_id, x.shift, x.i, x.j): x.sim for x in found}
    assert len(got) == len(found)
    want = {}
    for k, v in songs.items():
        for r in shifts:
            turned = np.concatenate([np.roll(v[:, :12], r, axis=1), np.roll(v[:, 12:], r, axis=1)], axis=1)
            want |= {(k, r, i, i + o): min(max(float(v[i] @ turned[i + o]), 0.0), 1.0) for i in range(len(v)) for o in offsets if 0 <= i + o < len(v)}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_partitions_follow_the_rows(spark):
    """A shuffle of many small rows is not merged down to one partition per core; small inputs leave the session as it is."""
    first, advised = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    session = spark.newSession()
    seq.deal_by_rows(session, 1000)
    assert session.conf.get(first, None) is None and session.conf.get(advised) == spark.conf.get(advised)
    rows = 100 * seq.TASK_ROWS
    seq.deal_by_rows(session, rows)
    assert int(session.conf.get(first)) == 100
    songs = session.range(rows).selectExpr("id div 64 as song_id", "xxhash64(id) as a", "xxhash64(-id) as b").repartition("song_id")
    sizes = [r.n for r in songs.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) > 8 and max(sizes) < rows / 8
    seq.deal_by_rows(session, 10 * rows)
    seq.deal_by_rows(session, 5 * rows)
    assert int(session.conf.get(first)) == 1000  # a smaller table in the same session leaves what a larger one asked for


@pytest.mark.parametrize("size", [4, 9, 64])
def test_section_pairs(spark, size):
    """Blocks of sections of any size give the plain comparison of two sections, equal bars included."""
    r = np.random.default_rng(3)
    bars = r.integers(0, 2, (26, 24)).astype(float)
    bars[10:14] = np.roll(bars[0:4].reshape(4, 2, 12), 5, axis=2).reshape(4, 24)
    bars /= np.maximum(np.linalg.norm(bars, axis=1, keepdims=True), 1e-9)
    cuts = [0, 4, 10, 14, 15, 22, 26]
    wins = seq.stage(spark.createDataFrame([("a", k, x.tolist()) for k, x in enumerate(bars)], "song_id string, bar_no int, v array<double>"))
    sections = seq.stage(spark.createDataFrame([("a", k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "song_id string, sec int, start_bar int, end_bar int"))
    got = {(x.i, x.j): (x.sim, x.shift, x.off) for x in st.section_pairs(sections, wins, PARAMS, size).collect()}
    s, want = PARAMS["structure"], {}
    for i, (a0, a1) in enumerate(zip(cuts, cuts[1:])):
        for j, (b0, b1) in enumerate(zip(cuts, cuts[1:])):
            best = (0.0, 0, 0)
            for off in range(-s["slack_bars"], s["slack_bars"] + 1):
                ks = [k for k in range(a1 - a0) if 0 <= k + off < b1 - b0]
                if len(ks) >= max(2, min(a1 - a0, b1 - b0) // 2):
                    for t in range(12):
                        turned = np.roll(bars.reshape(26, 2, 12), t, axis=2).reshape(26, 24)
                        v = (np.mean([min(bars[a0 + k] @ turned[b0 + k + off], 1) for k in ks]) - s["shift_penalty"] * (t > 0)) * (len(ks) / max(a1 - a0, b1 - b0)) ** 0.25
                        if v > best[0] + 1e-8:
                            best = (v, t, off)
            want[i, j] = best
    assert got.keys() == {k for k in want if k[0] != k[1]}
    for k, (sim, shift, off) in got.items():
        assert abs(sim - want[k][0]) < 1e-7 and (shift, off) == want[k][1:]


def test_whole_songs_are_joined_without_shuffles(spark):
    """Staged tables of whole songs are dealt by song once; what joins, groups or windows them by song does not deal them again."""
    a = seq.stage(spark.range(600).selectExpr("cast(id % 30 as string) as song_id", "cast(id div 30 as int) as seg", "id as x"), None)
    b = seq.stage(spark.range(600).selectExpr("cast(id % 30 as string) as song_id", "cast(id div 30 as int) as seg", "id * 2 as y"), None)
    joined = seq.sql("""select song_id, sum(z) as z from (
                          select a.song_id, a.x + lead(b.y, 1, 0L) over (partition by a.song_id order by a.seg) as z
                          from {a} a left join {b} b on b.song_id = a.song_id and b.seg = a.seg - 1) group by song_id""", a=a, b=b)
    before = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.song_id: r.z for r in joined.collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "Join" in plan
    assert got == {str(s): sum(s + 30 * k for k in range(20)) + sum(2 * (s + 30 * k) for k in range(19)) for s in range(30)}
