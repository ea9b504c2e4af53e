"""Matching, alignment and scores on literal spans, and the identity: a reference scores itself perfectly."""

import pytest

from cadenza import params as P
from cadenza.operators import evaluate as ev
from cadenza.plans import analysis as an
from cadenza.sources import documents as docs
from tests.test_sources import make_eval_set

GOLD = "song_id string, gold_id int, type string, start double, end double, label string"
PRED = "song_id string, pred_id int, type string, start double, end double, label string, confidence double"
PARAMS = P.with_overrides()


def match(spark, gold, pred):
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)
    return g, p, ev.match_events(g, p, PARAMS)


def test_type_overlap_and_points(spark):
    g, p, m = match(spark, [("s", 0, "ii_V_I", 4.0, 10.0, None), ("s", 1, "borrowed_chord", 16.0, 18.0, None), ("m", 0, "modulation", 60.0, 60.0, None),
                            ("n", 0, "modulation", 60.0, 60.0, None)],
                    [("s", 0, "ii_V_I", 6.0, 10.0, None, .9), ("s", 1, "secondary_dominant", 16.0, 18.0, None, 1.0),
                     ("s", 2, "borrowed_chord", 17.5, 20.0, None, 1.0), ("m", 0, "modulation", 61.5, 61.5, None, 1.0), ("n", 0, "modulation", 63.0, 63.0, None, 1.0)])
    assert {(r.song_id, r.gold_id, r.pred_id) for r in m.collect()} == {("s", 0, 0), ("m", 0, 0)}
    assert {(r.song_id, r.gold_id) for r in ev.missed_gold(g, m).collect()} == {("s", 1), ("n", 0)}
    assert {(r.song_id, r.pred_id) for r in ev.false_positives(p, m).collect()} == {("s", 1), ("s", 2), ("n", 0)}
    s = {(r.song_id, r.type): r for r in ev.event_scores(g, p, m).collect()}
    assert abs(s["s", None].precision - 1 / 3) < 1e-9 and abs(s["s", None].recall - .5) < 1e-9
    total = [r for r in ev.corpus_event_scores(ev.event_scores(g, p, m)).collect() if r.type is None][0]
    assert (total.tp, total.n_gold, total.n_pred) == (2, 4, 5)


def test_greedy_is_one_to_one(spark):
    """Brute force of the greedy rule on a crowded type."""
    import random
    rnd = random.Random(3)
    gold = [("s", i, "x", a, a + rnd.choice([2.0, 4.0]), None) for i, a in enumerate(sorted(rnd.uniform(0, 60) for _ in range(25)))]
    pred = [("s", i, "x", a, a + rnd.choice([2.0, 4.0]), None, round(rnd.random(), 2)) for i, a in enumerate(rnd.uniform(0, 60) for _ in range(30))]
    want, used = set(), set()
    for p in sorted(pred, key=lambda p: -p[6]):
        best, q = None, -1.0
        for g in gold:
            ratio = (min(g[4], p[4]) - max(g[3], p[3])) / min(g[4] - g[3], p[4] - p[3])
            if g[1] not in used and ratio >= 0.5 and ratio > q:
                best, q = g[1], ratio
        if best is not None:
            used.add(best)
            want.add((best, p[1]))
    assert {(r.gold_id, r.pred_id) for r in match(spark, gold, pred)[2].collect()} == want


def test_attribution(spark):
    g = [("s", 0, "ii_V_I", 0.0, 6.0, None), ("s", 1, "ii_V_I", 10.0, 16.0, None), ("s", 2, "borrowed_chord", 20.0, 22.0, None)]
    o = [("s", 0, "ii_V_I", 0.0, 6.0, None, 1.0), ("s", 1, "ii_V_I", 10.0, 16.0, None, 1.0), ("s", 2, "tritone_sub", 30.0, 32.0, None, 1.0)]
    y = [("s", 0, "ii_V_I", 0.0, 6.0, None, 1.0), ("s", 1, "tritone_sub", 30.0, 32.0, None, 1.0), ("s", 2, "secondary_dominant", 40.0, 42.0, None, 1.0)]
    gd, od, om = match(spark, g, o)
    _, sd, sm = match(spark, g, y)
    rows = ev.attribute_errors(gd, om, sm, ev.false_positives(od, om), ev.false_positives(sd, sm), PARAMS).collect()
    assert sorted(r.category for r in rows) == ["analysis_fp", "analysis_miss", "ok", "recognition_fp", "recognition_miss"]


def seqs(spark, texts):
    from cadenza.functions import labels as lb
    rows = [(k, i, c) for k, t in texts.items() for i, c in enumerate(t.split())]
    return lb.parse_labels(spark.createDataFrame(rows, "song_id string, idx int, label string")).select("song_id", "idx", "harte", "root", "quality")


def test_alignment(spark):
    r, e = seqs(spark, {"a": "C F G C", "b": "C F"}), seqs(spark, {"a": "C F F7 G Am C", "b": "Am C F"})
    got = {x.song_id: x for x in ev.align_sequences(r, e).collect()}
    assert got["a"].ref_of_est == [0, 1, 1, 2, 2, 3] and abs(got["a"].cost - 2.0) < 1e-9
    assert got["b"].ref_of_est == [0, 0, 1] and abs(got["b"].cost - 1.0) < 1e-9
    levels = {lv: {x.song_id: x.cost for x in ev.align_sequences(seqs(spark, {"a": "C7 Dm"}), seqs(spark, {"a": "C Dm7"}), lv).collect()}["a"]
              for lv in ("root", "majmin", "sevenths")}
    assert levels == {"root": 0.0, "majmin": 0.0, "sevenths": 2.0}


def test_nearest_matches_brute_force(spark):
    import random
    rnd = random.Random(1)
    grid = sorted(rnd.choice(range(40)) / 2 for _ in range(25))
    pts = [rnd.choice(range(80)) / 4 for _ in range(40)]
    g = spark.createDataFrame([("s", x, i) for i, x in enumerate(grid)], "song_id string, at double, grid_idx int")
    p = spark.createDataFrame([("s", x, i) for i, x in enumerate(pts)], "song_id string, at double, n int")
    want = {i: min(range(25), key=lambda j: abs(grid[j] - x)) for i, x in enumerate(pts)}
    assert {r.n: r.grid_idx for r in ev.nearest(p, g).collect()} == want


def test_key_scores(spark):
    from tests.songs import FRAME_SCHEMA, plain
    a = an.analyze(spark.createDataFrame(plain("s", "C G C G C G C G"), FRAME_SCHEMA))
    spans = spark.createDataFrame([("s", 0.0, 16.0, 0), ("s", 16.0, 32.0, 21)], "song_id string, start double, end double, key_idx int")
    k = ev.local_key_scores(a.keyed, spans).collect()[0]
    assert abs(k.exact - .5) < 1e-9 and abs(k.tonic - .5) < 1e-9 and abs(k.weighted - .65) < 1e-9
    assert ev.home_key(spans).collect()[0].key_idx == 0


def test_reference_scores_itself_perfectly(spark, tmp_path):
    e = docs.evaluation_set(spark, str(make_eval_set(tmp_path)), "dev")
    a = an.analyze(e["frames"])
    pred = a.events.selectExpr("song_id", "event_no as pred_id", "type", "start", "end", "label", "conf as confidence")
    m = ev.match_events(e["gold"], pred, PARAMS)
    scores = {(r.song_id, r.type): r for r in ev.event_scores(e["gold"], pred, m).collect()}
    assert scores["toy_lab", None].recall == scores["toy_chart", None].recall == 1.0
    assert scores["toy_lab", None].label_accuracy == 1.0
    top = ev.top_intervals(e["frames"])
    for r in ev.chord_scores(top, top).collect():
        assert r.majmin == r.root == r.tetrads == 1.0
    assert all(r.strict == r.degree == 1.0 for r in ev.numeral_agreement(a.keyed, a.keyed).collect())
    assert [round(r.weighted, 6) for r in ev.local_key_scores(a.keyed, e["keys"]).collect()] == [1.0]


def test_best_parameters(spark):
    cols = "param_id int, is_default boolean, objective double, local_key double"
    rows = [(0, True, .5, .9), (1, False, .8, .85), (2, False, .6, .895)]
    assert ev.best_parameters(spark.createDataFrame(rows, cols)).collect()[0].param_id == 2
    assert ev.best_parameters(spark.createDataFrame(rows[:2], cols)).collect()[0].param_id == 0


@pytest.mark.parametrize("width", [1.0, 64.0])
def test_overlap_join_buckets(spark, width):
    a = spark.createDataFrame([("s", 0.0, 10.0, 1), ("s", 10.0, 30.0, 2)], "song_id string, start double, end double, n int")
    b = spark.createDataFrame([("s", 5.0, 12.0, 7), ("s", 29.5, 31.0, 8), ("t", 0.0, 9.0, 9)], "song_id string, start double, end double, n int")
    assert {(r.a.n, r.b.n, r.w) for r in ev.overlap_join(a, b, width).collect()} == {(1, 7, 5.0), (2, 7, 2.0), (2, 8, .5)}


def test_expert_scores_keep_every_song(spark):
    """A song whose chord is none keeps its row; a flat seventh over a degree is no applied dominant; equal spans count twice."""
    top = "struct<root:int>"
    keyed = spark.createDataFrame([("a", 0, 0.0, 4.0, (7,), 0), ("b", 0, 0.0, 4.0, (None,), 0)],
                                  f"song_id string, seg int, start double, end double, top {top}, key_idx int")
    gold = spark.createDataFrame([("a", 0.0, 4.0, "V7/ii"), ("a", 0.0, 4.0, "V/ii"), ("b", 0.0, 4.0, "V7/ii")], "song_id string, start double, end double, value string")
    links = spark.createDataFrame([("a", 0, ["V7/ii"]), ("b", 0, ["♭VII7/IV"])], "song_id string, seg int, functions array<string>")
    rows = {r.song_id: r.asDict() for r in ev.expert_scores(keyed, gold, links).collect()}
    assert (rows["a"]["applied_gold"], rows["a"]["applied_pred"], rows["a"]["applied_tp_recall"], rows["a"]["applied_target_ok"]) == (2, 1, 2, 2)
    assert (rows["b"]["numeral_n"], rows["b"]["applied_gold"], rows["b"]["applied_pred"]) == (0, 1, 0)
    total = ev.expert_summary(ev.expert_scores(keyed, gold, links)).first()
    assert total.songs == 2 and total.applied_gold == 3 and abs(total.applied_recall - 2 / 3) < 1e-12 and total.applied_precision == 1.0


def test_equal_points_are_all_kept(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0)], "song_id string, at double")
    spans = spark.createDataFrame([("a", 0.0, 2.0, "x")], "song_id string, start double, end double, label string")
    assert sorted(str(r.i and r.i.label) for r in ev.point_lookup(points, spans).collect()) == ["None", "x", "x"]


def test_edit_script_is_cheapest():
    import numpy as np
    from cadenza.operators import alignment
    rng = np.random.default_rng(0)
    for _ in range(100):
        cost = rng.choice([0, 3, 10], size=rng.integers(1, 8, 2))
        n, m = cost.shape
        best = np.zeros((n + 1, m + 1), int)
        best[0], best[:, 0] = 10 * np.arange(m + 1), 10 * np.arange(n + 1)
        for i in range(n):
            for j in range(m):
                best[i + 1, j + 1] = min(best[i, j] + cost[i, j], best[i, j + 1] + 10, best[i + 1, j] + 10)
        out = alignment.sweep(cost, best[0], best[1:, 0], trace=True)
        assert (out["bottom"] == best[n]).all() and (out["right"] == best[1:, m]).all()
        steps = alignment.trace_tile(out["came"], n, m)
        i, j, kind = steps[-1]
        rest = best[i - (kind != 2), j - (kind != 1)]  # what the script cost before it entered the table
        assert best[n, m] == rest + sum(cost[i - 1, j - 1] if kind == 0 else 10 for i, j, kind in steps)


def test_report_weighs_each_measure(spark):
    chords = spark.createDataFrame([("a", *([1.0] * 8), 3.0), ("b", *([0.0] * 8), 1.0)], "song_id string, " + ", ".join(f"{n} double" for n in ev.LEVELS) + ", duration double")
    aligned = spark.createDataFrame([("a", 1.0, 10), ("b", 3.0, 10)], "song_id string, cost double, n_ref int")
    numerals = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.5)], "song_id string, strict double, degree double")
    keys = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0), ("b", 0.5, 0.0, 0.0, 3.0)], "song_id string, weighted double, exact double, tonic double, duration double")
    errors = spark.createDataFrame([("a", "missed"), ("b", "missed"), ("b", "key")], "song_id string, category string")
    got = {r.measure: r.value for r in ev.evaluation_report(chords, {"root": aligned}, numerals, keys, errors).collect()}
    assert got == {"songs": 2.0, "chord root": 0.75, "chord majmin": 0.75, "chord sevenths": 0.75, "chord mirex": 0.75, "chord seg": 0.75, "symbol error root": 0.2, "numeral agreement": 0.5,
                   "numeral degree agreement": 0.75, "local key weighted": 0.625, "local key exact": 0.25, "local key tonic": 0.25, "errors missed": 2.0, "errors key": 1.0}
