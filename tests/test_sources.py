"""Charts, label files, JSON documents, evaluation sets and reports on small fixtures."""

import json

import pytest

from cadenza.functions import labels as lb
from cadenza.operators import report as rp
from cadenza.plans import analysis as an
from cadenza.sources import documents as docs
from cadenza.sources import edits
from cadenza.sources import text as tx

CHARTS = {"a": "[Verse] | C | Am7 . . G | [Chorus] | F | % |", "b": "C G Am Em", "c": "# title\n| C#dim7 | F#m // | X |\n| % | G . |",
          "d": "| C | Hm | G |", "e": "| % | C |", "f": "| C % | G |", "g": "| . C |"}


def charts(spark):
    return spark.createDataFrame([(k, v, 4) for k, v in CHARTS.items()], "song_id string, text string, beats_per_bar int")


def by_song(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.song_id, r.frame_idx)):
        out.setdefault(r.song_id, []).append(r)
    return out


def test_charts(spark):
    frames, problems = tx.parse_charts(charts(spark))
    f = by_song(frames.collect())
    assert [(r.candidates[0].label, r.beats, r.section, r.time, r.bar, r.beat_in_bar) for r in f["a"]] == [
        ("C", 4.0, "Verse", 0.0, 1, 1.0), ("Am7", 3.0, "Verse", 4.0, 2, 1.0), ("G", 1.0, "Verse", 7.0, 2, 4.0),
        ("F", 4.0, "Chorus", 8.0, 3, 1.0), ("F", 4.0, "Chorus", 12.0, 4, 1.0)]
    assert [r.time for r in f["b"]] == [0.0, 4.0, 8.0, 12.0]
    assert [(r.candidates[0].label, r.duration) for r in f["c"]] == [("C#dim7", 4.0), ("F#m", 4.0), ("F#m", 4.0), ("G", 4.0)]
    bad = {(r.song_id, r.problem) for r in problems.collect()}
    assert ("d", "no root note") in bad and ("e", "'%' with no previous bar") in bad
    assert ("f", "'%' must stand alone in its bar") in bad and ("g", "'.' with no previous chord") in bad
    strict, _ = tx.parse_charts(charts(spark), "raise")
    assert {r.song_id for r in strict.collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        tx.parse_charts(charts(spark), "ignore")


def test_lab(spark):
    text = "0.0 2.0 C\n# comment\n\n2.0\t4.0\tA:min7/b3 \nbroken line\nx 1 C\n"
    good, bad = tx.parse_lab(tx.lab_lines(spark.createDataFrame([("s", text)], "song_id string, text string")))
    assert [(r.start, r.end, r.label) for r in good.orderBy("line_no").collect()] == [(0.0, 2.0, "C"), (2.0, 4.0, "A:min7/b3")]
    assert [r.text for r in bad.orderBy("line_no").collect()] == ["broken line", "x 1 C"]
    assert [r.duration for r in tx.lab_frames(good).orderBy("frame_idx").collect()] == [2.0, 2.0]


def test_recognition_round_trip(spark, tmp_path):
    frames, _ = tx.parse_charts(charts(spark).where("song_id in ('a', 'b')"))
    out = docs.recognition_documents(frames).collect()
    for r in out:
        (tmp_path / f"{r.song_id}.json").write_text(r.doc)
    (tmp_path / "bad.json").write_text('{"frames": [], "time_unit": "hour"}')
    (tmp_path / "broken.json").write_text("{nope")
    d = docs.read_json(spark, str(tmp_path), docs.RECOGNITION).selectExpr("regexp_extract(path, '([^/]*)[.]json$', 1) as song_id", "*")
    back, rejects = docs.recognition_frames(d)
    key = ["song_id", "frame_idx", "time", "duration", "beats", "bar", "beat_in_bar", "section", "candidates"]
    assert sorted(map(str, back.select(*key).collect())) == sorted(map(str, frames.select(*key).collect()))
    assert {r.song_id for r in rejects.collect()} == {"bad", "broken"}


def test_annotations_cumulative_and_absolute(spark):
    def ann(ns, rows):
        return (ns, [(float(t), float(d), v) for t, d, v in rows])

    doc = [ann("chord_harte", [(1.1, 4, "C:maj"), (2.1, 2, "weird:x"), (2.3, 2, "G:7")]),
           ann("key_mode", [(1.1, 8, "C:major")]), ann("chord_roman", [(1.1, 4, "C:I"), (2.1, 2, "C:V7/V"), (2.3, 2, "C:V7")])]
    d = spark.createDataFrame([("s", doc)], f"song_id string, {docs.JAMS}")
    t = docs.annotation_tables(d, True)
    assert [(r.time, r.candidates[0].label) for r in t["frames"].orderBy("frame_idx").collect()] == [(0.0, "C:maj"), (4.0, "X"), (6.0, "G:7")]
    assert [(r.start, r.end, r.key_idx) for r in t["keys"].collect()] == [(0.0, 8.0, 0)]
    assert [(r.start, r.value) for r in t["romans"].orderBy("start").collect()] == [(0.0, "I"), (4.0, "V7/V"), (6.0, "V7")]
    t = docs.annotation_tables(d, False)
    assert [r.time for r in t["frames"].orderBy("frame_idx").collect()] == [1.1, 2.1, 2.3]


def make_eval_set(root):
    lab = root / "dev" / "toy_lab"
    lab.mkdir(parents=True)
    chords = "C Am Dm7 G7 C E7 Am F Fm C Gm7 C7 F G7 C".split()
    (lab / "chords.lab").write_text("".join(f"{2 * i}.000 {2 * i + 2}.000 {c}\n" for i, c in enumerate(chords)))
    (lab / "keys.lab").write_text("0.000\t30.000\tC:maj\n")
    (lab / "meta.toml").write_text('title = "toy"\nkey = "C major"\n')
    (lab / "events.json").write_text(json.dumps([
        {"type": "ii_V_I", "start": 4.0, "end": 10.0, "label": "ii–V–I"}, {"type": "secondary_dominant", "start": 10.0, "end": 14.0, "label": "V7/vi"},
        {"type": "borrowed_chord", "start": 16.0, "end": 18.0}, {"type": "ii_V_I", "start": 20.0, "end": 26.0, "label": "ii–V–I → IV"},
        {"type": "secondary_dominant", "start": 22.0, "end": 26.0, "label": "V7/IV"}]))
    chart = root / "dev" / "toy_chart"
    chart.mkdir()
    (chart / "chords.txt").write_text("[Verse] | C | Am | Dm7 G7 | C |\n[Chorus] | F | G | E7 | Am | F | Fm | C | C |\n")
    (chart / "meta.toml").write_text('title = "toy"\nkey = "C major"\nbeats_per_bar = 4\n')
    (chart / "events.json").write_text(json.dumps([{"type": "ii_V_I", "bars": [3, 4], "label": "ii–V–I"}, {"type": "secondary_dominant", "bars": [7, 8], "label": "V7/vi"},
                                                   {"type": "borrowed_chord", "bars": [10, 10]}]))
    (root / "dev" / "_draft").mkdir()
    (root / "dev" / "_draft" / "chords.lab").write_text("0 1 C\n")
    return root


def test_evaluation_set(spark, tmp_path):
    e = docs.evaluation_set(spark, str(make_eval_set(tmp_path)), "dev")
    assert {(r.song_id, r.kind, r.key, r.beats_per_bar) for r in e["songs"].collect()} == {("toy_lab", "lab", "C major", 4), ("toy_chart", "chart", "C major", 4)}
    assert e["frames"].groupBy("song_id").count().count() == 2
    g = {(r.song_id, r.gold_id): (r.start, r.end) for r in e["gold"].collect()}
    assert g["toy_chart", 0] == (8.0, 16.0) and g["toy_chart", 2] == (36.0, 40.0) and g["toy_lab", 3] == (20.0, 26.0)
    assert [(r.start, r.end, r.key_idx) for r in e["keys"].collect()] == [(0.0, 30.0, 0)]
    with pytest.raises(ValueError):
        docs.evaluation_set(spark, str(tmp_path), "train")


def test_gold_rejects(spark):
    d = spark.createDataFrame([("a", "lab", 4, '[{"type":"x","bars":[1,2]},{"type":"y"}]')], "song_id string, kind string, beats_per_bar int, doc string")
    good, bad = docs.gold_events(d)
    assert good.count() == 0 and bad.count() == 2


def test_choices(spark):
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "song_id string")
    cand = spark.createDataFrame([("a", ".lab"), ("a", ".json"), ("b", ".lab"), ("z", ".json")], "song_id string, extension string")
    picked, skipped = docs.pick_estimates(refs, cand)
    assert {(r.song_id, r.extension) for r in picked.collect()} == {("a", ".json"), ("b", ".lab")}
    assert [r.song_id for r in skipped.collect()] == ["c"]
    files = spark.createDataFrame([("x", "d2", "two"), ("x", "d1", "one"), ("y", "d2", "y")], "stem string, directory string, sections string")
    pri = spark.createDataFrame([("d1", 0), ("d2", 1)], "directory string, priority int")
    assert {(r.stem, r.sections) for r in docs.section_files(files, pri).collect()} == {("x", "one"), ("y", "y")}
    runs = spark.createDataFrame([("p", 1, "old"), ("p", 2, "new")], "source_path string, modified int, doc_id string")
    assert [r.doc_id for r in docs.newest_per_source(runs).collect()] == ["new"]
    both, missing = docs.pair_annotations(spark.createDataFrame([("a", "c"), ("b", "c")], "song_id string, text string"),
                                          spark.createDataFrame([("a", "k")], "song_id string, text string"))
    assert [r.song_id for r in both.collect()] == ["a"] and [r.song_id for r in missing.collect()] == ["b"]
    assert both.collect()[0].split in ("dev", "test") and lb.split_of("x")


def test_later_edits_win(spark):
    frames, _ = tx.parse_charts(charts(spark).where("song_id = 'b'"))
    e = spark.createDataFrame([("b", 1, 0.0, 8.0, "D"), ("b", 2, 4.0, 8.0, "E")], "song_id string, edit_no int, start double, end double, label string")
    assert [r.candidates[0].label for r in edits.apply_edits(frames, e).orderBy("frame_idx").collect()] == ["D", "E", "Am", "Em"]


def test_section_report_and_documents(spark, tmp_path):
    text = {"loops": "[Verse] | C | F | C | G | C | F | C | G | [Chorus] | F | G | Em | Am | F | G | Em | Am |",
            "plain": "[A] | C | Dm | Em | F | G | Am | Bdim | C |"}
    frames, _ = tx.parse_charts(spark.createDataFrame([(k, v, 4) for k, v in text.items()], "song_id string, text string, beats_per_bar int"))
    a = an.analyze(frames)
    rows = an.segment_output(a)
    rep = {(r.song_id, r.label): r for r in rp.section_report(frames, rows, a.events, a.progressions, a.params).collect()}
    assert rep["loops", "Verse"].loop == ["I", "IV", "I", "V"] and rep["loops", "Chorus"].loop == ["IV", "V", "iii", "vi"]
    assert rep["loops", "Chorus"].progressions == ["王道進行"] and rep["loops", "Verse"].keys[0].key == "C major"
    assert rep["plain", "A"].loop == [] and len(rep["plain", "A"].bars) == 8
    d = json.loads(rp.analysis_documents(rows, a.events, a.regions, a.global_keys, a.progressions).where("song_id = 'loops'").collect()[0].doc)
    assert d["schema_version"] == "0.1.0" and {"global_key", "key_regions", "segments", "events", "progressions"} <= set(d)
    songs = spark.createDataFrame([("loops",), ("plain",), ("failed",)], "song_id string")
    s = {r.song_id: r for r in rp.corpus_summary(rows, a.global_keys, a.regions, a.events, a.progressions, songs).collect()}
    assert s["failed"].error and s["loops"].global_key == "C major" and s["loops"].progressions["王道進行"] == 2
    rp.write_label_files(rows.where("song_id = 'plain'"), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "0.000\t4.000\tC:maj" in lines
