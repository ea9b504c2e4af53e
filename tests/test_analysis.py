"""Each rule from its definition: progressions are written as semitones above the tonic and set into several keys."""

import pytest

from cadenza import params as P
from cadenza import theory as th
from cadenza.operators import report, rules
from cadenza.plans import analysis as an
from tests.songs import FRAME_SCHEMA, Result, plain, soft

KEYS = [0, 3, 8]  # tonics each progression is set in
SUFFIX = {"maj": "", "min": "m", "dom": "7", "hdim": "m7b5", "dim": "dim", "sus": "sus4"}


def chord(tonic: int, token: str) -> str:
    """"7:m7" is the minor seventh chord seven semitones above the tonic; "0:/4" has its bass four above."""
    degree, _, suffix = token.partition(":")
    quality, _, bass = suffix.partition("/")
    name = lambda d: th.FLAT_NAMES[(tonic + int(d)) % 12]
    return name(degree) + quality + (f"/{name(bass)}" if bass else "")


def written(tonic: int, text: str) -> str:
    return " ".join(chord(tonic, t) for t in text.split())


#: name -> (progression, in minor)
RULES = {
    "cadence": ("0: 9:m 2:m7 7:7 0:", False), "minor_cadence": ("0:m 8: 2:m7b5 7:7 0:m", True),
    "to_second": ("0: 9:7 2:m 7: 0:", False), "to_fourth": ("0: 0:7 5: 7: 0:", False), "to_fifth": ("0: 9:m 2:7 7: 0:", False),
    "to_sixth": ("0: 4:7 9:m 5: 0:", False), "missed": ("0: 4:7 5: 0:", False), "open": ("0: 9:7 5: 0:", False),
    "substitute": ("0:maj7 2:m7 1:7 0:maj7", False), "leading": ("0: 1:dim7 2:m 7: 0:", False), "aeolian": ("0: 5: 8: 10: 0:", False),
    "backdoor": ("0: 5: 5:m7 10:7 0:", False), "evaded": ("0: 5: 7:7 9:m 5: 7: 0:", False), "minor_evaded": ("0:m 5:m 7:7 8: 5:m 0:m", True),
    "left_open": ("0: 2:m7 7:7 4:m 9:m", False), "at_the_end": ("0: 5: 2:m7 7:7", False),
    "triads": ("0: 9:m 5: 7: 0: 4:m 5: 0:", False), "minor_triads": ("0:m 8: 10: 0:m 5:m 0:m", True),
}
BORROWED = {f"borrowed{e['entry_no']}": (f"0:{'m' if e['mode'] == 'minor' else ''} {e['degree']}:{SUFFIX[e['classes'][0]]} 0:{'m' if e['mode'] == 'minor' else ''}",
                                         e["mode"] == "minor", e["numeral"]) for e in P.borrowed_entries()}
NAMED = {f"named{e['idiom']}": (" ".join(f"{p['degrees'][0]}:{SUFFIX[(p['classes'] or ['maj'])[0]]}" + (f"/{p['bass'][0]}" if p["bass"] and p["bass"][0] != p["degrees"][0] else "")
                                         for p in e["positions"]), e["name"], len(e["positions"])) for e in P.progression_entries()}
ESTIMATED = {"moves": ("0: 5: 7: 0: 9:m 2:m 7: 0: 5: 7:7 0: 2: 7: 9: 2: 11:m 4:m 9: 2: 7: 9:7 2: 2:", 5), "stays": ("0: 5: 7:7 0: 9:m 5: 7:7 0: 0:", 5),
             "in_minor": ("0:m 5:m 7:7 0:m 8: 5:m 7:7 0:m", 2)}
SOFT = {
    "certain": ([[("Bbm", 1.0)], [("Eb7", 1.0)], [("Ab", 1.0)]], 8),
    "split": ([[("Ab", 1.0)], [("Bbm", .6), ("Db", .4)], [("Eb7", .8), ("Gm", .2)], [("Ab", 1.0)]], 8),
    "half": ([[("Ab", 1.0)], [("C7", .7), ("Cm7", .3)], [("Fm", 1.0)]], 8),
    "faint": ([[("Ab", .35), ("Fm", .3)], [("Eb", 1.0)]], None),
    "unreadable": ([[("Ab", 1.0)], [("Q11", 1.0)], [("Eb", 1.0)]], None),
    "partly": ([[("Ab", .6), ("Abzz", .4)], [("Eb", 1.0)]], None),
}


def songs() -> list[tuple[str, str, int | None]]:
    out = [(f"{n}@{k}", written(k, text), k + 12 * minor) for n, (text, minor) in RULES.items() for k in KEYS]
    out += [(n, written(5, text), 5 + 12 * minor) for n, (text, minor, _) in BORROWED.items()]
    out += [(n, written(10, text), 10) for n, (text, *_) in NAMED.items()]
    return out + [(n, written(tonic, text), None) for n, (text, tonic) in ESTIMATED.items()]


def frames_of(spark):
    rows = [r for n, text, _ in songs() for r in plain(n, text)]
    rows += [r for n, (f, _) in SOFT.items() for r in soft(n, *f)]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def given_of(spark):
    known = [(n, k) for n, _, k in songs() if k is not None] + [(n, k) for n, (_, k) in SOFT.items() if k is not None]
    return spark.createDataFrame(known, "song_id string, key_idx int")


@pytest.fixture(scope="module")
def run(spark):
    a = an.analyze(frames_of(spark), given=given_of(spark))
    parts = [a.events.collect(), an.segment_output(a).collect(), a.global_keys.collect(), a.progressions.collect()]
    regions = a.regions.collect()

    def get(name):
        r = Result(name, *parts)
        r.regions = [x for x in regions if x.song_id == name]
        return r

    get.analysis = a
    return get


def everywhere(run, name):
    return [run(f"{name}@{k}") for k in KEYS]


def test_diatonic_triads_are_no_events(run):
    for name in ("triads", "minor_triads"):
        for r in everywhere(run, name):
            assert r.events == [] and all(s.diatonic for s in r.segments)


def test_two_five_one(run):
    for r in everywhere(run, "cadence"):
        ev = r.of("ii_V_I")
        assert [e.label for e in ev] == ["ii–V–I"] and ev[0].segs == [2, 3, 4] and ev[0].numerals == ["iim7", "V7", "I"]
    for r in everywhere(run, "minor_cadence"):
        ev = r.of("ii_V_I")
        assert [e.label for e in ev] == ["ii–V–i"] and ev[0].numerals == ["iiø7", "V7", "i"] and ev[0].attrs["mode"] == "minor"


@pytest.mark.parametrize("name,target", [("to_second", "ii"), ("to_fourth", "IV"), ("to_fifth", "V"), ("to_sixth", "vi")])
def test_dominant_of_each_degree(run, name, target):
    at = 2 if name == "to_fifth" else 1
    for r in everywhere(run, name):
        ev = r.at("secondary_dominant", at)
        assert [e.label for e in ev] == [f"V7/{target}"] and ev[0].attrs["resolution"] == "resolved"
        assert r.segments[at].functions == [f"V7/{target}"]


def test_dominants_that_go_elsewhere(run):
    for r, q in zip(everywhere(run, "missed"), everywhere(run, "open")):
        evaded, unresolved = r.of("secondary_dominant")[0], q.of("secondary_dominant")[0]
        assert evaded.label == "V7/vi (deceptive)" and unresolved.attrs["resolution"] == "unresolved"
        assert unresolved.conf < evaded.conf


def test_substitutes(run):
    for r in everywhere(run, "substitute"):
        ev = r.of("tritone_sub")
        assert [e.label for e in ev] == ["subV7 → I"] and ev[0].numerals[0] == "♭II7" and ev[0].attrs["preceded_by_ii"] == "true"
    for r in everywhere(run, "leading"):
        assert r.labels("secondary_leading_tone") == ["vii°7/ii"]
    for r in everywhere(run, "aeolian"):
        assert r.labels("aeolian_cadence") == ["♭VI–♭VII–I"] and r.numerals[2:4] == ["♭VI", "♭VII"]
    for r in everywhere(run, "backdoor"):
        assert r.at("borrowed_chord", 3)[0].attrs["backdoor"] == "true"


def test_every_borrowed_entry(run):
    # the rule alone, before other readings compete
    raw = rules.borrowed(run.analysis.context, P.with_overrides(), P.borrowed_entries()).collect()
    found = {}
    for e in raw:
        found.setdefault(e.song_id, set()).add(e.attrs["entry"])
    assert {n: found.get(n) for n in BORROWED} == {n: {numeral} for n, (_, _, numeral) in BORROWED.items()}
    assert not any(s.startswith(("triads@", "minor_triads@")) for s in found)


def test_deceptive_cadences(run):
    for r in everywhere(run, "evaded"):
        ev = r.of("deceptive_cadence")
        assert [e.label for e in ev] == ["V–vi (deceptive cadence)"] and ev[0].segs == [2, 3]
    for r in everywhere(run, "minor_evaded"):
        assert r.labels("deceptive_cadence") == ["V–♭VI (deceptive cadence)"]
    assert all(r.of("deceptive_cadence") == [] for r in everywhere(run, "cadence"))


def test_two_five_without_one(run):
    for r in everywhere(run, "left_open"):
        assert r.labels("ii_V") == ["ii–V (unresolved)"] and r.of("ii_V_I") == []
    for r in everywhere(run, "at_the_end"):
        assert [e.attrs["resolution"] for e in r.of("ii_V")] == ["end"]
    assert all(r.of("ii_V") == [] for r in everywhere(run, "cadence"))


def test_named_progressions_by_their_own_positions(run):
    for name, (_, title, length) in NAMED.items():
        found = [p for p in run(name).names if p.name == title]
        assert found and len(found[0].segs) == length, name
    assert all(r.names == [] for r in everywhere(run, "aeolian"))


def test_estimated_keys(run):
    r = run("moves")
    m = r.of("modulation")
    assert len(m) == 1 and (m[0].attrs["from"], m[0].attrs["to"]) == ("F major", "G major") and m[0].attrs["interval"] == "whole step up"
    assert [th.KEY_LABELS[x.key_idx] for x in sorted(r.regions, key=lambda x: x.region)] == ["F major", "G major"]
    assert run("stays").key == "F major" and len(run("stays").regions) == 1 and run("in_minor").key == "D minor"
    r = run("cadence@3")
    assert r.home[0].source == "given" and {s.key for s in r.segments} == {"Eb major"} and r.home[0].prob == 1.0


def test_soft_evidence(run):
    assert run("certain").of("ii_V_I")[0].conf >= 0.9
    ev = run("split").of("ii_V_I")
    assert len(ev) == 1 and ev[0].conf < 0.6 and ev[0].low_confidence
    sd = run("half").of("secondary_dominant")
    assert len(sd) == 1 and abs(sd[0].conf - 0.7) < 0.005
    r = run("faint")
    assert r.segments[0].low_confidence and any("chord confidence" in w for w in r.segments[0].warnings)
    assert run("unreadable").segments[1].chord == "X" and run("unreadable").segments[1].low_confidence
    assert run("partly").segments[0].chord == "Ab"


def test_evidence_product_is_the_confidence(run):
    for e in run.analysis.events.collect():
        value = 1.0
        for x in e.evidence:
            value *= x.factor
        assert abs(value - e.conf) < 2e-3, (e.label, value, e.conf)


def test_keys_only_shift_what_is_named(run):
    """The same progression in another key has the same numerals, labels and confidences."""
    for name in RULES:
        views = [([(e.type, e.label, e.numerals, e.conf) for e in r.events], r.numerals) for r in everywhere(run, name)]
        assert views[0] == views[1] == views[2], name


def test_block_layout_gives_the_same_tables(spark, run):
    a, b = run.analysis, an.analyze(frames_of(spark), given=given_of(spark), size=3)
    key = ["song_id", "id", "type", "label", "segs", "functions", "conf", "part_of"]
    assert sorted(map(str, a.events.select(*key).collect())) == sorted(map(str, b.events.select(*key).collect()))
    key = ["song_id", "seg", "key_idx"]
    assert sorted(map(str, a.keys.select(*key).collect())) == sorted(map(str, b.keys.select(*key).collect()))


@pytest.mark.parametrize("size", [None, 3, 4, 5, 4096])
def test_sections_with_unmarked_frames_in_any_layout(spark, size):
    marks = ["A", "A", None, "A", "B", "B", "", "A", "C", "C", "A", "A", None, None, "A"]
    rows = [("s", i, float(i), 1.0, m) for i, m in enumerate(marks)] + [("t", 7, 7.0, 1.0, "X"), ("t", 30, 30.0, 1.0, "X")]
    frames = spark.createDataFrame(rows, "song_id string, frame_idx int, time double, duration double, section string")
    got = sorted(tuple(r) for r in report.marker_sections(frames, size).select("song_id", "sec", "label", "start", "end").collect())
    assert got == [("s", 0, "A", 0.0, 4.0), ("s", 1, "B", 4.0, 6.0), ("s", 2, "A", 7.0, 8.0), ("s", 3, "C", 8.0, 10.0), ("s", 4, "A", 10.0, 15.0), ("t", 0, "X", 7.0, 31.0)]


def test_bars_across_a_section_border_list_their_own_side(spark):
    bars = spark.createDataFrame([("s", 0, 0.0, 4.0), ("s", 1, 4.0, 8.0)], "song_id string, bar_no int, start double, end double")
    segs = spark.createDataFrame([("s", 0, 0.0, 6.0, "F", "F:maj", "IV"), ("s", 1, 6.0, 8.0, "G", "G:maj", "V")],
                                 "song_id string, seg int, start double, end double, chord string, chord_harte string, display string")
    sections = spark.createDataFrame([("s", 0, 0.0, 6.0), ("s", 1, 6.0, 8.0)], "song_id string, sec int, start double, end double")
    got = {(r.sec, r.bar_no): r.numerals for r in report.bar_numerals(bars, segs, sections, P.with_overrides()).collect()}
    assert got == {(0, 0): "IV", (0, 1): "IV", (1, 1): "V"}
