"""DuckDB SQL for the registered queries, written against the raw ``events`` table.

Each oracle repeats the derivation of the corpus and states the operator in plain joins, windows
and recursive CTEs; nothing is shared with the Spark implementation except fixed values.
"""

from __future__ import annotations

NOTES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
UPPER = "['I','♭II','II','♭III','III','IV','♭V','V','♭VI','VI','♭VII','VII']"
LOWER = "['i','♭ii','ii','♭iii','iii','iv','♯iv','v','♭vi','vi','♭vii','vii']"
DIMIN = "['i','♯i','ii','♯ii','iii','iv','♯iv','v','♯v','vi','♯vi','vii']"
TRIAD = "['maj','-','min','-','min','maj','-','maj','-','min','-','dim']"
KEYS = ("['C major','Db major','D major','Eb major','E major','F major','F# major','G major','Ab major','A major',"
        "'Bb major','B major','C minor','C# minor','D minor','Eb minor','E minor','F minor','F# minor','G minor',"
        "'G# minor','A minor','Bb minor','B minor']")
CLS = ("CASE {0} WHEN 'maj' THEN 'maj' WHEN 'maj7' THEN 'maj' WHEN 'min' THEN 'min' WHEN 'min7' THEN 'min' "
       "WHEN '7' THEN 'dom' WHEN 'dim' THEN 'dim' WHEN 'hdim7' THEN 'hdim' END")
SUFFIX = ("CASE {0} WHEN 'maj' THEN '' WHEN 'min' THEN '' WHEN 'dim' THEN '°' WHEN '7' THEN '7' WHEN 'maj7' THEN 'maj7' "
          "WHEN 'min7' THEN 'm7' WHEN 'hdim7' THEN 'ø7' END")
# semitones of the qualities that occur in the derived corpus
TONES = ("CASE {0} WHEN 'maj' THEN [0,4,7] WHEN 'min' THEN [0,3,7] WHEN 'dim' THEN [0,3,6] WHEN '7' THEN [0,4,7,10] "
         "WHEN 'maj7' THEN [0,4,7,11] WHEN 'min7' THEN [0,3,7,10] WHEN 'hdim7' THEN [0,3,6,10] END")
MAJOR = "[0,2,4,5,7,9,11]"
MINOR = "[0,2,3,5,7,8,10,11]"


def m6(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5000003) AS BIGINT)"


def m4(x: str) -> str:
    return f"CAST(floor(({x}) * 10000 + 0.5000001) AS BIGINT)"


def deg(pc: str, tonic: str) -> str:
    return f"(({pc}) - ({tonic}) + 24) % 12"


def numeral(degree: str, cls: str) -> str:
    return (f"CASE WHEN {cls} IN ('dim','hdim') THEN {DIMIN}[({degree})+1] WHEN {cls} = 'min' THEN {LOWER}[({degree})+1] "
            f"ELSE {UPPER}[({degree})+1] END")


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTE[name] = (needs.split(), text)


cte("cf", "", f"""
  SELECT *, CAST(floor(start_beat / 4) AS INT) + 1 AS bar,
         CASE WHEN CAST(floor(frame_idx / 16) AS INT) % 2 = 0 THEN 'Verse' ELSE 'Chorus' END AS section,
         event_id % 5 = 0 AND q1 <> 'N' AS corrupt,
         CASE WHEN q1 = 'N' THEN NULL ELSE r1 END AS root1,
         CASE WHEN q1 = 'N' THEN NULL WHEN q1 IN ('maj','maj7','7') THEN (r1 + 9) % 12 ELSE (r1 + 3) % 12 END AS root2,
         CASE WHEN q1 = 'N' THEN NULL WHEN q1 IN ('maj','maj7','7') THEN 'min' ELSE 'maj' END AS q2,
         CASE WHEN q1 = 'N' THEN 0 ELSE CAST((1000 - p1_permille) / 10 * 6 AS INT) END AS p2_permille
  FROM (SELECT *, (tonic + [0,5,7,9,2,4,11][g + 1]) % 12 AS r1,
          CASE WHEN k >= 97 THEN 'N' WHEN event_type = 'error' THEN '7' WHEN event_type = 'purchase' THEN 'min'
               WHEN event_type = 'signup' THEN CASE WHEN g <= 2 THEN 'maj' WHEN g <= 5 THEN 'min' ELSE 'dim' END
               ELSE CASE WHEN g <= 1 THEN 'maj7' WHEN g = 2 THEN '7' WHEN g <= 5 THEN 'min7' ELSE 'hdim7' END END AS q1,
          CAST(500 + 10 * (k % 50) AS INT) AS p1_permille
        FROM (SELECT *, k % 7 AS g, CAST((song_id + CASE WHEN song_id % 3 = 0 AND frame_idx >= 30 THEN 2 ELSE 0 END) % 12 AS INT) AS tonic,
                CAST(sum(beats) OVER (PARTITION BY song_id ORDER BY frame_idx) - beats AS INT) AS start_beat
              FROM (SELECT user_id AS song_id, event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
                      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx,
                      CAST(1 + event_id % 4 AS INT) AS beats FROM events)))""")

for _kind, _px in (("soft", ""), ("ref", "r_"), ("est", "e_")):
    _r = {"soft": "root1", "ref": "root1", "est": "CASE WHEN corrupt THEN root2 ELSE root1 END"}[_kind]
    _q = {"soft": "q1", "ref": "q1", "est": "CASE WHEN corrupt THEN q2 ELSE q1 END"}[_kind]
    _p = "p1_permille / 1000.0::DOUBLE" if _kind == "soft" else "1.0::DOUBLE"
    _second = ("UNION ALL SELECT song_id, frame_idx, 1, root2, q2, p2_permille / 1000.0::DOUBLE, start_beat, beats, section, bar "
               "FROM cf WHERE q1 <> 'N'") if _kind == "soft" else ""
    cte(f"{_px}cand", "cf", f"""
      SELECT *, CASE WHEN q = 'N' THEN 'N' ELSE {NOTES}[root + 1] || ':' || q END AS harte
      FROM (SELECT song_id, frame_idx, 0 AS pos, {_r} AS root, {_q} AS q, {_p} AS prob, start_beat, beats, section, bar
            FROM cf {_second})""")
    cte(f"{_px}fseg", f"{_px}cand", f"""
      SELECT song_id, frame_idx, CAST(sum(fresh) OVER (PARTITION BY song_id ORDER BY frame_idx) - 1 AS INT) AS seg
      FROM (SELECT *, CASE WHEN lag(harte) OVER w IS NOT DISTINCT FROM harte AND lag(section) OVER w IS NOT DISTINCT FROM section
                           THEN 0 ELSE 1 END AS fresh
            FROM {_px}cand WHERE pos = 0 WINDOW w AS (PARTITION BY song_id ORDER BY frame_idx))""")
    cte(f"{_px}segc", f"{_px}cand {_px}fseg", f"""
      SELECT song_id, seg, harte, min(root) AS root, min(q) AS q, sum(prob * beats) / max(total) AS prob, min(o) AS o
      FROM (SELECT c.*, f.seg, c.frame_idx * 10 + c.pos AS o,
                   sum(CASE WHEN pos = 0 THEN beats END) OVER (PARTITION BY c.song_id, f.seg) AS total
            FROM {_px}cand c JOIN {_px}fseg f USING (song_id, frame_idx))
      GROUP BY song_id, seg, harte""")
    cte(f"{_px}seg", f"{_px}cand {_px}fseg {_px}segc", f"""
      SELECT s.*, t.root, t.q, t.harte, t.prob
      FROM (SELECT song_id, seg, min(start_beat) AS start, max(start_beat + beats) AS stop, CAST(sum(beats) AS INT) AS beats,
                   min(section) AS section, min(bar) AS bar, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame
            FROM {_px}cand JOIN {_px}fseg USING (song_id, frame_idx) WHERE pos = 0 GROUP BY song_id, seg) s
      JOIN (SELECT * FROM {_px}segc QUALIFY row_number() OVER (PARTITION BY song_id, seg ORDER BY prob DESC, o) = 1) t USING (song_id, seg)""")
    cte(f"{_px}srun", f"{_px}seg", f"""
      SELECT *, CAST(sum(fresh) OVER (PARTITION BY song_id ORDER BY seg) - 1 AS INT) AS run
      FROM (SELECT *, CASE WHEN seg > 0 AND lag(root) OVER w IS NOT DISTINCT FROM root THEN 0 ELSE 1 END AS fresh
            FROM {_px}seg WINDOW w AS (PARTITION BY song_id ORDER BY seg))""")
    cte(f"{_px}run", f"{_px}srun", f"""
      SELECT song_id, run, min(root) AS root, CAST(sum(beats) AS INT) AS beats, min(seg) AS seg_first, max(seg) AS seg_last,
             CASE WHEN min(root) IS NULL THEN CASE WHEN sum(beats) < 1 THEN 'skip' ELSE 'block' END
                  WHEN sum(beats) < 0.5 THEN 'skip' ELSE 'use' END AS state
      FROM {_px}srun GROUP BY song_id, run""")
    # nearest usable run with nothing blocking in between, as a correlated search
    cte(f"{_px}nav", f"{_px}run", f"""
      SELECT r.*, (SELECT min(n.run) FROM {_px}run n WHERE n.song_id = r.song_id AND n.run > r.run AND n.state = 'use'
                   AND NOT EXISTS (SELECT 1 FROM {_px}run b WHERE b.song_id = r.song_id AND b.state = 'block'
                                   AND b.run > r.run AND b.run < n.run)) AS next_run,
                  (SELECT max(n.run) FROM {_px}run n WHERE n.song_id = r.song_id AND n.run < r.run AND n.state = 'use'
                   AND NOT EXISTS (SELECT 1 FROM {_px}run b WHERE b.song_id = r.song_id AND b.state = 'block'
                                   AND b.run < r.run AND b.run > n.run)) AS prev_run
      FROM {_px}run r""")
    # masses of every root a run offers, on every segment of the run (key = song_id mod 12, major)
    _sum = ", ".join(f"sum(CASE WHEN {CLS.format('c.q')} = '{x}' THEN c.prob ELSE 0 END) AS {x}" for x in ("maj", "min", "dom", "dim", "hdim"))
    _off = f"len(list_filter({TONES.format('c.q')}, lambda i: NOT list_contains({MAJOR}, (c.root + i - c.kt + 24) % 12))) > 0"
    _offsum = ", ".join(f"sum(CASE WHEN {_off} AND {CLS.format('c.q')} = '{x}' THEN c.prob ELSE 0 END) AS x{x}" for x in ("maj", "min", "dom", "dim", "hdim"))
    _third = "NOT list_contains(" + MAJOR + ", (c.root + 4 - c.kt + 24) % 12)"
    _flat7 = "NOT list_contains(" + MAJOR + ", (c.root + 10 - c.kt + 24) % 12)"
    cte(f"{_px}mass", f"{_px}segc {_px}srun", f"""
      SELECT g.song_id, g.run, g.seg, g.root, g.kt, g.seg_first, g.seg_last, coalesce(m.rp, 0) AS rp, coalesce(m.maxp, 0) AS maxp,
             {', '.join(f'coalesce(m.{x}, 0) AS {x}, coalesce(m.x{x}, 0) AS x{x}' for x in ('maj', 'min', 'dom', 'dim', 'hdim'))},
             coalesce(sev, 0) AS sev, coalesce(dw, 0) AS dw, coalesce(dx, 0) AS dx, coalesce(lt, 0) AS lt, coalesce(tt, 0) AS tt
      FROM (SELECT DISTINCT a.song_id, a.run, b.seg, a.root, a.song_id % 12 AS kt, a.seg_first, a.seg_last
            FROM (SELECT DISTINCT s.song_id, s.run, c.root, min(s.seg) OVER (PARTITION BY s.song_id, s.run) AS seg_first,
                         max(s.seg) OVER (PARTITION BY s.song_id, s.run) AS seg_last
                  FROM {_px}srun s JOIN {_px}segc c USING (song_id, seg) WHERE s.root IS NOT NULL AND c.root IS NOT NULL) a
            JOIN {_px}srun b ON b.song_id = a.song_id AND b.run = a.run) g
      LEFT JOIN (SELECT c.song_id, c.seg, c.root, sum(c.prob) AS rp, max(c.prob) AS maxp, {_sum}, {_offsum},
                        sum(CASE WHEN c.q IN ('7','maj7','min7','hdim7') THEN c.prob ELSE 0 END) AS sev,
                        sum(CASE WHEN c.q = '7' AND ({_third} OR {_flat7}) THEN c.prob WHEN c.q = 'maj' AND {_third} THEN c.prob * 0.85 ELSE 0 END) AS dw,
                        sum(CASE WHEN c.q = '7' AND ({_third} OR {_flat7}) THEN c.prob WHEN c.q = 'maj' AND {_third} THEN c.prob ELSE 0 END) AS dx,
                        sum(CASE c.q WHEN 'dim' THEN c.prob * 0.9 WHEN 'hdim7' THEN c.prob * 0.8 ELSE 0 END) AS lt,
                        sum(CASE c.q WHEN '7' THEN c.prob WHEN 'maj' THEN c.prob * 0.3 ELSE 0 END) AS tt
                 FROM (SELECT *, song_id % 12 AS kt FROM {_px}segc WHERE root IS NOT NULL) c GROUP BY c.song_id, c.seg, c.root) m
        ON m.song_id = g.song_id AND m.seg = g.seg AND m.root = g.root""")
    _role = lambda n, v: f"arg_max(struct_pack(seg := seg, rp := rp, v := {v}, maj := maj, min := min, dom := dom, dim := dim, hdim := hdim, sev := sev, dx := dx), floor(({v}) * 1e9 + 0.5) * 1000 + seg) AS {n}"
    cte(f"{_px}rr", f"{_px}mass", f"""
      SELECT song_id, run, root, kt, max(rp) AS rp, min(CASE WHEN rp >= 0.05 THEN seg END) AS o1,
             arg_min(-rp, CASE WHEN rp >= 0.05 THEN seg END) AS o2, arg_min(-maxp, CASE WHEN rp >= 0.05 THEN seg END) AS o3,
             {_role('ii', 'min + hdim + dim')}, {_role('vv', 'dom + maj')}, {_role('md', 'maj + dom')}, {_role('dw', 'dw')},
             {_role('lt', 'lt')}, {_role('tt', 'tt')},
             max(CASE WHEN seg = seg_first THEN CASE WHEN rp > 0 THEN (maj + min) / rp ELSE 0 END END) AS f_ok,
             max(CASE WHEN seg = seg_first THEN CASE WHEN rp > 0 THEN (dim + hdim) / rp ELSE 0 END END) AS f_bad,
             max(CASE WHEN seg = seg_first THEN CASE WHEN rp > 0 THEN min / rp ELSE 0 END END) AS f_min,
             max(CASE WHEN seg = seg_first THEN CASE WHEN rp > 0 THEN maj / rp ELSE 0 END END) AS f_maj,
             max(CASE WHEN seg = seg_first THEN CASE WHEN rp > 0 THEN (maj + dom) / rp ELSE 0 END END) AS f_md,
             max(min + hdim + dim) AS pre_ii, max(min + hdim) AS pre_ii2, max(maj + min) AS pre_iv
      FROM {_px}mass GROUP BY song_id, run, root, kt""")
    cte(f"{_px}ri", f"{_px}nav {_px}seg", f"""
      SELECT n.*, n.song_id % 12 AS kt, s.q AS first_q FROM {_px}nav n JOIN {_px}seg s ON s.song_id = n.song_id AND s.seg = n.seg_first
      WHERE n.root IS NOT NULL""")


def compose(final: str, needs: str) -> str:
    """WITH clause of everything a final select needs, in dependency order."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in CTE[n][0]:
            add(d)
        done.append(n)

    for n in needs.split():
        add(n)
    parts = ",\n".join(f"{n} AS {'' if n.startswith('rec_') else 'MATERIALIZED '}({CTE[n][1]})" for n in done)
    return f"WITH RECURSIVE {parts}\n{final}"


ORACLES: dict[str, str] = {}


def oracle(name: str, needs: str, final: str) -> None:
    ORACLES[name] = compose(final, needs)


# ---------------------------------------------------------------- frames, segments, runs
oracle("w1_segments", "seg", f"""SELECT song_id, seg, start, stop, beats, section, bar, harte, {m6('prob')} AS prob_e6 FROM seg""")
oracle("a1_segment_candidates", "segc", f"SELECT song_id, seg, harte, {m6('prob')} AS prob_e6 FROM segc")
oracle("w2_runs", "run", "SELECT song_id, run, root, beats, seg_first, seg_last, state FROM run")
oracle("j3_neighbours", "nav", "SELECT song_id, run, next_run, prev_run FROM nav")
oracle("p1_clean_candidates", "cand", f"""
  SELECT song_id, frame_idx, CAST(row_number() OVER (PARTITION BY song_id, frame_idx ORDER BY pos) - 1 AS INT) AS pos, harte,
         {m6("prob / CASE WHEN s > 1 + 1e-6 THEN s ELSE 1 END")} AS prob_e6
  FROM (SELECT *, sum(prob) OVER (PARTITION BY song_id, frame_idx) AS s FROM (
          SELECT song_id, frame_idx, pos, harte, prob * CASE WHEN frame_idx % 7 = 0 THEN 2 ELSE 1 END AS prob FROM cand
          WHERE frame_idx % 5 <> 1 OR pos = 1
          UNION ALL SELECT song_id, frame_idx, 0, 'X', 0 FROM cf
          WHERE frame_idx % 5 = 1 AND q1 = 'N'))""")
oracle("p2_frame_beats", "cf", f"""
  SELECT song_id, frame_idx, {m6("CASE frame_idx % 3 WHEN 0 THEN beats WHEN 1 THEN beats * 0.5 / 0.5 ELSE greatest(beats * 0.25 / 0.5, 1e-6) END")} AS w_e6
  FROM cf""")
oracle("p3_key_weight", "seg", f"SELECT song_id, seg, {m6('least(greatest(beats / 4.0, 0.25), 2.0)')} AS w_e6 FROM seg")
oracle("p4_likely_roots", "segc", f"""
  SELECT song_id, seg, root, {m6('sum(prob)')} AS prob_e6 FROM segc WHERE root IS NOT NULL GROUP BY song_id, seg, root HAVING sum(prob) >= 0.05""")
oracle("p5_segment_rows", "seg", f"""
  SELECT song_id, seg, harte, {numeral(deg('root', 'song_id % 12'), CLS.format('q'))} || {SUFFIX.format('q')} AS display,
         {deg('root', 'song_id % 12')} AS degree,
         CASE WHEN root IS NULL THEN NULL ELSE len(list_filter({TONES.format('q')}, lambda i: NOT list_contains({MAJOR}, (root + i - song_id % 12 + 24) % 12))) = 0 END AS diatonic,
         {m4('prob')} AS conf_e4, prob < 0.6 AS low_confidence FROM seg""")
oracle("p7_diatonic_share", "seg", f"""
  SELECT song_id, count(*) AS segments, CAST(sum(beats) AS INT) AS beats,
         {m6("sum(CASE WHEN len(list_filter(" + TONES.format('q') + ", lambda i: NOT list_contains(" + MAJOR + ", (root + i - song_id % 12 + 24) % 12))) = 0 THEN beats ELSE 0 END) / sum(beats)")} AS share_e6
  FROM seg WHERE root IS NOT NULL GROUP BY song_id""")
oracle("p6_user_edits", "cf", f"""
  SELECT c.song_id, c.frame_idx, CASE WHEN c.start_beat + c.beats / 2.0 >= e.s AND c.start_beat + c.beats / 2.0 < e.t THEN
      {NOTES}[c.song_id % 12 + 1] || ':maj' WHEN c.q1 = 'N' THEN 'N' ELSE {NOTES}[c.root1 + 1] || ':' || c.q1 END AS harte
  FROM cf c JOIN (SELECT song_id, min(start_beat) AS s, max(start_beat + beats) AS t FROM cf WHERE frame_idx BETWEEN 5 AND 8 GROUP BY song_id) e
    USING (song_id)""")
oracle("a3_soft_mass", "segc", f"""
  SELECT song_id, seg, root, {m6(f"sum(CASE WHEN {CLS.format('q')} IN ('maj','dom') THEN prob ELSE 0 END)")} AS mass_e6,
         {m6(f"sum(CASE WHEN {CLS.format('q')} IN ('maj','dom') THEN prob ELSE 0 END) / sum(prob)")} AS cond_e6
  FROM segc WHERE root IS NOT NULL GROUP BY song_id, seg, root""")
oracle("a4_run_evidence", "rr ri", f"""
  SELECT r.song_id, r.run, r.root, {m6('r.rp')} AS rp_e6, r.vv.seg AS v_seg, {m6('r.vv.v')} AS v_e6, r.ii.seg AS ii_seg, {m6('r.ii.v')} AS ii_e6
  FROM rr r""")
oracle("a2_bass_vote", "cf fseg", """
  SELECT song_id, seg, CAST(arg_max(pc, v * 100 - pc) AS INT) AS bass_pc, CAST(max(v) * 1000 AS BIGINT) AS votes_e3
  FROM (SELECT c.song_id, f.seg, (root1 + CASE WHEN frame_idx % 4 = 0 THEN 4 ELSE 0 END) % 12 AS pc, sum(beats) AS v
        FROM cf c JOIN fseg f USING (song_id, frame_idx) WHERE root1 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY song_id, seg""")
oracle("w17_marker_sections", "cf", """
  SELECT song_id, sec, min(section) AS label, min(start_beat) AS start, max(start_beat + beats) AS stop FROM (
    SELECT *, CAST(sum(fresh) OVER (PARTITION BY song_id ORDER BY frame_idx) - 1 AS INT) AS sec FROM (
      SELECT *, CASE WHEN lag(section) OVER (PARTITION BY song_id ORDER BY frame_idx) = section THEN 0 ELSE 1 END AS fresh FROM cf))
  GROUP BY song_id, sec""")

# ---------------------------------------------------------------- rules with the given key
_QF = "least(greatest(0.75 + 0.25 * ({0}) - 0.5 * ({1}), 0), 1)"
_SAFE = "CASE WHEN {0}.rp > 0 THEN ({1}) / {0}.rp ELSE 0 END"
_IN = f"list_contains({MAJOR}, ({{0}} - kt + 24) % 12)"


def _best(body: str, cols: str) -> str:
    return (f"SELECT song_id, run, {cols}, {m4('least(greatest(v, 0), 1)')} AS conf_e4 FROM ({body}) WHERE v >= 0.35 "
            f"QUALIFY row_number() OVER (PARTITION BY song_id, run ORDER BY {m4('least(greatest(v, 0), 1)')} DESC, o1, o2, o3) = 1")


cte("r1all", "rr ri", f"""
  SELECT v.song_id, v.run, t.o1, t.o2, t.o3, i7.ii.seg AS s1, rv.vv.seg AS s2, nx.seg_first AS s3, t.root AS target,
    CASE WHEN t.root = v.kt THEN 1 ELSE 0 END AS tonic,
    i7.rp * rv.rp * {_QF.format(_SAFE.format('i7.ii', 'i7.ii.v'), _SAFE.format('i7.ii', 'i7.ii.maj + i7.ii.dom'))}
    * {_QF.format(_SAFE.format('rv.vv', 'rv.vv.v'), _SAFE.format('rv.vv', 'rv.vv.min + rv.vv.dim + rv.vv.hdim'))}
    * t.rp * {_QF.format('t.f_ok', 't.f_bad')}
    * CASE WHEN t.root = v.kt THEN 1.0 WHEN {_IN.format('t.root').replace('kt', 'v.kt')} THEN 0.9 ELSE 0.8 END AS v
  FROM ri v JOIN ri pv ON pv.song_id = v.song_id AND pv.run = v.prev_run JOIN ri nx ON nx.song_id = v.song_id AND nx.run = v.next_run
  JOIN rr t ON t.song_id = v.song_id AND t.run = nx.run AND t.o1 IS NOT NULL
  JOIN rr i7 ON i7.song_id = v.song_id AND i7.run = pv.run AND i7.root = (t.root + 2) % 12 AND i7.rp >= 0.05
  JOIN rr rv ON rv.song_id = v.song_id AND rv.run = v.run AND rv.root = (t.root + 7) % 12 AND rv.rp >= 0.05""")
cte("r1", "r1all", _best("SELECT * FROM r1all", "s1, s2, s3, target, tonic"))
oracle("r1_ii_v_i", "r1", "SELECT song_id, run, s1, s2, s3, target, conf_e4 FROM r1")
cte("r2", "r1 rr ri", _best(f"""
  SELECT *, base * CASE WHEN tonic THEN 1 ELSE chrom END * CASE WHEN status = 'deceptive' THEN 0.75 * p_dec ELSE 0.6 END
         * CASE WHEN tonic THEN 1.0 WHEN {_IN.format('target')} THEN 0.9 ELSE 0.8 END AS v
  FROM (SELECT *, CASE WHEN next_run IS NULL THEN 'end' WHEN p_dec * 0.75 >= 0.6 THEN 'deceptive' ELSE 'unresolved' END AS status
    FROM (SELECT x.*, coalesce(d.rp, 0) AS p_dec FROM (
      SELECT v.song_id, v.run, v.kt, v.next_run, rv.o1, rv.o2, rv.o3, i7.ii.seg AS s1, rv.vv.seg AS s2, (rv.root + 5) % 12 AS target,
        (rv.root + 5) % 12 = v.kt AS tonic,
        {_SAFE.format('i7.ii', 'i7.ii.dim + i7.ii.hdim')} > 0.5 OR {TRIAD}[((rv.root + 5) % 12 - v.kt + 12) % 12 + 1] = 'min' AS minor,
        {_SAFE.format('rv.vv', 'rv.vv.dx')} AS chrom, {_SAFE.format('i7.ii', 'i7.ii.v')} AS iiq,
        i7.rp * rv.rp * {_QF.format(_SAFE.format('i7.ii', 'i7.ii.v'), _SAFE.format('i7.ii', 'i7.ii.maj + i7.ii.dom'))}
        * {_QF.format(_SAFE.format('rv.vv', 'rv.vv.v'), _SAFE.format('rv.vv', 'rv.vv.min + rv.vv.dim + rv.vv.hdim'))} AS base
      FROM ri v JOIN ri pv ON pv.song_id = v.song_id AND pv.run = v.prev_run
      JOIN rr rv ON rv.song_id = v.song_id AND rv.run = v.run AND rv.o1 IS NOT NULL
      JOIN rr i7 ON i7.song_id = v.song_id AND i7.run = pv.run AND i7.root = (rv.root + 7) % 12 AND i7.rp >= 0.05) x
    LEFT JOIN rr d ON d.song_id = x.song_id AND d.run = x.next_run AND d.root = (x.target + CASE WHEN x.minor THEN 8 ELSE 9 END) % 12)
    WHERE NOT (next_run IS NOT NULL AND (
       EXISTS (SELECT 1 FROM rr z WHERE z.song_id = x.song_id AND z.run = x.next_run AND z.root = x.target AND z.rp >= 0.5)
       OR ((x.target + 9) % 12 = x.kt AND EXISTS (SELECT 1 FROM rr z WHERE z.song_id = x.song_id AND z.run = x.next_run AND z.root = x.kt AND z.rp >= 0.5))))
  ) WHERE NOT (tonic AND status = 'deceptive') AND (tonic OR (chrom >= 0.5 AND iiq >= 0.5))
    AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.song_id = song_id AND r1.run = run)""".replace("z.song_id = x.song_id", "z.song_id = y.song_id").replace("z.run = x.next_run", "z.run = y.next_run").replace("z.root = x.target", "z.root = y.target").replace("(x.target + 9) % 12 = x.kt", "(y.target + 9) % 12 = y.kt").replace("z.root = x.kt", "z.root = y.kt").replace("% 12)\n    WHERE NOT", "% 12) y\n    WHERE NOT").replace("AS status\n    FROM (SELECT x.*", "AS status\n    FROM (SELECT x.*").replace("  ) WHERE NOT (tonic", "  ) q WHERE NOT (tonic").replace("r1.song_id = song_id AND r1.run = run", "r1.song_id = q.song_id AND r1.run = q.run"),
    "s1, s2, target, status"))
oracle("r2_ii_v_unresolved", "r2", "SELECT song_id, run, s1, s2, target, status, conf_e4 FROM r2")
_OUT = f"NOT {_IN.format('{0}')}"
cte("r3", "rr ri", _best(f"""
  SELECT *, w * f AS v FROM (SELECT *, CASE WHEN f_res > 0.5 AND f_res >= f_dec THEN 'resolved' WHEN f_dec > 0.5 THEN 'deceptive' ELSE 'unresolved' END AS status,
      greatest(0.5, f_res, f_dec) AS f FROM (
    SELECT c.song_id, c.run, c.kt, o.o1, o.o2, o.o3, o.dw.seg AS s1, (o.root + 5) % 12 AS target, o.dw.v AS w,
      CASE WHEN c.next_run IS NULL THEN -1 ELSE coalesce(a.rp, 0) END AS f_res,
      CASE WHEN c.next_run IS NULL THEN -1 ELSE 0.75 * coalesce(b.rp, 0) END AS f_dec
    FROM ri c JOIN rr o ON o.song_id = c.song_id AND o.run = c.run AND o.o1 IS NOT NULL AND o.dw.v > 0
    LEFT JOIN rr a ON a.song_id = c.song_id AND a.run = c.next_run AND a.root = (o.root + 5) % 12
    LEFT JOIN rr b ON b.song_id = c.song_id AND b.run = c.next_run
         AND b.root = (o.root + CASE WHEN {TRIAD}[((o.root + 5) % 12 - c.kt + 12) % 12 + 1] = 'min' THEN 1 ELSE 2 END) % 12
    WHERE (o.root - c.kt + 12) % 12 <> 7 AND {TRIAD}[((o.root + 5) % 12 - c.kt + 12) % 12 + 1] <> 'dim'))
  WHERE NOT (status = 'unresolved' AND {_OUT.format('target')})""", "s1, target, status"))
oracle("r3_secondary_dominant", "r3", "SELECT song_id, run, s1, target, status, conf_e4 FROM r3")
cte("r4", "rr ri", _best(f"""
  SELECT c.song_id, c.run, o.o1, o.o2, o.o3, o.lt.seg AS s1, (o.root + 1) % 12 AS target, o.lt.v * t.rp AS v
  FROM ri c JOIN rr o ON o.song_id = c.song_id AND o.run = c.run AND o.o1 IS NOT NULL AND o.lt.v > 0
  JOIN rr t ON t.song_id = c.song_id AND t.run = c.next_run AND t.root = (o.root + 1) % 12 AND t.rp > 0
  WHERE {_OUT.format('o.root').replace('- kt', '- c.kt')} AND {TRIAD}[((o.root + 1) % 12 - c.kt + 12) % 12 + 1] <> 'dim'""", "s1, target"))
oracle("r4_leading_tone", "r4", "SELECT song_id, run, s1, target, conf_e4 FROM r4")
cte("r5", "rr ri", _best(f"""
  SELECT c.song_id, c.run, o.o1, o.o2, o.o3, o.tt.seg AS s1, t.root AS target, coalesce(p.pre_ii2 >= 0.5, false) AS by_ii,
    o.tt.v * t.rp * CASE WHEN t.root = c.kt THEN 1.0 WHEN {TRIAD}[(t.root - c.kt + 12) % 12 + 1] NOT IN ('-', 'dim') THEN 0.9 ELSE 0.75 END AS v
  FROM ri c JOIN rr o ON o.song_id = c.song_id AND o.run = c.run AND o.o1 IS NOT NULL AND o.tt.v > 0
  JOIN rr t ON t.song_id = c.song_id AND t.run = c.next_run AND t.root = (o.root + 11) % 12 AND t.rp > 0
  LEFT JOIN rr p ON p.song_id = c.song_id AND p.run = c.prev_run AND p.root = (t.root + 2) % 12""", "s1, target, by_ii"))
oracle("r5_tritone_substitution", "r5", "SELECT song_id, run, s1, target, by_ii, conf_e4 FROM r5")
_ENTRIES = ("(VALUES (0,5,'iv','min',true),(1,8,'♭VI','maj',false),(2,10,'♭VII','maj',false),(3,10,'♭VII7','dom',false),"
            "(4,3,'♭III','maj',false),(5,2,'iiø7','hd',true),(6,7,'v','min',true),(7,0,'i','min',true),"
            "(8,1,'♭II','maj',false),(9,8,'♭VI7','dom',false)) e(no, degree, entry, cls, required)")
_XM = "CASE e.cls WHEN 'min' THEN m.xmin WHEN 'maj' THEN m.xmaj WHEN 'dom' THEN m.xdom ELSE m.xhdim + m.xdim END"
cte("r6", "mass ri rr", _best(f"""
  SELECT song_id, run, no AS o1, 0 AS o2, 0 AS o3, entry, arg_max(seg, tie) AS s1, max(val) AS v FROM (
    SELECT *, floor(val * 1e9 + 0.5) * 1000 + CASE WHEN required THEN seg ELSE -seg END AS tie FROM (
      SELECT m.song_id, m.run, m.seg, e.no, e.entry, e.required,
        CASE WHEN e.required THEN {_XM} ELSE (m.xmaj + m.xmin + m.xdom + m.xdim + m.xhdim) * greatest(0.6 + 0.4 * ({_XM}) / m.rp
             - 0.5 * (m.min + m.dim + m.hdim) / m.rp, 0) END AS val
      FROM mass m JOIN {_ENTRIES} ON m.root = (m.kt + e.degree) % 12
      JOIN rr r ON r.song_id = m.song_id AND r.run = m.run AND r.root = m.root AND r.rp >= 0.05 WHERE m.rp > 0))
  GROUP BY song_id, run, no, entry""", "entry, s1"))
oracle("r6_borrowed_chords", "r6", "SELECT song_id, run, entry, s1, conf_e4 FROM r6")
oracle("r7_aeolian_cadence", "rr ri", _best(f"""
  SELECT c.song_id, c.run, 0 AS o1, 0 AS o2, 0 AS o3, a.md.seg AS s1, b.md.seg AS s2, c.seg_first AS s3,
    CASE WHEN a.rp * b.rp * o.rp < 0.05 THEN 0 ELSE a.rp * b.rp * o.rp
    * {_QF.format(_SAFE.format('a.md', 'a.md.v'), _SAFE.format('a.md', 'a.md.min + a.md.dim + a.md.hdim'))}
    * {_QF.format(_SAFE.format('b.md', 'b.md.v'), _SAFE.format('b.md', 'b.md.min + b.md.dim + b.md.hdim'))}
    * {_QF.format('o.f_maj', 'o.f_bad')} END AS v
  FROM ri c JOIN ri p ON p.song_id = c.song_id AND p.run = c.prev_run
  JOIN rr o ON o.song_id = c.song_id AND o.run = c.run AND o.root = c.kt
  JOIN rr b ON b.song_id = c.song_id AND b.run = c.prev_run AND b.root = (c.kt + 10) % 12
  JOIN rr a ON a.song_id = c.song_id AND a.run = p.prev_run AND a.root = (c.kt + 8) % 12""", "s1, s2, s3"))
cte("r8", "rr ri", _best(f"""
  SELECT song_id, run, no AS o1, 0 AS o2, 0 AS o3, name, s1, s2, pv * pt * q * prep AS v FROM (
  SELECT c.song_id, c.run, e.no, e.name, v.md.seg AS s1, n.seg_first AS s2, v.md.v AS pv, t.rp AS pt,
    {_QF.format("CASE WHEN e.name = 'vi' THEN t.f_min ELSE t.f_maj END", 't.f_bad')} AS q,
    CASE WHEN coalesce(p2.pre_ii, 0) >= 0.5 THEN 1.0 WHEN coalesce(p5.pre_iv, 0) >= 0.5 AND v.md.sev / v.md.rp >= 0.5 THEN 0.8
         WHEN coalesce(p5.pre_iv, 0) >= 0.5 THEN 0.5 WHEN v.md.sev / v.md.rp >= 0.5 THEN 0.8 END AS prep
  FROM ri c JOIN ri n ON n.song_id = c.song_id AND n.run = c.next_run
  JOIN (VALUES (0, 'vi', 9), (1, '♭VI', 8)) e(no, name, step) ON true
  JOIN rr v ON v.song_id = c.song_id AND v.run = c.run AND v.root = (c.kt + 7) % 12 AND v.md.v >= 0.05
  JOIN rr t ON t.song_id = c.song_id AND t.run = n.run AND t.root = (c.kt + e.step) % 12 AND t.rp >= 0.05
  LEFT JOIN rr p2 ON p2.song_id = c.song_id AND p2.run = c.prev_run AND p2.root = (c.kt + 2) % 12
  LEFT JOIN rr p5 ON p5.song_id = c.song_id AND p5.run = c.prev_run AND p5.root = (c.kt + 5) % 12) WHERE prep IS NOT NULL""", "name, s1, s2"))
oracle("r8_deceptive_cadence", "r8", "SELECT song_id, run, name, s1, s2, conf_e4 FROM r8")

# ---------------------------------------------------------------- keys
def _fit_values() -> str:
    from cadenza.theory import FIT
    rows = [f"('{mode}',{d},'{c}',{v})" for (mode, d), row in FIT.items() for c, v in row.items()]
    return f"(VALUES {','.join(rows)}) f(mode, degree, cls, fit)"


_ADDED = "CASE c.q WHEN 'maj7' THEN 11 WHEN 'min7' THEN 10 END"
cte("key24", "", "SELECT k, k % 12 AS tonic, CASE WHEN k < 12 THEN 'major' ELSE 'minor' END AS mode FROM (SELECT unnest(range(24)) AS k)")
cte("fitted", "key24", f"""
  SELECT k, root, q, coalesce(fit, -4) - CASE WHEN added IS NOT NULL AND NOT list_contains(CASE WHEN x.mode = 'major' THEN {MAJOR} ELSE {MINOR} END,
           (root + added - tonic + 24) % 12) THEN 0.6 ELSE 0 END AS fit
  FROM (SELECT key24.*, r.root, c.q, {CLS.format('c.q')} AS cls, {_ADDED} AS added FROM key24,
          (SELECT unnest(range(12)) AS root) r, (SELECT unnest(['maj','min','dim','7','maj7','min7','hdim7']) AS q) c) x
  LEFT JOIN {_fit_values()} ON f.mode = x.mode AND f.degree = (x.root - x.tonic + 12) % 12 AND f.cls = x.cls""")
oracle("f16_chord_key_fit", "segc fitted", f"""
  SELECT DISTINCT f.k AS key_idx, f.root, f.q AS quality, CAST(round(fit * 10) AS INT) AS fit_e1 FROM fitted f JOIN segc c ON c.root = f.root AND c.q = f.q""")
cte("em", "segc seg fitted", f"""
  SELECT s.song_id, s.seg, s.k, CASE WHEN s.rooted = 0 THEN 0 ELSE s.w * s.e + coalesce(p.dom, 0) * s.ton END
         + CASE WHEN s.seg = min(CASE WHEN s.rooted = 1 THEN s.seg END) OVER (PARTITION BY s.song_id)
                  OR s.seg = max(CASE WHEN s.rooted = 1 THEN s.seg END) OVER (PARTITION BY s.song_id) THEN 3 * s.ton ELSE 0 END AS e
  FROM (SELECT g.song_id, g.seg, f.k, least(greatest(min(g.beats) / 4.0, 0.25), 2.0) AS w, max(CASE WHEN c.root IS NULL THEN 0 ELSE 1 END) AS rooted,
          ln(sum(c.prob * exp(f.fit)) / sum(c.prob)) - CASE WHEN f.k >= 12 THEN 0.1 ELSE 0 END AS e,
          sum(CASE WHEN c.root = f.k % 12 AND {CLS.format('c.q')} = CASE WHEN f.k < 12 THEN 'maj' ELSE 'min' END THEN c.prob ELSE 0 END) AS ton
        FROM seg g JOIN segc c USING (song_id, seg) JOIN (SELECT * FROM fitted UNION ALL SELECT k, NULL, 'N', 0 FROM key24) f
          ON f.q = c.q AND f.root IS NOT DISTINCT FROM c.root GROUP BY g.song_id, g.seg, f.k) s
  LEFT JOIN (SELECT song_id, seg, k, sum(CASE WHEN c.root = (k + 7) % 12 THEN CASE {CLS.format('c.q')} WHEN 'dom' THEN c.prob WHEN 'maj' THEN 0.3 * c.prob ELSE 0 END ELSE 0 END) AS dom
             FROM segc c, key24 GROUP BY song_id, seg, k) p ON p.song_id = s.song_id AND p.seg = s.seg - 1 AND p.k = s.k""")
oracle("a5_key_emissions", "em", f"SELECT song_id, seg, k AS key_idx, {m6('e')} AS e_e6 FROM em")
cte("ev", "em", "SELECT song_id, seg, list(e ORDER BY k) AS e, max(seg) OVER (PARTITION BY song_id) AS last FROM em GROUP BY song_id, seg")
_TOP = "list_position(list_transform(v.s, lambda x: x >= list_max(v.s) - 1e-9), true)"
cte("rec_vit", "ev", f"""
  SELECT song_id, seg, e AS s, CAST(NULL AS INT[]) AS bp FROM ev WHERE seg = 0
  UNION ALL
  SELECT n.song_id, n.seg,
    list_transform(range(24), lambda k: CASE WHEN v.s[k + 1] >= list_max(v.s) - 6 - 1e-9 THEN v.s[k + 1] ELSE list_max(v.s) - 6 END + n.e[k + 1]),
    list_transform(range(24), lambda k: CAST(CASE WHEN v.s[k + 1] >= v.s[{_TOP}] - 6 - 1e-9 THEN k ELSE {_TOP} - 1 END AS INT))
  FROM rec_vit v JOIN ev n ON n.song_id = v.song_id AND n.seg = v.seg + 1""")
cte("vit", "rec_vit", "SELECT * FROM rec_vit")
cte("rec_path", "vit ev", """
  SELECT v.song_id, v.seg, list_position(list_transform(v.s, lambda x: x >= list_max(v.s) - 1e-9), true) - 1 AS k
  FROM vit v JOIN (SELECT song_id, max(seg) AS last FROM ev GROUP BY song_id) z ON z.song_id = v.song_id AND v.seg = z.last
  UNION ALL
  SELECT p.song_id, p.seg - 1, CAST(v.bp[p.k + 1] AS BIGINT) FROM rec_path p JOIN vit v ON v.song_id = p.song_id AND v.seg = p.seg WHERE p.seg > 0""")
oracle("w6_key_path", "rec_path", "SELECT song_id, seg, CAST(k AS INT) AS path_idx FROM rec_path")
_LSE = "list_max({0}) + ln(list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"
_MIX = ("list_max({0}) + ln((1 - exp(-6)) * exp({0}[k + 1] - list_max({0})) + exp(-6) * list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))")
cte("rec_alpha", "ev", f"""
  SELECT song_id, seg, e AS a FROM ev WHERE seg = 0 UNION ALL
  SELECT n.song_id, n.seg, list_transform(range(24), lambda k: {_MIX.format('v.a')} + n.e[k + 1])
  FROM rec_alpha v JOIN ev n ON n.song_id = v.song_id AND n.seg = v.seg + 1""")
cte("rec_beta", "ev", f"""
  SELECT song_id, max(seg) AS seg, list_transform(range(24), lambda k: 0.0::DOUBLE) AS b FROM ev GROUP BY song_id UNION ALL
  SELECT song_id, seg - 1, list_transform(range(24), lambda k: {_MIX.format('x')})
  FROM (SELECT v.song_id, v.seg, list_transform(range(24), lambda k: v.b[k + 1] + n.e[k + 1]) AS x
        FROM rec_beta v JOIN ev n ON n.song_id = v.song_id AND n.seg = v.seg WHERE v.seg > 0)""")
cte("post", "rec_alpha rec_beta", f"""
  SELECT song_id, seg, list_transform(g, lambda y: exp(y - z)) AS p FROM (SELECT *, {_LSE.format('g')} AS z FROM (
    SELECT a.song_id, a.seg, list_transform(range(24), lambda k: a.a[k + 1] + b.b[k + 1]) AS g
    FROM rec_alpha a JOIN rec_beta b ON b.song_id = a.song_id AND b.seg = a.seg))""")
oracle("w7_key_posteriors", "post", f"""
  SELECT song_id, seg, CAST(k AS INT) AS key_idx, {m4('p[k + 1]')} AS p_e4 FROM post, (SELECT unnest(range(24)) AS k)""")
cte("gmass", "post seg", """
  SELECT song_id, k, sum(p[k + 1] * beats) / sum(beats) AS m, sum(beats) AS beats FROM post JOIN seg USING (song_id, seg), (SELECT unnest(range(24)) AS k)
  WHERE root IS NOT NULL GROUP BY song_id, k""")
oracle("a6_global_key", "gmass", f"""
  SELECT song_id, CAST(rank AS INT) AS rank, CAST(k AS INT) AS key_idx, {m4('m')} AS p_e4 FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY m DESC, k) - 1 AS rank FROM gmass) WHERE rank < 1""")
oracle("t4_alternative_keys", "gmass", f"""
  SELECT song_id, CAST(rank AS INT) AS rank, CAST(k AS INT) AS key_idx, {m4('m')} AS p_e4 FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY m DESC, k) - 1 AS rank FROM gmass) WHERE rank BETWEEN 1 AND 3""")
oracle("a7_ambiguity", "post seg", """
  SELECT song_id, sum(CASE WHEN h[2] >= 0.75 * h[1] THEN beats ELSE 0 END) * 1.0 / sum(beats) > 0.5 AS ambiguous
  FROM (SELECT song_id, beats, list_reverse_sort(p) AS h FROM post JOIN seg USING (song_id, seg) WHERE root IS NOT NULL) GROUP BY song_id""")
cte("pathreg", "rec_path", """
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY song_id ORDER BY seg) - 1 AS INT) AS region FROM (
    SELECT *, CASE WHEN seg > 0 AND lag(k) OVER (PARTITION BY song_id ORDER BY seg) = k THEN 0 ELSE 1 END AS fresh FROM rec_path)""")
oracle("a8_path_regions", "pathreg seg post", f"""
  SELECT r.song_id, r.region, CAST(min(r.k) AS INT) AS key_idx, min(r.seg) AS seg_first, max(r.seg) + 1 AS seg_until, min(s.start) AS start, max(s.stop) AS stop,
         {m4('avg(p.p[r.k + 1])')} AS p_e4
  FROM pathreg r JOIN seg s USING (song_id, seg) JOIN post p USING (song_id, seg) GROUP BY r.song_id, r.region""")
oracle("w4_cadence_bonus", "segc seg key24", f"""
  SELECT s.song_id, s.seg, CAST(s.k AS INT) AS key_idx, {m6('p.dom * s.ton')} AS bonus_e6 FROM (
    SELECT song_id, seg, k, sum(CASE WHEN root = k % 12 AND {CLS.format('q')} = CASE WHEN k < 12 THEN 'maj' ELSE 'min' END THEN prob ELSE 0 END) AS ton FROM segc, key24 GROUP BY 1, 2, 3) s
  JOIN (SELECT song_id, seg, k, sum(CASE WHEN root = (k + 7) % 12 THEN CASE {CLS.format('q')} WHEN 'dom' THEN prob WHEN 'maj' THEN 0.3 * prob ELSE 0 END ELSE 0 END) AS dom FROM segc, key24 GROUP BY 1, 2, 3) p
    ON p.song_id = s.song_id AND p.k = s.k AND p.seg = s.seg - 1 WHERE p.dom * s.ton > 0""")
oracle("w5_boundary_segments", "seg", """
  SELECT song_id, min(seg) AS first_seg, max(seg) AS last_seg FROM seg WHERE root IS NOT NULL GROUP BY song_id""")
oracle("r9_modulations", "pathreg post", f"""
  SELECT a.song_id, a.region AS run, CAST(a.k AS INT) AS old_idx, CAST(b.k AS INT) AS new_idx, b.lo AS cut,
     {m4('(SELECT avg(p[a.k + 1]) FROM post p WHERE p.song_id = a.song_id AND p.seg BETWEEN greatest(a.lo, a.hi - 3) AND a.hi) * (SELECT avg(p[b.k + 1]) FROM post p WHERE p.song_id = a.song_id AND p.seg BETWEEN b.lo AND least(b.hi, b.lo + 3))')} AS conf_e4
  FROM (SELECT song_id, region, min(k) AS k, min(seg) AS lo, max(seg) AS hi FROM pathreg GROUP BY 1, 2) a
  JOIN (SELECT song_id, region, min(k) AS k, min(seg) AS lo, max(seg) AS hi FROM pathreg GROUP BY 1, 2) b ON b.song_id = a.song_id AND b.region = a.region + 1""")

# ---------------------------------------------------------------- named progressions
def _patterns() -> tuple[str, str]:
    from cadenza.params import progression_entries
    opts, sets = [], []
    for i in progression_entries():
        for n, p in enumerate(i["positions"]):
            for o, d in enumerate(p["degrees"]):
                opts.append(f"({i['idiom']},{n},{o if n else 0},{d if n == 0 else -1},{d})")
            cls = "NULL" if p["classes"] is None else "[" + ",".join(f"'{c}'" for c in p["classes"]) + "]"
            bass = "NULL" if p["bass"] is None else "[" + ",".join(map(str, p["bass"])) + "]"
            sets.append(f"({i['idiom']},{n},{cls},{bass},{i['min_length']},'{i['name']}',{str(i['use_key_prior']).lower()})")
    return (f"(VALUES {','.join(opts)}) o(idiom, pos, opt, head, degree)",
            f"(VALUES {','.join(sets)}) p(idiom, pos, cls, bass, least, name, prior)")


_OPTS, _SETS = _patterns()
_IN_SET = lambda t: "(" + " + ".join(f"CASE WHEN list_contains({t}, '{c}') THEN m.{c} ELSE 0 END" for c in ("maj", "min", "dom", "dim", "hdim")) + ")"
_NOT_SET = "(" + " + ".join(f"CASE WHEN list_contains(p.cls, '{c}') THEN 0 ELSE m.{c} END" for c in ("maj", "min", "dom", "dim", "hdim")) + ")"
cte("rroot", "mass", "SELECT song_id, run, root, max(rp) AS rp, max(seg_last) AS seg_last FROM mass GROUP BY song_id, run, root")
cte("bshare", "segc srun", """
  SELECT s.song_id, s.run, s.seg, c.root, sum(c.prob) / max(t.tot) AS share FROM srun s JOIN segc c USING (song_id, seg)
  JOIN (SELECT song_id, seg, sum(prob) AS tot FROM segc WHERE root IS NOT NULL GROUP BY song_id, seg) t USING (song_id, seg)
  WHERE c.root IS NOT NULL GROUP BY s.song_id, s.run, s.seg, c.root""")
cte("posroot", "rroot run", f"""
  SELECT r.song_id, r.run, r.root AS run_root, r.seg_last, r.state, o.idiom, o.pos, o.head, t.tonic, least(1.0, sum(coalesce(x.rp, 0))) AS p_root,
         arg_max(o.degree, coalesce(x.rp, 0) * 1000 - o.opt * 1e-6) AS deg
  FROM (SELECT * FROM run WHERE root IS NOT NULL) r, {_OPTS}, (SELECT unnest(range(12)) AS tonic) t
  LEFT JOIN rroot x ON x.song_id = r.song_id AND x.run = r.run AND x.root = (t.tonic + o.degree) % 12
  WHERE CASE WHEN o.pos = 0 THEN (r.root - o.degree + 12) % 12 = t.tonic ELSE r.state = 'use' END
  GROUP BY r.song_id, r.run, r.root, r.seg_last, r.state, o.idiom, o.pos, o.head, t.tonic""")
cte("posbass", "bshare", f"""
  SELECT song_id, run, idiom, pos, tonic, max(share) AS bass FROM (
    SELECT b.song_id, b.run, b.seg, p.idiom, p.pos, t.tonic, sum(b.share) AS share
    FROM bshare b, (SELECT *, unnest(bass) AS b1 FROM {_SETS} WHERE bass IS NOT NULL) p, (SELECT unnest(range(12)) AS tonic) t
    WHERE b.root = (t.tonic + p.b1) % 12 GROUP BY ALL) GROUP BY song_id, run, idiom, pos, tonic""")
cte("posq", "posroot mass", f"""
  SELECT x.song_id, x.run, x.idiom, x.pos, x.head, x.tonic,
         arg_max(m.seg, floor({_IN_SET('p.cls')} * 1e9 + 0.5) * 1000 + m.seg) AS seg,
         arg_max(greatest(0.75 + 0.25 * CASE WHEN m.rp > 0 THEN {_IN_SET('p.cls')} / m.rp ELSE 0 END
                 - 0.5 * CASE WHEN m.rp > 0 THEN {_NOT_SET} / m.rp ELSE 0 END, 0), floor({_IN_SET('p.cls')} * 1e9 + 0.5) * 1000 + m.seg) AS q
  FROM posroot x JOIN {_SETS} ON p.idiom = x.idiom AND p.pos = x.pos AND p.cls IS NOT NULL
  JOIN mass m ON m.song_id = x.song_id AND m.run = x.run AND m.root = (x.tonic + x.deg) % 12 WHERE x.p_root >= 0.3
  GROUP BY x.song_id, x.run, x.idiom, x.pos, x.head, x.tonic""")
cte("posany", "mass", "SELECT song_id, run, root, arg_max(seg, floor(rp * 1e9 + 0.5) * 1000 + seg) AS seg FROM mass GROUP BY song_id, run, root")
cte("posf", "posroot posbass posq posany", f"""
  SELECT * FROM (
    SELECT x.song_id, x.run, x.idiom, x.pos, x.tonic, x.deg, p.least, p.name, p.prior,
      CASE WHEN p.cls IS NULL THEN coalesce(a.seg, x.seg_last) ELSE coalesce(q.seg, x.seg_last) END AS seg,
      CASE WHEN p.bass IS NULL THEN x.p_root ELSE coalesce(b.bass, 0) * (0.75 + 0.25 * x.p_root) END
      * CASE WHEN p.cls IS NULL THEN 1 ELSE coalesce(q.q, 0.75) END AS f
    FROM posroot x JOIN {_SETS} ON p.idiom = x.idiom AND p.pos = x.pos
    LEFT JOIN posq q ON q.song_id = x.song_id AND q.run = x.run AND q.idiom = x.idiom AND q.pos = x.pos AND q.head = x.head AND q.tonic = x.tonic
    LEFT JOIN posbass b ON b.song_id = x.song_id AND b.run = x.run AND b.idiom = x.idiom AND b.pos = x.pos AND b.tonic = x.tonic
    LEFT JOIN posany a ON a.song_id = x.song_id AND a.run = x.run AND a.root = (x.tonic + x.deg) % 12) WHERE f >= 0.3""")
cte("rec_walk", "posf nav", """
  SELECT p.song_id, p.run AS head, p.idiom, p.tonic, p.pos, p.run, ln(p.f) AS s, [p.seg] AS segs, [p.run] AS runs, p.least, p.name, p.prior, p.deg AS d0, p.deg AS d1
  FROM posf p WHERE p.pos = 0
  UNION ALL
  SELECT w.song_id, w.head, w.idiom, w.tonic, p.pos, p.run, w.s + ln(p.f), list_append(w.segs, p.seg), list_append(w.runs, p.run), w.least, w.name, w.prior, w.d0, p.deg
  FROM rec_walk w JOIN nav n ON n.song_id = w.song_id AND n.run = w.run
  JOIN posf p ON p.song_id = w.song_id AND p.run = n.next_run AND p.idiom = w.idiom AND p.tonic = w.tonic AND p.pos = w.pos + 1""")
cte("match0", "rec_walk", f"""
  SELECT *, {m4('exp(s / len(segs))')} AS conf FROM rec_walk
  QUALIFY row_number() OVER (PARTITION BY song_id, head, idiom, tonic ORDER BY pos DESC) = 1 AND len(segs) >= least AND exp(s / len(segs)) >= 0.35""")
oracle("r10_progression_matches", "match0", "SELECT song_id, name, idiom, tonic, head AS run, array_to_string(segs, '-') AS segs, conf AS conf_e4 FROM match0")
cte("mord", "match0", "SELECT *, row_number() OVER (PARTITION BY song_id, name ORDER BY -len(segs), -conf, segs[1], idiom, head, tonic) AS rn FROM match0")
cte("rec_keep", "mord", """
  SELECT song_id, name, rn, segs AS used, true AS keep FROM mord WHERE rn = 1 UNION ALL
  SELECT k.song_id, k.name, m.rn, CASE WHEN list_has_any(k.used, m.segs) THEN k.used ELSE list_concat(k.used, m.segs) END, NOT list_has_any(k.used, m.segs)
  FROM rec_keep k JOIN mord m ON m.song_id = k.song_id AND m.name = k.name AND m.rn = k.rn + 1""")
cte("kept", "rec_keep mord", "SELECT m.* FROM mord m JOIN rec_keep k USING (song_id, name, rn) WHERE k.keep")
oracle("r11_kept_progressions", "kept", "SELECT song_id, name, tonic, array_to_string(segs, '-') AS segs, conf AS conf_e4 FROM kept")
oracle("r12_loop_segments", "kept nav rroot", """
  SELECT DISTINCT r.song_id, CAST(unnest(range(n.seg_first, n.seg_last + 1)) AS INT) AS seg FROM (
    SELECT song_id, unnest(runs) AS run FROM kept
    UNION SELECT k.song_id, x.run FROM kept k JOIN nav n ON n.song_id = k.song_id AND n.run = k.runs[-1]
      JOIN rroot x ON x.song_id = k.song_id AND x.run = n.next_run AND x.root = (k.tonic + k.d0) % 12 AND x.rp >= 0.5
    UNION SELECT k.song_id, x.run FROM kept k JOIN nav n ON n.song_id = k.song_id AND n.run = k.runs[1]
      JOIN rroot x ON x.song_id = k.song_id AND x.run = n.prev_run AND x.root = (k.tonic + k.d1) % 12 AND x.rp >= 0.5) r
  JOIN nav n ON n.song_id = r.song_id AND n.run = r.run""")
oracle("r13_key_prior", "kept nav", f"""
  SELECT song_id, seg, key_idx, max(conf) * 15 AS bonus_e5 FROM (
    SELECT k.song_id, CAST(unnest(range(n.seg_first, n.seg_last + 1)) AS INT) AS seg, CAST(k.tonic AS INT) AS key_idx, k.conf
    FROM (SELECT *, unnest(runs) AS r1 FROM kept WHERE prior) k JOIN nav n ON n.song_id = k.song_id AND n.run = k.r1) GROUP BY song_id, seg, key_idx""")

# ---------------------------------------------------------------- functions
oracle("f1_label_dimension", "cand", f"""
  SELECT DISTINCT harte AS label, harte, root, q AS quality, {CLS.format('q')} AS qclass, q IN ('7','maj7','min7','hdim7') AS has_seventh,
         coalesce(len({TONES.format('q')}), 0) AS tones FROM cand""")
oracle("f15_key_changes", "cf", f"""
  SELECT song_id, frame_idx, 'whole step up' AS change, {KEYS}[tonic + 1] AS new_key FROM (
    SELECT *, lag(tonic) OVER (PARTITION BY song_id ORDER BY frame_idx) AS b FROM cf) WHERE b <> tonic""")
ORACLES["f14_song_split"] = """
  SELECT song_id, CASE WHEN h % 100 < 60 THEN 'dev' ELSE 'test' END AS split, h AS hash FROM (
    SELECT song_id, list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', substr(s, CAST(i AS INT), 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS h
    FROM (SELECT DISTINCT user_id AS song_id, sha256(CAST(user_id AS VARCHAR)) AS s FROM events))"""

# ---------------------------------------------------------------- evaluation
for _px, _n, _id in (("r_", "gold", "gold_id"), ("e_", "pred", "pred_id"), ("", "soft", "pred_id")):
    cte(f"sp_{_n}", f"{_px}seg", f"SELECT song_id, seg AS {_id}, {CLS.format('q')} AS type, start, stop, harte AS label, (first_frame * 37 % 100) / 100.0 AS confidence "
        f"FROM {_px}seg WHERE root IS NOT NULL")
oracle("j4_overlaps", "r_seg e_seg", """
  SELECT a.song_id, a.seg AS ref_seg, b.seg AS est_seg, CAST(least(a.stop, b.stop) - greatest(a.start, b.start) AS INT) AS w
  FROM r_seg a JOIN e_seg b ON a.song_id = b.song_id AND a.start < b.stop AND b.start < a.stop""")
oracle("j5_point_lookup", "r_seg e_seg", """
  SELECT b.song_id, b.seg AS est_seg, a.seg AS ref_seg FROM e_seg b LEFT JOIN r_seg a
    ON a.song_id = b.song_id AND a.start <= (b.start + b.stop) / 2.0 AND (b.start + b.stop) / 2.0 < a.stop""")
oracle("j6_nearest_start", "r_seg e_seg", """
  SELECT song_id, est_seg, ref_seg FROM (SELECT b.song_id, b.seg AS est_seg, a.seg AS ref_seg,
    row_number() OVER (PARTITION BY b.song_id, b.seg ORDER BY abs(a.start - b.start - 0.5), a.seg) AS rn FROM e_seg b JOIN r_seg a ON a.song_id = b.song_id) WHERE rn = 1""")
for _n in ("pred", "soft"):
    cte(f"mc_{_n}", f"sp_gold sp_{_n}", f"""
      SELECT song_id, type, gold_id, pred_id, confidence, q FROM (
        SELECT g.song_id, g.type, g.gold_id, p.pred_id, p.confidence, (least(g.stop, p.stop) - greatest(g.start, p.start)) * 1.0 / least(g.stop - g.start, p.stop - p.start) AS q
        FROM sp_gold g JOIN sp_{_n} p ON p.song_id = g.song_id AND p.type = g.type AND p.start < g.stop AND g.start < p.stop) WHERE q >= 0.5""")
    cte(f"po_{_n}", f"mc_{_n}", f"""
      SELECT *, row_number() OVER (PARTITION BY song_id, type ORDER BY confidence DESC, pred_id) AS rn FROM (
        SELECT song_id, type, pred_id, max(confidence) AS confidence, list(gold_id ORDER BY q DESC, gold_id) AS golds FROM mc_{_n} GROUP BY song_id, type, pred_id)""")
    cte(f"rec_{_n}", f"po_{_n}", f"""
      SELECT song_id, type, rn, pred_id, golds[1] AS gold_id, [golds[1]] AS used FROM po_{_n} WHERE rn = 1
      UNION ALL
      SELECT r.song_id, r.type, p.rn, p.pred_id, list_filter(p.golds, lambda g: NOT list_contains(r.used, g))[1],
             list_concat(r.used, list_filter(p.golds, lambda g: NOT list_contains(r.used, g))[1:1])
      FROM rec_{_n} r JOIN po_{_n} p ON p.song_id = r.song_id AND p.type = r.type AND p.rn = r.rn + 1""")
    cte(f"pairs_{_n}", f"rec_{_n}", f"SELECT song_id, type, gold_id, pred_id FROM rec_{_n} WHERE gold_id IS NOT NULL")
oracle("j8_match_candidates", "mc_pred", f"SELECT song_id, gold_id, pred_id, {m6('q')} AS q_e6 FROM mc_pred")
oracle("j9_greedy_matches", "pairs_pred", "SELECT song_id, gold_id, pred_id FROM pairs_pred")
oracle("j10_missed_gold", "pairs_pred sp_gold", """
  SELECT song_id, gold_id, type FROM sp_gold g WHERE NOT EXISTS (SELECT 1 FROM pairs_pred p WHERE p.song_id = g.song_id AND p.gold_id = g.gold_id)""")
cte("esc", "pairs_pred sp_gold sp_pred", """
  SELECT song_id, type, count(t) AS tp, count(g) AS n_gold, count(p) AS n_pred, count(h) AS hits FROM (
    SELECT song_id, type, NULL AS t, 1 AS g, NULL AS p, NULL AS h FROM sp_gold UNION ALL SELECT song_id, type, NULL, NULL, 1, NULL FROM sp_pred
    UNION ALL SELECT m.song_id, m.type, 1, NULL, NULL, CASE WHEN g.label = p.label THEN 1 END FROM pairs_pred m
      JOIN sp_gold g ON g.song_id = m.song_id AND g.gold_id = m.gold_id JOIN sp_pred p ON p.song_id = m.song_id AND p.pred_id = m.pred_id)
  GROUP BY GROUPING SETS ((song_id, type), (song_id))""")
oracle("a11_event_scores", "esc", f"""
  SELECT song_id, coalesce(type, 'all') AS type, tp, n_gold, n_pred,
    {m6("CASE WHEN n_gold > 0 AND n_pred > 0 THEN CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (n_gold + n_pred) END END")} AS f1_e6,
    {m6("CASE WHEN tp > 0 THEN hits * 1.0 / tp END")} AS acc_e6 FROM esc""")
oracle("a12_corpus_event_scores", "esc", f"""
  SELECT coalesce(type, 'all') AS type, count(*) AS songs, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred,
    {m6('sum(tp) * 1.0 / nullif(sum(n_pred), 0)')} AS p_e6, {m6('sum(tp) * 1.0 / nullif(sum(n_gold), 0)')} AS r_e6 FROM esc GROUP BY type""")
oracle("a14_error_attribution", "sp_gold sp_soft sp_pred pairs_soft pairs_pred", """
  SELECT song_id, category, count(*) AS n FROM (
    SELECT g.song_id, CASE WHEN o AND s THEN 'ok' WHEN o THEN 'recognition_miss' WHEN s THEN 'analysis_miss_but_system_hit' ELSE 'analysis_miss' END AS category
    FROM (SELECT g.*, EXISTS (SELECT 1 FROM pairs_soft x WHERE x.song_id = g.song_id AND x.gold_id = g.gold_id) AS o,
                 EXISTS (SELECT 1 FROM pairs_pred x WHERE x.song_id = g.song_id AND x.gold_id = g.gold_id) AS s FROM sp_gold g) g
    UNION ALL
    SELECT f.song_id, CASE WHEN EXISTS (SELECT 1 FROM sp_soft o WHERE o.song_id = f.song_id AND o.type = f.type
        AND NOT EXISTS (SELECT 1 FROM pairs_soft x WHERE x.song_id = o.song_id AND x.pred_id = o.pred_id)
        AND (least(o.stop, f.stop) - greatest(o.start, f.start)) * 1.0 / least(o.stop - o.start, f.stop - f.start) >= 0.5) THEN 'analysis_fp' ELSE 'recognition_fp' END
    FROM sp_pred f WHERE NOT EXISTS (SELECT 1 FROM pairs_pred x WHERE x.song_id = f.song_id AND x.pred_id = f.pred_id)) GROUP BY song_id, category""")
cte("tspan", "cf", """
  SELECT song_id, tonic, min(start_beat) AS start, max(start_beat + beats) AS stop FROM (
    SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) AS n FROM (
      SELECT *, CASE WHEN lag(tonic) OVER (PARTITION BY song_id ORDER BY frame_idx) = tonic THEN 0 ELSE 1 END AS f FROM cf)) GROUP BY song_id, n, tonic""")
oracle("a15_local_key_scores", "tspan seg", f"""
  SELECT song_id, {m6('sum(w * CASE WHEN d = 0 THEN 1.0 WHEN d = 7 THEN 0.5 ELSE 0 END) / sum(w)')} AS w_e6, {m6('sum(CASE WHEN d = 0 THEN w ELSE 0 END) * 1.0 / sum(w)')} AS x_e6,
         {m6('sum(CASE WHEN d = 0 THEN w ELSE 0 END) * 1.0 / sum(w)')} AS t_e6, CAST(sum(w) AS INT) AS duration
  FROM (SELECT t.song_id, (t.song_id % 12 - t.tonic + 12) % 12 AS d, least(t.stop, s.stop) - greatest(t.start, s.start) AS w
        FROM tspan t JOIN seg s ON s.song_id = t.song_id AND s.start < t.stop AND t.start < s.stop WHERE s.root IS NOT NULL) GROUP BY song_id""")
oracle("a16_numeral_agreement", "r_seg e_seg", f"""
  SELECT song_id, {m6('sum(CASE WHEN ar = br AND aq = bq THEN w ELSE 0 END) * 1.0 / sum(w)')} AS s_e6, {m6('sum(CASE WHEN ar = br THEN w ELSE 0 END) * 1.0 / sum(w)')} AS d_e6
  FROM (SELECT a.song_id, a.root AS ar, b.root AS br, a.q AS aq, b.q AS bq, least(a.stop, b.stop) - greatest(a.start, b.start) AS w
        FROM r_seg a JOIN e_seg b ON a.song_id = b.song_id AND a.start < b.stop AND b.start < a.stop WHERE a.root IS NOT NULL AND b.root IS NOT NULL) GROUP BY song_id""")
_MM = lambda q: f"CASE WHEN {q} IN ('maj','maj7','7') THEN 'M' WHEN {q} IN ('min','min7') THEN 'm' WHEN {q} IN ('dim','hdim7') THEN 'd' ELSE 'N' END"
_PCS = lambda r, q: f"list_transform({TONES.format(q)}, lambda i: (i + {r}) % 12)"
_LEVEL = {
    "root": "CASE WHEN ar IS NOT DISTINCT FROM br THEN 1 ELSE 0 END",
    "triads": f"CASE WHEN ar IS NOT DISTINCT FROM br AND {_MM('aq')} = {_MM('bq')} THEN 1 ELSE 0 END",
    "tetrads": "CASE WHEN ar IS NOT DISTINCT FROM br AND aq = bq THEN 1 ELSE 0 END",
    "majmin": f"CASE WHEN {_MM('aq')} = 'd' THEN NULL WHEN ar IS NOT DISTINCT FROM br AND {_MM('aq')} = {_MM('bq')} THEN 1 ELSE 0 END",
    "sevenths": "CASE WHEN aq IN ('dim','hdim7') THEN NULL WHEN ar IS NOT DISTINCT FROM br AND aq = bq THEN 1 ELSE 0 END",
    "mirex": f"CASE WHEN ar IS NULL AND br IS NULL THEN 1 WHEN len(list_intersect({_PCS('ar', 'aq')}, {_PCS('br', 'bq')})) >= 3 THEN 1 ELSE 0 END",
}
cte("cpair", "cf", f"""
  SELECT song_id, event_id, beats AS w, root1 AS ar, q1 AS aq, root2, q2, corrupt,
         CASE WHEN corrupt THEN root2 ELSE root1 END AS br, CASE WHEN corrupt THEN q2 ELSE q1 END AS bq FROM cf""")
_avg = lambda n: f"sum(CASE WHEN {n} IS NOT NULL THEN {n} * w END) * 1.0 / sum(CASE WHEN {n} IS NOT NULL THEN w END)"
cte("clev", "cpair", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _LEVEL.items())} FROM cpair")
for _px in ("r_", "e_"):
    cte(f"{_px}iv", f"{_px}cand", f"""
      SELECT song_id, idx, min(start_beat) AS start, max(start_beat + beats) AS stop FROM (
        SELECT *, CAST(sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) - 1 AS INT) AS idx FROM (
          SELECT *, CASE WHEN lag(harte) OVER (PARTITION BY song_id ORDER BY frame_idx) = harte THEN 0 ELSE 1 END AS f FROM {_px}cand)) GROUP BY song_id, idx""")
cte("ivpair", "r_iv e_iv", """
  SELECT a.song_id, a.idx AS i, b.idx AS j, least(a.stop, b.stop) - greatest(a.start, b.start) AS w
  FROM r_iv a JOIN e_iv b ON b.song_id = a.song_id AND a.start < b.stop AND b.start < a.stop""")
cte("segscore", "ivpair", """
  SELECT song_id, least(sum(w) FILTER (side = 0), sum(w) FILTER (side = 1)) * 1.0 / any_value(total) AS seg
  FROM (SELECT song_id, 0 AS side, max(w) AS w FROM ivpair GROUP BY song_id, i UNION ALL SELECT song_id, 1, max(w) FROM ivpair GROUP BY song_id, j)
  JOIN (SELECT song_id, sum(w) AS total FROM ivpair GROUP BY song_id) USING (song_id) GROUP BY song_id""")
oracle("a17_chord_scores", "clev segscore", f"SELECT song_id, CAST(sum(w) AS INT) AS duration, {', '.join(f'{m6(_avg(n))} AS {n}_e6' for n in _LEVEL)}, {m6('any_value(seg)')} AS seg_e6 FROM clev JOIN segscore USING (song_id) GROUP BY song_id")
cte("csong", "clev segscore", f"SELECT song_id, sum(w) AS d, {', '.join(f'{_avg(n)} AS {n}' for n in ('root', 'majmin', 'sevenths', 'mirex'))}, any_value(seg) AS seg FROM clev JOIN segscore USING (song_id) GROUP BY song_id")
oracle("a13_corpus_chord_scores", "csong", "SELECT count(*) AS songs, " + ", ".join(f"{m6(f'sum({n} * d) / sum(d)')} AS {n}_e6" for n in ("root", "majmin", "sevenths", "seg")) + " FROM csong")


def alignment(name: str, cost: str) -> str:
    """CTEs of the whole table of edit costs, one anti-diagonal after another, and of the script back from its end.

    ``cost`` compares chords ``a`` (reference) and ``b`` (estimate) in tenths. A cell (i, j) of diagonal d = i + j holds its
    value v, the value w left of it and how it was reached (0 match, 1 dropped reference chord, 2 inserted estimate).
    """
    cte(f"{name}_size", "r_seg e_seg", """
      SELECT * FROM (SELECT song_id, count(*) AS n FROM r_seg GROUP BY song_id) JOIN (SELECT song_id, count(*) AS m FROM e_seg GROUP BY song_id) USING (song_id)""")
    cte(f"{name}_dp", f"{name}_size r_seg e_seg", f"""
      SELECT song_id, n, m, 0::BIGINT AS d, 0::BIGINT AS i, 0::BIGINT AS v, NULL::BIGINT AS w, 2::BIGINT AS came FROM {name}_size
      UNION ALL
      SELECT song_id, any_value(n), any_value(m), any_value(d) + 1, x.i, min(x.v), max(x.w), arg_min(x.k, x.v * 4 + x.k) FROM (
        SELECT t.song_id, n, m, d, unnest([{{'i': t.i, 'k': 2::BIGINT, 'v': t.v + 10, 'w': t.v}}, {{'i': t.i + 1, 'k': 1::BIGINT, 'v': t.v + 10, 'w': NULL}},
               {{'i': t.i + 1, 'k': 0::BIGINT, 'v': t.w + {cost}, 'w': NULL}}]) AS x
        FROM {name}_dp t LEFT JOIN r_seg a ON a.song_id = t.song_id AND a.seg = t.i LEFT JOIN e_seg b ON b.song_id = t.song_id AND b.seg = t.d - t.i - 1)
      WHERE x.i <= n AND d + 1 - x.i <= m AND x.v IS NOT NULL GROUP BY song_id, x.i""")
    cte(f"{name}_end", f"{name}_dp", f"SELECT song_id, n, m, v AS tenths FROM {name}_dp WHERE i = n AND d = n + m")
    cte(f"{name}_tr", f"{name}_end {name}_dp", f"""
      SELECT song_id, n AS i, m AS j, NULL::BIGINT AS ref, NULL::BIGINT AS est FROM {name}_end
      UNION ALL
      SELECT t.song_id, t.i - CASE WHEN p.came <> 2 THEN 1 ELSE 0 END, t.j - CASE WHEN p.came <> 1 THEN 1 ELSE 0 END,
             CASE WHEN p.came <> 2 THEN t.i - 1 END, CASE WHEN p.came <> 1 THEN t.j - 1 END
      FROM {name}_tr t JOIN {name}_dp p ON p.song_id = t.song_id AND p.d = t.i + t.j AND p.i = t.i WHERE t.i > 0 OR t.j > 0""")
    cte(f"{name}_map", f"{name}_tr", f"""
      SELECT song_id, est, coalesce(ref, first_value(ref IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY est ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ref FROM (
        SELECT song_id, est, last_value(ref IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY i + j) AS ref FROM {name}_tr WHERE ref IS NOT NULL OR est IS NOT NULL)
      WHERE est IS NOT NULL""")
    return name


alignment("al", "CASE WHEN a.harte = b.harte THEN 0 WHEN a.root = b.root THEN 3 ELSE 10 END")
oracle("w21_alignment", "al_end al_tr al_map", f"""
  SELECT e.song_id, {m6('tenths / 10.0::DOUBLE')} AS cost_e6, CAST(n AS INT) AS n_ref, CAST(u AS INT) AS unmatched_ref, refs AS ref_of_est
  FROM al_end e JOIN (SELECT song_id, count(*) FILTER (ref IS NOT NULL AND est IS NULL) AS u FROM al_tr GROUP BY song_id) USING (song_id)
  JOIN (SELECT song_id, string_agg(ref::VARCHAR, '-' ORDER BY est) AS refs FROM al_map GROUP BY song_id) USING (song_id)""")

cte("alpair", "al_map r_seg e_seg", """
  SELECT m.song_id, m.est, e.stop - e.start AS w, r.root AS ar, r.q AS aq, e.root AS br, e.q AS bq
  FROM al_map m JOIN e_seg e ON e.song_id = m.song_id AND e.seg = m.est JOIN r_seg r ON r.song_id = m.song_id AND r.seg = m.ref""")
oracle("a17_chart_scores", "alpair al_end al_tr", f"""
  SELECT song_id, duration, {m6('tenths / 10.0::DOUBLE')} AS cost_e6, CAST(n AS INT) AS n_ref, CAST(u AS INT) AS unmatched_ref, {', '.join(f'{n}_e6' for n in _LEVEL)}
  FROM (SELECT song_id, CAST(sum(w) AS INT) AS duration, {', '.join(f'{m6(_avg(n))} AS {n}_e6' for n in _LEVEL)}
        FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _LEVEL.items())} FROM alpair) GROUP BY song_id)
  JOIN al_end USING (song_id) JOIN (SELECT song_id, count(*) FILTER (ref IS NOT NULL AND est IS NULL) AS u FROM al_tr GROUP BY song_id) USING (song_id)""")
oracle("a16_chart_numerals", "alpair", f"""
  SELECT song_id, {m6('sum(CASE WHEN ar = br AND aq = bq THEN w ELSE 0 END) * 1.0 / sum(w)')} AS s_e6, {m6('sum(CASE WHEN ar = br THEN w ELSE 0 END) * 1.0 / sum(w)')} AS d_e6, CAST(sum(w) AS INT) AS duration
  FROM alpair WHERE br IS NOT NULL GROUP BY song_id""")
oracle("u2_chart_spans", "al_map r_seg e_seg", """
  SELECT song_id, event_no, type, CASE WHEN type = 'modulation' THEN point ELSE start END AS start, CASE WHEN type = 'modulation' THEN point ELSE stop END AS stop FROM (
    SELECT a.song_id, a.seg AS event_no, CASE WHEN arg_max(CASE WHEN c.seg = a.seg + 2 AND c.root IS NOT NULL THEN 1 ELSE 0 END, c.seg) = 1 THEN 'span' ELSE 'modulation' END AS type,
           min(r.start) AS start, max(r.stop) AS stop, arg_max(r.start, c.seg) AS point
    FROM e_seg a JOIN e_seg c ON c.song_id = a.song_id AND c.seg BETWEEN a.seg AND a.seg + 2 JOIN al_map m ON m.song_id = c.song_id AND m.est = c.seg
    JOIN r_seg r ON r.song_id = m.song_id AND r.seg = m.ref GROUP BY a.song_id, a.seg)""")

# ---------------------------------------------------------------- two segmentations
cte("marks", "cf", """
  SELECT song_id, min(start_beat) * 0.5::DOUBLE AS start, max(start_beat + beats) * 0.5::DOUBLE AS stop, lower(min(section)) AS label FROM (
    SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) AS grp FROM (
      SELECT *, CASE WHEN lag(section) OVER (PARTITION BY song_id ORDER BY frame_idx) = section THEN 0 ELSE 1 END AS f FROM cf)) GROUP BY song_id, grp""")
cte("odds", "cf", """
  SELECT song_id, min(start_beat) * 0.5::DOUBLE + 0.25 AS start, max(start_beat + beats) * 0.5::DOUBLE + 0.25 AS stop, CASE WHEN bool_or(odd) THEN 'verse' ELSE 'chorus' END AS label FROM (
    SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) AS grp FROM (
      SELECT *, CASE WHEN lag(odd) OVER (PARTITION BY song_id ORDER BY frame_idx) = odd THEN 0 ELSE 1 END AS f FROM (SELECT *, corrupt OR event_id % 7 < 4 AS odd FROM cf))) GROUP BY song_id, grp""")
for _side, _t in (("rb", "marks"), ("eb", "odds")):
    cte(_side, _t, f"SELECT song_id, t AS at, row_number() OVER (PARTITION BY song_id ORDER BY t) AS k FROM (SELECT DISTINCT song_id, unnest([start, stop]) AS t FROM {_t})")
# two pointers over the sorted boundaries: match when in reach, else pass the earlier one
cte("hits", "rb eb", """
  SELECT song_id, win, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS hit FROM (SELECT DISTINCT song_id FROM rb), (SELECT unnest([3.0, 0.5]) AS win)
  UNION ALL
  SELECT h.song_id, h.win, h.i + CASE WHEN abs(r.at - e.at) <= h.win OR r.at < e.at THEN 1 ELSE 0 END, h.j + CASE WHEN abs(r.at - e.at) <= h.win OR r.at >= e.at THEN 1 ELSE 0 END,
         CASE WHEN abs(r.at - e.at) <= h.win THEN 1 ELSE 0 END
  FROM hits h JOIN rb r ON r.song_id = h.song_id AND r.k = h.i JOIN eb e ON e.song_id = h.song_id AND e.k = h.j""")
oracle("a25_boundary_scores", "hits rb eb", f"""
  SELECT song_id, CAST(win * 10 AS INT) AS window_e1, n_ref, n_est, CAST(matched AS BIGINT) AS matched, {m6('CASE WHEN matched > 0 THEN 2.0::DOUBLE * matched / (n_ref + n_est) ELSE 0 END')} AS f_e6
  FROM (SELECT song_id, win, sum(hit) AS matched FROM hits GROUP BY song_id, win)
  JOIN (SELECT song_id, count(*) AS n_ref FROM rb GROUP BY song_id) USING (song_id) JOIN (SELECT song_id, count(*) AS n_est FROM eb GROUP BY song_id) USING (song_id)""")
cte("sframes", "marks odds", """
  SELECT f.song_id, m.label AS la, o.label AS lb FROM (SELECT song_id, unnest(range(CAST(floor(max(stop) / 0.1::DOUBLE) AS BIGINT))) * 0.1::DOUBLE AS t FROM marks GROUP BY song_id) f
  JOIN marks m ON m.song_id = f.song_id AND m.start <= f.t AND f.t < m.stop LEFT JOIN odds o ON o.song_id = f.song_id AND o.start <= f.t AND f.t < o.stop""")
oracle("a25_pairwise_scores", "sframes", f"""
  SELECT song_id, CAST(frames AS BIGINT) AS frames, {m6('s / e')} AS p_e6, {m6('s / r')} AS r_e6, {m6('2 * (s / e) * (s / r) / (s / e + s / r)')} AS f_e6
  FROM (SELECT song_id, sum(n) AS frames, sum(n * (n - 1) / 2)::DOUBLE AS s FROM (SELECT song_id, la, lb, count(*) AS n FROM sframes GROUP BY ALL) GROUP BY song_id)
  JOIN (SELECT song_id, sum(n * (n - 1) / 2)::DOUBLE AS r FROM (SELECT song_id, la, count(*) AS n FROM sframes GROUP BY ALL) GROUP BY song_id) USING (song_id)
  JOIN (SELECT song_id, sum(n * (n - 1) / 2)::DOUBLE AS e FROM (SELECT song_id, lb, count(*) AS n FROM sframes GROUP BY ALL) GROUP BY song_id) USING (song_id)""")
oracle("a19_home_key", "tspan", """
  SELECT song_id, tonic AS key_idx, held FROM (SELECT song_id, tonic, CAST(sum(stop - start) AS INT) AS held, min(start) AS seen FROM tspan GROUP BY song_id, tonic)
  QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY held DESC, seen) = 1""")
oracle("w3_top_intervals", "e_cand", """
  SELECT song_id, idx, min(harte) AS harte, min(start_beat) AS start, max(start_beat + beats) AS stop FROM (
    SELECT *, CAST(sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) - 1 AS INT) AS idx FROM (
      SELECT *, CASE WHEN lag(harte) OVER (PARTITION BY song_id ORDER BY frame_idx) = harte THEN 0 ELSE 1 END AS f FROM e_cand)) GROUP BY song_id, idx""")
cte("sweep", "cf", f"""
  SELECT param, {', '.join(f'{m6(_avg(n))} AS {n}_e6' for n in ('majmin', 'root'))} FROM (
    SELECT *, {_LEVEL['majmin']} AS majmin, {_LEVEL['root']} AS root FROM (
      SELECT p.param, beats AS w, root1 AS ar, q1 AS aq, CASE WHEN event_id % p.param = 0 AND q1 <> 'N' THEN root2 ELSE root1 END AS br,
             CASE WHEN event_id % p.param = 0 AND q1 <> 'N' THEN q2 ELSE q1 END AS bq FROM cf, (SELECT unnest([2, 3, 5, 7]) AS param) p)) GROUP BY param""")
oracle("t6_parameter_sweep", "sweep", "SELECT param AS param_id, majmin_e6, root_e6 FROM sweep")
oracle("t5_best_parameter", "sweep", """
  SELECT param AS param_id, majmin_e6 AS objective_e6 FROM sweep WHERE param <> 2 AND root_e6 >= (SELECT root_e6 - 10000 FROM sweep WHERE param = 2) ORDER BY majmin_e6 DESC, param LIMIT 1""")

# ---------------------------------------------------------------- sources and sinks
oracle("s1_chart_frames", "cf r_cand", f"""
  SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar, slot) - 1 AS INT) AS frame_idx, label, {m6('time')} AS time_e6, {m6('dur')} AS dur_e6, bar, section
  FROM (SELECT b.song_id, CAST(b.b + 1 AS INT) AS bar, s.slot, CASE WHEN s.slot = 0 THEN src.l0 ELSE src.l1 END AS label,
               b.b * 4 + s.slot * 4.0 / CASE WHEN src.two THEN 2 ELSE 1 END AS time, 4.0 / CASE WHEN src.two AND NOT src.dot THEN 2 ELSE 1 END AS dur, b.section
        FROM (SELECT song_id, frame_idx // 2 AS b, min(frame_idx) % 10 = 8 AS pct,
                     CASE WHEN CAST(floor((min(frame_idx) // 16 * 16) / 16) AS INT) % 2 = 0 THEN 'Verse' ELSE 'Chorus' END AS section
              FROM cf GROUP BY song_id, frame_idx // 2) b
        JOIN (SELECT song_id, frame_idx // 2 AS b, min(frame_idx) % 10 = 8 AS pct, arg_min(harte, frame_idx) AS l0, arg_max(harte, frame_idx) AS l1, count(*) > 1 AS two,
                     count(*) > 1 AND min(frame_idx) % 6 = 2 AS dot FROM r_cand GROUP BY song_id, frame_idx // 2) src
          ON src.song_id = b.song_id AND src.b = CASE WHEN b.pct THEN b.b - 1 ELSE b.b END
        JOIN (SELECT unnest([0, 1]) AS slot) s ON s.slot = 0 OR (src.two AND NOT src.dot))""")
oracle("s2_label_lines", "r_cand", """
  SELECT song_id, frame_idx AS line_no, CASE WHEN frame_idx % 9 = 7 THEN -1 ELSE start_beat * 10 END AS start_e1,
         CASE WHEN frame_idx % 9 = 7 THEN -1 ELSE (start_beat + beats) * 10 + 5 END AS end_e1, CASE WHEN frame_idx % 9 = 7 THEN 'broken' ELSE harte END AS label
  FROM r_cand WHERE frame_idx % 9 <> 4""")
oracle("s3_recognition_documents", "cand", """
  SELECT song_id, frame_idx, min(start_beat) AS time, min(section) AS section, CAST(count(*) AS INT) AS n, arg_min(harte, pos) AS harte FROM cand GROUP BY song_id, frame_idx""")
oracle("s4_annotations", "r_cand", """
  SELECT song_id, frame_idx, start_beat AS time, CASE WHEN frame_idx % 11 = 3 THEN 'X' ELSE harte END AS label FROM r_cand
  UNION ALL SELECT song_id, -1, start_beat, 'C:major' FROM r_cand WHERE frame_idx = 20""")
oracle("s7_gold_events", "cf", """
  SELECT song_id, frame_idx AS gold_id, CASE WHEN frame_idx % 2 = 0 THEN 'x' ELSE 'y' END AS type, CASE WHEN frame_idx % 2 = 0 THEN (bar - 1) * 4 ELSE start_beat END AS start,
         CASE WHEN frame_idx % 2 = 0 THEN (bar + 1) * 4 ELSE start_beat + beats END AS stop FROM cf""")
oracle("s8_pick_estimates", "cf", """
  SELECT song_id, coalesce(arg_min(CASE WHEN ok THEN ['.lab', '.json', '.recognition.json'][frame_idx % 3 + 1] END, CASE WHEN ok THEN [2, 0, 1][frame_idx % 3 + 1] END), 'no estimate file') AS extension
  FROM (SELECT *, event_id % 2 = 0 AND song_id % 5 <> 3 AS ok FROM cf) GROUP BY song_id""")
oracle("s10_section_files", "cf", """
  SELECT song_id AS stem, 'd' || max(event_id % 4) AS directory, max(event_id) FILTER (event_id % 4 = top) AS sections
  FROM (SELECT *, max(event_id % 4) OVER (PARTITION BY song_id) AS top FROM cf) GROUP BY song_id""")
ORACLES["s11_newest_recognition"] = "SELECT user_id AS source_path, arg_max(event_id, ts) AS doc_id FROM events GROUP BY user_id"
ORACLES["s9_paired_annotations"] = compose("""
  SELECT c.song_id, CASE WHEN c.ids % 3 > 0 AND c.ids % 4 > 0 THEN s.split WHEN c.ids % 4 > 0 THEN 'no key annotation' ELSE 'no chord annotation' END AS split
  FROM (SELECT song_id, sum(event_id) AS ids FROM cf GROUP BY song_id) c JOIN (""" + ORACLES["f14_song_split"] + """) s ON s.song_id = c.song_id
  WHERE c.ids % 3 > 0 OR c.ids % 4 > 0""", "cf")
ORACLES["s9_written_corpus"] = compose("""
  SELECT run, c.song_id, s.split FROM (SELECT DISTINCT song_id FROM cf) c JOIN (""" + ORACLES["f14_song_split"] + """) s ON s.song_id = c.song_id,
    (SELECT unnest([0, 1, 9]) AS run) WHERE run = 9 OR (c.song_id % 3 = 0) = (run = 0)""", "cf")
oracle("k6_ranked_sweep", "sweep", """
  SELECT CAST(row_number() OVER (ORDER BY majmin_e6 DESC, param) AS INT) AS rank, param AS param_id, majmin_e6 AS objective_e6, ok AS eligible,
         param = (SELECT coalesce(arg_max(param, majmin_e6 * 100 - param) FILTER (ok2), 2) FROM (SELECT *, param <> 2 AND root_e6 >= (SELECT root_e6 - 10000 FROM sweep WHERE param = 2) AS ok2 FROM sweep)) AS best
  FROM (SELECT *, param = 2 OR root_e6 >= (SELECT root_e6 - 10000 FROM sweep WHERE param = 2) AS ok FROM sweep)""")
oracle("k4_label_export", "seg", """
  SELECT song_id, seg, printf('%.3f', start / 2.0) || chr(9) || printf('%.3f', stop / 2.0) || chr(9) || harte AS line FROM seg""")

# ---------------------------------------------------------------- meter, decoding, structure
cte("bt", "cf", "SELECT song_id, start_beat * 0.5 AS tm, start_beat % 4 = 0 AS down FROM cf")
cte("bdur", "cf", "SELECT song_id, max(start_beat + beats) * 0.5 AS dur FROM cf GROUP BY song_id")
oracle("w10_beat_numbering", "bt bdur", """
  WITH e AS (SELECT song_id, tm, true AS beat, down FROM bt WHERE tm > 0 UNION ALL SELECT song_id, 0, false, false FROM bdur),
  n AS (SELECT e.*, sum(CASE WHEN down THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY tm) AS bar FROM e)
  SELECT n.song_id, CAST(tm * 2 AS INT) AS start_e2, CAST(coalesce(lead(tm) OVER (PARTITION BY n.song_id ORDER BY tm), d.dur) * 2 AS INT) AS end_e2,
    CASE WHEN beat AND hd THEN CAST(bar AS INT) END AS bar,
    CASE WHEN beat AND hd THEN CAST(sum(CASE WHEN beat THEN 1 ELSE 0 END) OVER (PARTITION BY n.song_id, bar ORDER BY tm) AS INT) END AS beat_in_bar
  FROM n JOIN bdur d USING (song_id) JOIN (SELECT song_id, bool_or(down) AS hd FROM bt GROUP BY song_id) h USING (song_id)""".strip())
oracle("w18_metrical_cost", "cf", """
  SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INT) AS beat, CASE WHEN bar % 4 = 1 THEN 0 ELSE 500000 END AS cost_e6
  FROM (SELECT DISTINCT song_id, bar FROM cf)""")
_LABEL = lambda r, q: f"coalesce({NOTES}[{r} + 1] || ':' || {q}, 'N')"
cte("vocab", "cf", f"""
  SELECT row_number() OVER (ORDER BY q, root) AS idx, {NOTES}[root + 1] || ':' || q AS label, root, q
  FROM (SELECT DISTINCT root1 AS root, q1 AS q FROM cf WHERE root1 IS NOT NULL UNION SELECT DISTINCT root2, q2 FROM cf WHERE root2 IS NOT NULL)
  UNION ALL SELECT 0, 'N', NULL, 'N'""")
cte("places", "cf vocab", f"""
  SELECT f.*, CAST(dense_rank() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INT) AS beat, a.idx AS i1, b.idx AS i2, p1_permille / 1000.0::DOUBLE AS p1, p2_permille / 1000.0::DOUBLE AS p2
  FROM cf f JOIN vocab a ON a.label = {_LABEL('f.root1', 'f.q1')} JOIN vocab b ON b.label = {_LABEL('f.root2', 'f.q2')}""")
cte("obs", "places vocab", """
  SELECT song_id, beat, idx, 1.5 * avg(ln(0.01 + CASE WHEN idx = i1 THEN p1 ELSE 0 END + CASE WHEN idx = i2 THEN p2 ELSE 0 END)) + CASE WHEN any_value(v.q) IN ('7','maj7','min7','hdim7') THEN 1.0 ELSE 0 END AS obs
  FROM places, vocab v GROUP BY song_id, beat, idx""")
oracle("a24_beat_observations", "obs", f"SELECT song_id, beat, CAST(idx AS INT) AS chord_idx, {m6('obs')} AS obs_e6 FROM obs")
_K = lambda x: CLS.format(x)
cte("trans", "vocab", f"""
  SELECT a.idx AS src, b.idx AS dst, a.label AS src_label, b.label AS dst_label, CASE WHEN a.idx = b.idx THEN 0 WHEN a.root IS NULL OR b.root IS NULL THEN -2.0::DOUBLE
    ELSE -1 + [-1.0,-1.6,-0.8,-1.0,-1.0,-0.3,-1.8,-0.7,-1.0,-0.9,-0.8,-1.5][(b.root - a.root + 12) % 12 + 1]
         + CASE {_K('a.q')} || '>' || {_K('b.q')} WHEN 'dom>maj' THEN 0.25 WHEN 'dom>min' THEN 0.1 WHEN 'min>dom' THEN 0.2 WHEN 'hdim>dom' THEN 0.3 ELSE 0 END END AS score
  FROM vocab a, vocab b""")
oracle("w20_transitions", "trans", f"SELECT src_label AS src, dst_label AS dst, {m6('score')} AS score_e6 FROM trans")
# forward and backward over the beats of all songs at once; a change into a beat off the bar's first position costs half
cte("ob", "obs cf", """
  SELECT o.*, exp(obs - max(obs) OVER (PARTITION BY o.song_id, o.beat)) AS seen, CASE WHEN c.bar % 4 = 1 THEN 0.0 ELSE 0.5 END AS extra, max(o.beat) OVER (PARTITION BY o.song_id) AS last
  FROM obs o JOIN (SELECT song_id, bar, row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS beat FROM (SELECT DISTINCT song_id, bar FROM cf)) c ON c.song_id = o.song_id AND c.beat = o.beat""")
cte("fwd", "ob trans", """
  SELECT song_id, 0 AS beat, idx, seen / sum(seen) OVER (PARTITION BY song_id) AS a, obs AS best, idx AS came FROM ob WHERE beat = 0
  UNION ALL
  SELECT song_id, beat, idx, reach / sum(reach) OVER (PARTITION BY song_id), best, came FROM (
    SELECT song_id, beat, idx, sum(a * exp(way)) * any_value(seen) AS reach, max(val) + any_value(obs) AS best, min(src) FILTER (val >= top - 1e-9) AS came FROM (
      SELECT f.song_id, o.beat, o.idx, o.seen, o.obs, t.src, f.a, t.score - CASE WHEN t.src <> t.dst THEN o.extra ELSE 0 END AS way,
             f.best + t.score - CASE WHEN t.src <> t.dst THEN o.extra ELSE 0 END AS val,
             max(f.best + t.score - CASE WHEN t.src <> t.dst THEN o.extra ELSE 0 END) OVER (PARTITION BY f.song_id, o.idx) AS top
      FROM fwd f JOIN trans t ON t.src = f.idx JOIN ob o ON o.song_id = f.song_id AND o.beat = f.beat + 1 AND o.idx = t.dst) GROUP BY song_id, beat, idx)""")
cte("bwd", "ob trans", """
  SELECT song_id, beat, idx, 1.0::DOUBLE AS b FROM ob WHERE beat = last
  UNION ALL
  SELECT song_id, beat, idx, b / sum(b) OVER (PARTITION BY song_id) FROM (
    SELECT o.song_id, o.beat - 1 AS beat, t.src AS idx, sum(w.b * o.seen * exp(t.score - CASE WHEN t.src <> t.dst THEN o.extra ELSE 0 END)) AS b
    FROM bwd w JOIN ob o ON o.song_id = w.song_id AND o.beat = w.beat AND o.idx = w.idx JOIN trans t ON t.dst = o.idx WHERE o.beat > 0 GROUP BY o.song_id, o.beat, t.src)""")
cte("post", "fwd bwd", "SELECT song_id, beat, idx, a * b / sum(a * b) OVER (PARTITION BY song_id, beat) AS p FROM fwd JOIN bwd USING (song_id, beat, idx)")
cte("way", "fwd", """
  SELECT song_id, beat, min(idx) AS idx FROM (SELECT *, max(beat) OVER (PARTITION BY song_id) AS last, max(best) OVER (PARTITION BY song_id, beat) AS top FROM fwd) WHERE beat = last AND best >= top - 1e-9 GROUP BY song_id, beat
  UNION ALL
  SELECT w.song_id, w.beat - 1, f.came FROM way w JOIN fwd f ON f.song_id = w.song_id AND f.beat = w.beat AND f.idx = w.idx WHERE w.beat > 0""")
oracle("w19_chord_decoding", "post way", f"""
  SELECT song_id, beat, CAST(idx AS INT) AS path_idx, {m6('top')} AS top_e6 FROM way JOIN (SELECT song_id, beat, max(p) AS top FROM post GROUP BY song_id, beat) USING (song_id, beat)""")
oracle("t1_top_candidates", "cf", f"""
  SELECT song_id, beat, CAST(row_number() OVER (PARTITION BY song_id, beat ORDER BY p DESC) - 1 AS INT) AS rank, label, {m6('p')} AS prob_e6 FROM (
    SELECT song_id, frame_idx AS beat, {_LABEL('root1', "CASE WHEN root1 IS NULL THEN NULL ELSE q1 END")} AS label, p1_permille / 1000.0::DOUBLE AS p FROM cf
    UNION ALL SELECT song_id, frame_idx, {_LABEL('root2', 'q2')}, p2_permille / 10000.0::DOUBLE FROM cf WHERE q2 IS NOT NULL AND p2_permille >= 200)""")
cte("bass", "places", """
  SELECT song_id, beat, tone, avg(CASE WHEN tone = coalesce(root1 + 1, 0) THEN p1 ELSE 0.01 END) AS p FROM places, (SELECT CAST(unnest(range(13)) AS INT) AS tone) GROUP BY song_id, beat, tone""")
cte("bassnote", "bass", f"""
  SELECT *, CASE WHEN tone > 0 THEN {NOTES}[tone] END AS note FROM (SELECT song_id, beat, arg_max(tone, (p, -tone)) AS tone, max(p) AS p, sum(p) AS s FROM bass GROUP BY song_id, beat)""")
oracle("a24_beat_bass", "bassnote", f"SELECT song_id, beat, note AS bass_note, {m6('p')} AS prob_e6, {m6('s')} AS sum_e6 FROM bassnote")
oracle("t2_bass_notes", "cf", f"SELECT song_id, frame_idx AS beat, {NOTES}[root1 + 1] AS bass_note, {m6('p1_permille / 1000.0::DOUBLE')} AS prob_e6 FROM cf")
oracle("b1_chord_templates", "cand", f"""
  SELECT DISTINCT harte AS label, CAST(coalesce(list_sum(list_transform({TONES.format('q')}, lambda i: pow(2, 11 - (root + i) % 12))), 0) AS INT) AS chroma_bits,
         CASE WHEN root IS NULL THEN -1 ELSE root + CASE WHEN q IN ('min','min7','dim','hdim7') THEN 12 ELSE 0 END END AS identity_idx FROM cand""")
oracle("a22_bar_features", "cf", f"""
  WITH b AS (SELECT song_id, bar, CASE WHEN count(*) >= 4 THEN list_sum(list(p ORDER BY start_beat)[1:4]) ELSE sum(p) + (4 - count(*)) * arg_max(p, start_beat) END AS harm,
                    avg(l) AS loud, avg(t) AS timbre
             FROM (SELECT song_id, bar, start_beat, CASE WHEN root1 IS NULL THEN 0 ELSE p1_permille / 1000.0::DOUBLE END AS p, CASE WHEN section = 'Chorus' THEN -10.0 ELSE -18.0 END AS l,
                          p1_permille / 100.0::DOUBLE AS t FROM cf) GROUP BY song_id, bar)
  SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INT) AS bar_no, bar, {m6('harm')} AS harm_e6,
         {m6('(loud - avg(loud) OVER w) / (stddev_pop(loud) OVER w + 1e-6)')} AS loud_e6, {m6('(timbre - avg(timbre) OVER w) / (stddev_pop(timbre) OVER w + 1e-6)')} AS timbre_e6
  FROM b WINDOW w AS (PARTITION BY song_id)""".strip())
for _k in ("w10_beat_numbering", "a22_bar_features"):   # their final select carries its own CTEs
    _head, _tail = ORACLES[_k].rsplit("\nWITH ", 1)
    ORACLES[_k] = _head + ",\n" + _tail
cte("slots", "cf", """
  SELECT b.song_id, b.bar_no, s.k, b.xs[least(s.k, len(b.xs) - 1) + 1] AS x FROM (
    SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INT) AS bar_no, xs FROM (
      SELECT song_id, bar, list(struct_pack(root := root1, minor := q1 IN ('min','min7','dim','hdim7'), q := q1, p := CASE WHEN root1 IS NULL THEN 0 ELSE p1_permille / 1000.0::DOUBLE END) ORDER BY start_beat) AS xs
      FROM cf GROUP BY song_id, bar)) b, (SELECT unnest(range(4)) AS k) s""")
cte("wslots", "slots", """
  SELECT song_id, bar_no, k, x FROM slots UNION ALL
  SELECT a.song_id, a.bar_no, a.k + 4, coalesce(b.x, a.x) FROM slots a LEFT JOIN slots b ON b.song_id = a.song_id AND b.bar_no = a.bar_no + 1 AND b.k = a.k""")
oracle("b2_repetition_band", "wslots", f"""
  SELECT a.song_id, r.shift, a.bar_no AS i, b.bar_no AS j,
         {m6("least(greatest(sum(CASE WHEN a.x.root = (b.x.root + r.shift) % 12 AND a.x.minor = b.x.minor THEN a.x.p * b.x.p ELSE 0 END) / (CASE WHEN sqrt(sum(a.x.p * a.x.p)) > 1e-9 THEN sqrt(sum(a.x.p * a.x.p)) ELSE 1 END * CASE WHEN sqrt(sum(b.x.p * b.x.p)) > 1e-9 THEN sqrt(sum(b.x.p * b.x.p)) ELSE 1 END), 0), 1)")} AS sim_e6
  FROM wslots a JOIN wslots b ON b.song_id = a.song_id AND b.k = a.k AND b.bar_no IN (a.bar_no + 1, a.bar_no + 2), (SELECT CAST(unnest(range(12)) AS INT) AS shift) r
  GROUP BY a.song_id, r.shift, a.bar_no, b.bar_no""")

cte("tvec", "cf", """
  SELECT song_id, bar, row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS bar_no, [(a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-6), (b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-6), (l - avg(l) OVER w) / (stddev_pop(l) OVER w + 1e-6)] AS t
  FROM (SELECT song_id, bar, avg(p1_permille / 100.0::DOUBLE) AS a, avg(beats::DOUBLE) AS b, avg(CASE WHEN section = 'Chorus' THEN -10.0::DOUBLE ELSE -18.0 END) AS l FROM cf GROUP BY song_id, bar)
  WINDOW w AS (PARTITION BY song_id)""")
oracle("b3_timbre_scale", "tvec", f"""
  SELECT song_id, {m6('coalesce(median(d) FILTER (d > 0), 1)')} AS sigma_e6
  FROM (SELECT a.song_id, sqrt(pow(a.t[1] - b.t[1], 2) + pow(a.t[2] - b.t[2], 2) + pow(a.t[3] - b.t[3], 2)) AS d FROM tvec a JOIN tvec b ON b.song_id = a.song_id AND a.bar <= b.bar) GROUP BY song_id""")
cte("secs", "cf", """
  SELECT song_id, min(start_beat) AS start, max(start_beat + beats) AS stop, min(section) AS section FROM (
    SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY frame_idx) AS grp FROM (
      SELECT *, CASE WHEN lag(section) OVER (PARTITION BY song_id ORDER BY frame_idx) = section THEN 0 ELSE 1 END AS f FROM cf)) GROUP BY song_id, grp""")
cte("barbeat", "cf", "SELECT song_id, bar, row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS beat FROM (SELECT DISTINCT song_id, bar FROM cf)")
oracle("b9_assembled_frames", "post vocab secs barbeat bassnote", """
  SELECT t.song_id, CAST(t.beat AS INT) AS frame_idx, CAST((b.bar - 1) * 4 AS INT) AS time, 4 AS beats, s.section, CAST(t.n AS INT) AS n, v.label, n.note AS bass, CAST(round(round(n.p, 4) * 10000) AS INT) AS bass_e4
  FROM (SELECT song_id, beat, greatest(1, least(5, count(*) FILTER (p >= 0.02))) AS n, arg_max(idx, (p, -idx)) AS idx FROM post GROUP BY song_id, beat) t
  JOIN vocab v USING (idx) JOIN barbeat b ON b.song_id = t.song_id AND b.beat = t.beat JOIN bassnote n ON n.song_id = t.song_id AND n.beat = t.beat
  LEFT JOIN secs s ON s.song_id = t.song_id AND s.start <= (b.bar - 1) * 4 AND (b.bar - 1) * 4 < s.stop""")

# the corpus report: weighted means of the per-song tables and counts of error categories
_SAME = "a.root IS NOT DISTINCT FROM b.root"
_LEVELS = {"root": _SAME, "majmin": f"{_SAME} AND ({_MM('a.q')} = {_MM('b.q')} OR {_MM('a.q')} = 'd')", "sevenths": f"{_SAME} AND (a.q = b.q OR a.q IN ('dim','hdim7'))"}
for _k, _same in _LEVELS.items():
    alignment(f"al_{_k}", f"CASE WHEN {_same} THEN 0 ELSE 10 END")
cte("numsong", "r_seg e_seg", """
  SELECT song_id, sum(CASE WHEN ar = br AND aq = bq THEN w ELSE 0 END) * 1.0 / sum(w) AS strict, sum(CASE WHEN ar = br THEN w ELSE 0 END) * 1.0 / sum(w) AS degree
  FROM (SELECT a.song_id, a.root AS ar, b.root AS br, a.q AS aq, b.q AS bq, least(a.stop, b.stop) - greatest(a.start, b.start) AS w
        FROM r_seg a JOIN e_seg b ON a.song_id = b.song_id AND a.start < b.stop AND b.start < a.stop WHERE a.root IS NOT NULL AND b.root IS NOT NULL) GROUP BY song_id""")
cte("keytime", "tspan seg", """
  SELECT (t.song_id % 12 - t.tonic + 12) % 12 AS d, least(t.stop, s.stop) - greatest(t.start, s.start) AS w
  FROM tspan t JOIN seg s ON s.song_id = t.song_id AND s.start < t.stop AND t.start < s.stop WHERE s.root IS NOT NULL""")
_ROWS = [("songs", "(SELECT count(*) FROM csong)")] + [(f"chord {n}", f"(SELECT sum({n} * d) / sum(d) FROM csong)") for n in ("root", "majmin", "sevenths", "mirex", "seg")]
_ROWS += [(f"symbol error {k}", f"(SELECT sum(tenths / 10.0::DOUBLE) / sum(n) FROM al_{k}_end)") for k in _LEVELS]
_ROWS += [("numeral agreement", "(SELECT avg(strict) FROM numsong)"), ("numeral degree agreement", "(SELECT avg(degree) FROM numsong)")]
_ROWS += [("local key weighted", "(SELECT sum(w * CASE WHEN d = 0 THEN 1.0 WHEN d = 7 THEN 0.5 ELSE 0 END) / sum(w) FROM keytime)")]
_ROWS += [(f"local key {n}", "(SELECT sum(CASE WHEN d = 0 THEN w ELSE 0 END) * 1.0 / sum(w) FROM keytime)") for n in ("exact", "tonic")]
oracle("k3_evaluation_report", "csong numsong keytime " + " ".join(f"al_{k}_end" for k in _LEVELS),
       "SELECT measure, value_e6 FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS measure, {m6(x)} AS value_e6" for n, x in _ROWS)
       + f" UNION ALL SELECT 'errors ' || category, CAST(sum(n) * 1000000 AS BIGINT) FROM ({ORACLES['a14_error_attribution']}) GROUP BY category)")


# ---------------------------------------------------------------- tempo and bar lines
def folded_period(name: str, times: str, fold: int, lo: float, hi: float) -> str:
    """CTEs of the robust period of a song's times: mode of a smoothed histogram of gaps, then medians of folded gaps."""
    cte(f"{name}_gap", "bt", f"SELECT * FROM (SELECT song_id, tm - lag(tm) OVER (PARTITION BY song_id ORDER BY tm) AS x FROM ({times})) WHERE x > 1e-3")
    cte(f"{name}_0", f"{name}_gap", f"""
      SELECT song_id, arg_max(base + (cell + 0.5) * 0.01, (n, -cell)) AS p FROM (
        SELECT song_id, any_value(base) AS base, cell, sum(n) AS n FROM (
          SELECT song_id, base, last, unnest([bin - 1, bin, bin + 1]) AS cell, n FROM (
            SELECT g.song_id, r.lo - 0.005 AS base, CAST(ceil((r.hi - r.lo + 0.02) / 0.01 - 1e-9) AS INT) - 2 AS last, CAST(floor((g.x - r.lo + 0.005) / 0.01) AS INT) AS bin, count(*) AS n
            FROM {name}_gap g JOIN (SELECT song_id, coalesce(min(x) FILTER (x BETWEEN {lo} AND {hi}), min(x))::DOUBLE AS lo, coalesce(max(x) FILTER (x BETWEEN {lo} AND {hi}), max(x))::DOUBLE AS hi
              FROM {name}_gap GROUP BY song_id) r ON r.song_id = g.song_id AND g.x BETWEEN r.lo AND r.hi GROUP BY ALL)) WHERE cell BETWEEN 0 AND last GROUP BY song_id, cell) GROUP BY song_id""")
    for k in (1, 2):
        cte(f"{name}_{k}", f"{name}_gap {name}_{k - 1}", f"""
          SELECT p.song_id, coalesce(quantile_cont(f.y, 0.5) FILTER (abs(f.y - p.p) / p.p < 0.12), any_value(p.p)) AS p FROM {name}_{k - 1} p LEFT JOIN (
            SELECT g.song_id, g.x::DOUBLE / least(greatest(round_even(g.x::DOUBLE / p.p, 0), 1), {fold}) AS y FROM {name}_gap g JOIN {name}_{k - 1} p USING (song_id) WHERE g.x >= 0.7 * p.p) f
            ON f.song_id = p.song_id GROUP BY p.song_id""")
    return f"{name}_2"


cte("tempo", f"{folded_period('pb', 'SELECT song_id, tm FROM bt', 4, 0.15, 2.5)} {folded_period('pd', 'SELECT song_id, tm FROM bt WHERE down', 3, 0.6, 6.0)} bt", """
  SELECT song_id, bar / m AS p, bar AS d, CAST(m AS INT) AS m, n >= 3 AS has FROM (
    SELECT *, CASE WHEN n >= 3 AND d IS NOT NULL THEN greatest(1, round_even(d / p, 0)) ELSE 4 END AS m, CASE WHEN n >= 3 AND d IS NOT NULL THEN d ELSE 4 * p END AS bar FROM (
      SELECT b.song_id, CASE WHEN b.p < 0.25 THEN b.p * pow(2, ceil(log2(0.25 / b.p))) ELSE b.p END AS p, d.p AS d, c.n
      FROM pb_2 b LEFT JOIN pd_2 d USING (song_id) JOIN (SELECT song_id, count(*) FILTER (down) AS n FROM bt GROUP BY song_id) c USING (song_id)))""")
oracle("a21_tempo", "tempo", f"""
  SELECT song_id, {m6('p')} AS beat_e6, {m6('d')} AS bar_e6, m AS beats_per_bar, CASE m WHEN 2 THEN '2 beats/bar (2/4 or 6/8)' WHEN 3 THEN '3/4' WHEN 4 THEN '4 beats/bar (4/4 or 12/8)' WHEN 6 THEN '6/8'
    WHEN 8 THEN '8 beats/bar (4/4 at 8th level)' WHEN 9 THEN '9/8' WHEN 12 THEN '12/8' ELSE m || ' beats/bar' END AS time_signature FROM tempo""")
_WHOLE = lambda g: f"(round_even(({g}) / d, 0) >= 1 AND abs(({g}) - round_even(({g}) / d, 0) * d) < 0.5 * p)"
cte("dn", "bt tempo", """
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY tm) - 1 AS idx, lead(tm) OVER (PARTITION BY song_id ORDER BY tm) AS nxt FROM (
    SELECT b.song_id, b.tm::DOUBLE AS tm, p, d FROM bt b JOIN tempo t USING (song_id) WHERE has AND down
    UNION ALL SELECT b.song_id, min(tm)::DOUBLE, any_value(p), any_value(d) FROM bt b JOIN tempo t USING (song_id) WHERE NOT has GROUP BY b.song_id)""")
cte("rep", "dn", f"""
  SELECT song_id, idx, tm AS last, [tm] AS adds, NULL::INT AS odd FROM dn WHERE idx = 0
  UNION ALL
  SELECT song_id, idx, CASE WHEN drops THEN last ELSE tm END, CASE WHEN drops THEN [] WHEN NOT fits THEN [tm]
         ELSE list_transform(range(1, k + 1), lambda j: CASE WHEN j = k THEN tm ELSE last + gap * j / k END) END, CASE WHEN NOT drops AND NOT fits THEN CAST(round_even(gap / p, 0) AS INT) END FROM (
    SELECT n.song_id, n.idx, n.tm, r.last, n.p, n.d, n.tm - r.last AS gap, CAST(round_even((n.tm - r.last) / d, 0) AS BIGINT) AS k, {_WHOLE('n.tm - r.last')} AS fits,
           round_even((n.tm - r.last) / p, 0) < 2 OR (NOT {_WHOLE('n.tm - r.last')} AND n.nxt IS NOT NULL AND {_WHOLE('n.nxt - r.last')}) AS drops
    FROM rep r JOIN dn n ON n.song_id = r.song_id AND n.idx = r.idx + 1)""")
cte("kept_bars", "rep", "SELECT song_id, idx, unnest(adds) AS tm, odd FROM rep")
cte("last_bar", "kept_bars", "SELECT song_id, max(tm) AS last FROM kept_bars GROUP BY song_id")
cte("barline", "kept_bars last_bar tempo bdur", """
  SELECT song_id, tm, odd IS NOT NULL AS odd, row_number() OVER (PARTITION BY song_id ORDER BY tm) - 1 AS bar FROM (
    SELECT song_id, tm, odd FROM kept_bars
    UNION ALL SELECT l.song_id, l.last + d * unnest(range(1, CAST(ceil((dur - 0.5 * p - l.last) / d) AS BIGINT))), NULL FROM last_bar l JOIN tempo USING (song_id) JOIN bdur USING (song_id))""")
oracle("w11_bar_lines", "barline", f"SELECT song_id, CAST(bar AS INT) AS bar, {m6('tm')} AS at_e6 FROM barline")
oracle("a23_tempo_stats", "barline", f"""
  SELECT song_id, CAST(any_value(n) AS INT) AS n_bars, {m6('CASE WHEN count(gap) > 1 THEN stddev_pop(gap) / avg(gap) ELSE 0 END')} AS cv_e6, CAST(count(*) FILTER (odd) AS INT) AS n_irregular
  FROM (SELECT *, tm - lag(tm) OVER (PARTITION BY song_id ORDER BY tm) AS gap, count(*) OVER (PARTITION BY song_id) AS n FROM barline) GROUP BY song_id""")
