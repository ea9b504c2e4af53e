"""Fingerprint groups, repeated windows, license scan, quality rules and the pipeline against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cadenza.llm import licenses, links, packing, quality, shingles, simhash, substrings
from cadenza.llm.common import Scratch
from cadenza.llm.queries import tokenizer_path
from tests.llm.cases import SCHEMA, documents, frame, prose

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


# -- fingerprints ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    rows = documents() + [(200 + k, prose(77, 300).replace("aing", f"x{k}", 1), "en", "a", 0) for k in range(12)]
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(fps, 4)
    least = {g: min((r[0] for r, x in zip(rows, groups) if x == g and r[0] is not None), default=None) for g in groups}
    assert got == collections.Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups))


@pytest.mark.parametrize("bits,blocks", [(4, 3), (4, 1), (7, 4)])
def test_trees_lose_no_link(spark, monkeypatch, bits, blocks):
    """Clusters and chains of near fingerprints, with small shards, salted homes and a small sample."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "SAMPLE", 300)
    rng = np.random.default_rng(bits)
    fps = set(int(x) for x in rng.integers(0, 1 << 63, 500))
    for centre in list(fps)[:40]:
        for _ in range(8):
            step = centre
            for b in rng.integers(0, 64, rng.integers(1, bits + 2)):
                step ^= 1 << int(b)
            fps.add(step & (1 << 64) - 1)
            centre = step
    base = int(rng.integers(0, 1 << 62))
    fps |= {base ^ 1 << a ^ 1 << b for a in range(24) for b in range(24)}  # one hot cluster
    fps = sorted(fps)
    table = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(fps)], "doc_id long, _fp long")
    got = {r.doc_id: r.root for r in simhash.group(table, bits, blocks).collect()}
    groups = plain_groups(fps, bits)
    assert len({(groups[k], got[k]) for k in range(len(fps))}) == len(set(groups)) == len(set(got.values()))


def test_keep_one_of_each_group(spark):
    kept = simhash.keep_one(frame(spark)).collect()
    groups = plain_groups([plain_fingerprint(r[1]) for r in documents()], 4)
    assert len(kept) == len(set(groups)) and kept[0].row == "mine"
    assert collections.Counter(r.doc_id for r in kept)[8] == 1 and {1} <= {r.doc_id for r in kept} and 2 not in {r.doc_id for r in kept}
    assert simhash.keep_one(frame(spark, [])).count() == 0


# -- repeated windows -----------------------------------------------------------------------------------------------------


def plain_removal(rows, window):
    words = [words_of(r[1]) for r in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_repeated_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2000)
    shared = prose(500, 70)
    rows = documents() + [(300 + k, f"{prose(300 + k, 40)} {shared} {prose(900 + k, k)}", "en", "a", 0) for k in range(30)]
    rows += [(400, " ".join(f"{prose(41, 50)}" for _ in range(2)), "en", "a", 0), (401, "x " * 2000, "en", "a", 0), (402, "y " * 35 + "z", "en", "a", 0)]
    got = substrings.remove_repeats(frame(spark, rows), hot=hot).collect()
    expected = collections.Counter((r[0], *x) for r, x in zip(rows, plain_removal(rows, 35)))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    assert got[0].row == "mine"


def test_spaced_text_keeps_its_lines(spark):
    shared = prose(1, 40)
    rows = [(1, f"a b\n\nc {shared}\n d\te", "en", "a", 0), (2, f"{shared} f", "en", "a", 0), (3, " g\n", "en", "a", 0), (4, None, "en", "a", 0)]
    got = {r.doc_id: r.text for r in substrings.remove_repeats(frame(spark, rows), spaced=True).collect()}
    assert got == {1: "a b\n\nc\n d\te", 2: "f", 3: " g\n", 4: None}
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_index_counts_places():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 4, n) for n in (9, 30, 5, 12, 30)]
    weights = np.array([1, 2, 1, 1, 3])
    index = substrings.FmIndex(pieces, weights, 4)
    for length in (1, 2, 3, 5):
        for p, piece in enumerate(pieces):
            for k in range(len(piece) - length + 1):
                low, high = np.array([0]), np.array([len(index.text)])
                for c in piece[k : k + length][::-1]:
                    low, high = index.extend(np.array([c + len(pieces)]), low, high)
                places = sum(w for x, w in zip(pieces, weights) for j in range(len(x) - length + 1) if (x[j : j + length] == piece[k : k + length]).all())
                assert index.weight[high[0]] - index.weight[low[0]] == places


# -- licenses -------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    notice = licenses.TEMPLATES[1][2]
    changed = notice.replace("free of charge,", "free of any charge whatsoever,").replace("merge, publish,", "")
    rows = documents() + [(500, "MIT license mit License\nmit-license", "en", "a", 0), (501, changed, "en", "a", 0), (502, " ".join(notice.split()[:12]), "en", "a", 0), (503, "Licensed under CC BY-NC 4.0.", "en", "a", 0), (504, (prose(4, 50) + " apache license ") * 40, "en", "a", 0)]
    got = collections.defaultdict(list)
    for r in licenses.summary(licenses.scan(frame(spark, rows))).collect():
        got[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        places = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        for r in got[doc_id]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
            assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert len(got[8]) == 2 and got[501][0].labels == "mit" and got[501][0].score > 0.8
    assert got[502][0].labels == "" and got[503][0].labels == "cc-by-nc"
    assert licenses.summary(licenses.scan(frame(spark, []))).count() == 0


def test_lightly_edited_notices(spark):
    """One word inserted at every place, two and three inserted or missing, alone and in prose full of the notices' word pairs."""
    rows, labels = [], {}
    filler = " ".join(f"w{k} of the software w{k} this software w{k} the license" for k in range(150))
    for t, name in ((1, "mit"), (3, "apache"), (5, "gpl"), (6, "bsd")):
        words = [w.decode() for w in licenses.words_of(licenses.TEMPLATES[t][2].encode())]
        n = len(words)
        cuts = [[k] for k in range(1, n)] + [[n // 2 - k, n // 2 + k] for k in (1, 4, 7)] + [[n // 4, n // 2, 3 * n // 4]]
        for at in cuts:
            more = [w for k, w in enumerate(words) for w in ([f"new{k}"] if k in at else []) + [w]]
            less = [w for k, w in enumerate(words) if k not in at]
            for text in (" ".join(more), " ".join(less), f"{filler} {' '.join(more)} {filler}"):
                labels[len(rows)] = name
                rows.append((len(rows), text, "en", "a", 0))
    rows.append((-1, filler, "en", "a", 0))
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[-1].labels == ""
    assert {k: name for k, name in labels.items() if name not in got[k].labels.split(",") or got[k].score < 0.8} == {}


# -- quality rules --------------------------------------------------------------------------------------------------------


def plain_stats(text):
    words, text = words_of(text), text or ""
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    rows = documents() + [(600, "a b c a b c a b\na b\n a b\na b\n\n", "en", "a", 0), (601, "# * $ | < > & %%", "en", "a", 0)]
    got = quality.judge(frame(spark, rows)).select("doc_id", *quality.STATS, "base_failed").collect()
    expected = collections.Counter((r[0], *(s := plain_stats(r[1])), s[0] < 50 or 100 * s[4] > 50 * s[0]) for r in rows)
    assert collections.Counter(tuple(r) for r in got) == expected
    assert quality.judge(frame(spark, [])).count() == 0


def test_outliers_of_a_source_are_rejected(spark):
    rng = np.random.default_rng(1)
    rows = [(k, prose(k, int(rng.integers(60, 300))), "en", ["a", "b", None][k % 3], 0) for k in range(300)]
    rows += [(1000 + k, " ".join(f"{w}###" for w in prose(k, 90).split()), "en", "a", 0) for k in range(20)]
    rows += [(2000 + k, prose(k, 90).upper().replace(" ", "!! "), "en", "b", 0) for k in range(20)]
    rows += [(3000, prose(1, 80), "xx", "lonely", 0)]
    good = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert good == set(range(300)) | {3000}


def test_junk_signs_are_outliers(spark):
    """Six symbols in ten words are no prose."""
    rows = [(k, prose(k, 100 + k % 90), "en", "a", 0) for k in range(200)]
    rows += [(1000 + k, " ".join(w + "#" * (j % 10 < 6) for j, w in enumerate(prose(k, 100).split())), "en", "a", 0) for k in range(10)]
    assert {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(200))


def test_determinant_estimates_match_numpy(spark):
    """One group, one concentration step from known distances: mean and covariance of the nearest share."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.D))
    d2 = (x**2).sum(axis=1)
    table = spark.createDataFrame([("g", *map(float, r), float(d)) for r, d in zip(x, d2)], ", ".join(["cell string", *(f"x{i} double" for i in range(quality.D)), "d2 double"]))
    got = quality._concentrate(table, 0.75).first()
    bins = np.floor(16 * np.log2(d2 + 1e-6))
    limit = np.sort(bins)[int(np.ceil(0.75 * 400)) - 1]
    near = x[bins <= limit]
    cov = quality.consistency(0.75) * np.cov(near.T, bias=True) + np.diag([f**2 for _, f in quality.VECTOR.values()])
    assert np.allclose([got[f"m{i}"] for i in range(quality.D)], near.mean(axis=0))
    assert np.allclose([got[f"c{i}{j}"] for i in range(quality.D) for j in range(i + 1)], [cov[i, j] for i in range(quality.D) for j in range(i + 1)])
    estimate = quality._concentrate(table, 0.75)
    far = quality._with_distance(table.drop("d2"), estimate).orderBy("x0").collect()
    inverse = np.linalg.inv(cov)
    order = np.argsort(x[:, 0])
    assert np.allclose([r.d2 for r in far], [(r - near.mean(axis=0)) @ inverse @ (r - near.mean(axis=0)) for r in x[order]])


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.05, 6) - 12.5916) < 1e-3 and abs(quality.chi2_cdf(3.3567, 4) - 0.5) < 1e-3


def test_quality_plan_is_native(spark):
    plan = quality.judge(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = [(k, prose(k, 70 + k), "en", "a", 0) for k in range(60)]
    passage = prose(999, 55)
    rows += [(100, f"{prose(100, 80)}\n{passage} {prose(101, 60)}", "en", "a", 0), (101, f"{prose(102, 90)} {passage}", "en", "a", 0)]
    rows += [(200, rows[5][1], "en", "a", 0), (201, rows[5][1] + " end", "en", "a", 0), (202, edited(rows[50][1], 202, 2), "en", "a", 0), (300, "too short", "en", "a", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if len(words_of(r[1])) >= 50]
    groups = plain_similar(good)
    kept = [r for k, r in enumerate(good) if k == min(j for j, g in enumerate(groups) if g == groups[k])]
    assert {200, 201} & {r[0] for r in kept} == set() and {100, 101} <= {r[0] for r in kept}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = {}
    for r, (n, gone, _) in zip(kept, plain_removal(kept, 35)):
        text = r[1].replace(passage, "") if gone else r[1]
        assert gone in (0, 55)
        sizes[r[0]] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.length for r in got} == sizes
    assert len({r.sequence_id for r in got}) == packing.lower_bound(collections.Counter(sizes.values()), 4096)


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


# -- similar documents ----------------------------------------------------------------------------------------------------


def plain_similar(rows):
    """Group (smallest index) of each row by five-word shingles of similarity 0.8 or more."""
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(r[1])] for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(text, seed, n):
    """The text with n words replaced."""
    words = text.split()
    for k in np.random.default_rng(seed).choice(len(words), n, replace=False):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


@pytest.mark.parametrize("most,rounds,bits", [(links.OPEN, links.ROUNDS, shingles.MOST_BITS), (0, 1, 64)])
def test_similar_documents_keep_one(spark, monkeypatch, most, rounds, bits):
    """Edited copies on both sides of 0.8, chains, a hot group, and documents that only share a long passage."""
    monkeypatch.setattr(links, "OPEN", most)
    monkeypatch.setattr(links, "ROUNDS", rounds)
    monkeypatch.setattr(shingles, "MOST_BITS", bits)  # full: nearly all rows may be meant
    rows = documents() + [(1000 + k, prose(1000 + k, 200), "en", "a", 0) for k in range(20)]
    rows += [(2000 + 10 * k + n, edited(prose(1000 + k, 200), k * 10 + n, n), "en", "a", 0) for k in range(20) for n in (1, 3, 4, 5, 7)]
    rows += [(3000 + k, edited(prose(5, 120), k, k % 3), "en", "a", 0) for k in range(80)]
    rows += [(4000 + k, f"{prose(6, 90)} {prose(4000 + k, 60)}", "en", "a", 0) for k in range(30)]
    groups = plain_similar(rows)
    assert len(set(groups)) < len(rows) - 60
    kept = shingles.keep_one(frame(spark, rows)).collect()
    expected = [min((r[0] is None, r[0] or 0) for r, g in zip(rows, groups) if g == group) for group in sorted(set(groups))]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(expected) and kept[0].row == "mine"
    assert {4000 + k for k in range(30)} <= {r.doc_id for r in kept}
    assert shingles.keep_one(frame(spark, [])).count() == 0


def test_pipeline_drops_edited_copies(spark):
    """Six words changed leave a similarity over 0.8 and more than four bits."""
    docs = spark.createDataFrame([(1, prose(1, 300), "en", "a", 0), (2, edited(prose(1, 300), 2, 6), "en", "a", 0), (3, prose(3, 300), "en", "a", 0)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [1, 3]


def test_near_copies_meet_by_fingerprints_first(spark):
    """A long copy with one word changed is paired by its SimHash fingerprint, an unlike text is not."""
    docs = spark.createDataFrame([(1, prose(1, 3000), "en", "a", 0), (2, edited(prose(1, 3000), 2, 1), "en", "a", 0), (3, prose(3, 300), "en", "a", 0)], SCHEMA)
    scratch = Scratch(spark)
    table = scratch.stage(shingles.numbered(docs), "numbered")
    node = {r.doc_id: r["_node"] for r in table.collect()}
    pairs = shingles.near_prints(table, table.select("_row"), scratch).collect()
    assert [tuple(p) for p in pairs] == [tuple(sorted((node[1], node[2])))]
