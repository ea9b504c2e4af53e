"""Merkle manifest, source divergence and MinHash groups against brute force on the hard cases."""

import collections
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from cadenza.llm import divergence, links, merkle, minhash
from cadenza.llm.common import Scratch
from tests.llm.cases import SCHEMA, documents, frame, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- Merkle manifest ------------------------------------------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    return h(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)))


def plain_tree(leaves, arity):
    """(root, for each leaf the list of (before, after) sibling hashes)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for path, k in zip(paths, at):
            run = k // arity * arity
            path.append(("".join(level[run:k]), "".join(level[k + 1 : run + arity])))
        level = [h(*level[k : k + arity]) for k in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], paths


def plain_proofs(rows, arity):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    own = {x: plain_tree([leaf_of(r) for r in trees[x]], arity) for x in langs}
    root, tops = plain_tree([own[x][0] for x in langs], arity)
    out = []
    for x, top in zip(langs, tops):
        for r, path in zip(trees[x], own[x][1]):
            fold = leaf_of(r, more=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for before, after in path + top:
                fold = h(before, fold, after)
            out.append((r[0], leaf_of(r), own[x][0], root, h(*(a + b for a, b in path + top)), fold, fold == root))
    return collections.Counter(out)


@pytest.mark.parametrize("arity,levels", [(2, 8), (2, 1), (3, 2)])
def test_proofs(spark, arity, levels):
    rows = documents() + [(k, None, f"x{k % 5}", None, k) for k in range(100, 131)] + [(7, "again", "en", "a", 1)] * 3
    got = collections.Counter(map(tuple, merkle.proofs(frame(spark, rows), arity=arity, levels=levels).collect()))
    assert got == plain_proofs(rows, arity)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "en", None, 2), (2, "b", "en", None, 2)]])
def test_proofs_of_small_tables(spark, rows):
    assert collections.Counter(map(tuple, merkle.proofs(frame(spark, rows)).collect())) == (plain_proofs(rows, 2) if rows else {})


def test_ranks_of_one_hot_tree(spark):
    """A tree over many partitions and equal rows: ranks are a numbering without gaps."""
    leaves = spark.range(5000).selectExpr("'+en' as tree", "id as row", "id % 7 as doc_id", "sha2(string(id % 3), 256) as hash").repartition(8)
    scratch = Scratch(spark)
    got = merkle.ranked(scratch.stage(leaves, "leaves"), ["doc_id", "hash"], scratch).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(5000)) and {r["size"] for r in got} == {5000}
    assert [(r.doc_id, r.hash, r.row) for r in got] == sorted((r.doc_id, r.hash, r.row) for r in got)


# -- source divergence ----------------------------------------------------------------------------------------------------


def plain_audit(rows, least_docs, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in of for t in set(d[2]))
        kept = {t for t in df if df[t] >= least_docs}
        count = collections.defaultdict(collections.Counter)
        for _, source, terms in of:
            count[source].update(t for t in terms if t in kept)
        whole = sum(count.values(), collections.Counter())

        def p(c):
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        q = p(whole)
        shares = {s: p(c) for s, c in count.items()}
        for s in shares:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in shares if o != s]
            terms = [(t, shares[s][t] - q[t]) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("cells,held,least", [(100_000, 400_000, 30), (12, 4, 2)])
def test_audit(spark, monkeypatch, cells, held, least):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = documents() + [(300 + k, prose(k, 40) + " ÀÉ straße naïve", "de", f"s{k % 5}", 0) for k in range(60)] + [(1, "only", "xx", "a", 0), (2, None, "xx", "b", 0)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), least_docs=least, top=7).collect())) == plain_audit(rows, least, 7)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


# -- MinHash --------------------------------------------------------------------------------------------------------------


def plain_sets(rows):
    out = []
    for r in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(r[1])) if w]
        out.append({" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set())
    return out


def plain_groups(rows):
    sets, root = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return collections.Counter((r[0], len(s), c := least.get(find(i)), r[0] == c) for i, (r, s) in enumerate(zip(rows, sets)))


def changed(text, seed, n):
    words, rng = text.split(), np.random.default_rng(seed)
    for k in rng.integers(0, len(words), n):
        words[k] = f"w{seed}x{k}"
    return " ".join(words)


@pytest.mark.parametrize("rounds,small,block", [(5, 64, 1024), (1, 2, 3)])
def test_groups(spark, monkeypatch, rounds, small, block):
    monkeypatch.setattr(links, "ROUNDS", rounds)
    monkeypatch.setattr(links, "SMALL", small)
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "OPEN", 0)
    monkeypatch.setattr(links, "EDGES", links.EDGES if rounds > 1 else 9)
    base = prose(1000, 400)
    rows = documents() + [(400 + k, changed(base, k, k), "en", "a", 0) for k in range(40)] + [(500, base.upper(), "en", "a", 0), (500, base, "en", "a", 0)]
    rows += [(600 + k, changed(prose(2000, 30), k, 1), "en", "a", 0) for k in range(30)]
    assert collections.Counter(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == plain_groups(rows)


def test_groups_of_an_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 30, 700, 5000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    equal = []
    with np.errstate(over="ignore"):
        for _ in range(40):
            one = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = minhash.sketch(one[: n + n // 2]), minhash.sketch(one[n // 2 :])  # similarity of about n / 2n
            assert (a >> np.uint64(48) < 2 * minhash.SIZE).all()
            equal.append((a == b).mean())
            assert (minhash.sketch(one[:n][::-1]) == minhash.sketch(one[:n])).all()
    union, shared = 2 * n, 2 * (n // 2) + n - 2 * (n // 2) + (n // 2 - n // 2)
    shared = (n + n // 2) - n // 2
    assert abs(np.mean(equal) - shared / union) < 0.05


def test_screen_loses_no_similar_pair():
    rng = np.random.default_rng(5)
    measure = links.Measure(2, 80, 100)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = one[rng.random(len(one)) < rng.uniform(0.6, 1)]
        two = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        may = measure.may_be(links.bits_apart(links.parity(one), links.parity(two)), len(one) + len(two))
        assert may or not measure.similar(one, two)
        ruled_out += not may
    assert ruled_out > 100


@pytest.mark.parametrize("block,most", [(1024, 59), (20, 59 * 6)])
def test_a_group_of_near_copies_leaves_fewer_links_than_nodes(spark, monkeypatch, block, most):
    import zstandard

    monkeypatch.setattr(links, "BLOCK", block)
    base, pack = prose(4000, 400), zstandard.ZstdCompressor().compress
    texts = [changed(base, k, 4).lower().encode() for k in range(60)]
    sets = [links.shingle_set(t, 2) for t in texts]
    nodes = spark.createDataFrame([(k, len(s), links.parity(s), pack(t)) for k, (s, t) in enumerate(zip(sets, texts))], "node long, n int, bits binary, packed binary")
    rows = spark.createDataFrame([(7, k, len(s), k) for k, s in enumerate(sets)], "h long, node long, n int, root long")
    found = links.block_links(rows, nodes, links.Measure(2, 80, 100)).collect()
    assert 59 <= len(found) <= most
    parent = list(range(60))
    for a, b in sorted(map(tuple, found)):
        one, two = parent[a], parent[b]
        parent = [two if p == one else p for p in parent]
    assert len(set(parent)) == 1


@pytest.mark.parametrize("block", [1024, 20])
def test_texts_follow_only_nodes_that_bitmaps_leave(spark, monkeypatch, block):
    """60 unlike texts and one pair of near copies in a bucket: the pair's texts move, and it is linked as before."""
    import zstandard

    monkeypatch.setattr(links, "BLOCK", block)
    pack = zstandard.ZstdCompressor().compress
    texts = [prose(4000 + k, 400).lower().encode() for k in range(60)] + [changed(prose(4000, 400), 1, 4).lower().encode()]
    sets = [links.shingle_set(t, 5) for t in texts]
    nodes = spark.createDataFrame([(k, len(s), links.parity(s), pack(t)) for k, (s, t) in enumerate(zip(sets, texts))], "node long, n int, bits binary, packed binary")
    rows = spark.createDataFrame([(7, k, len(s), k) for k, s in enumerate(sets)], "h long, node long, n int, root long")
    measure = links.Measure(5, 4, 5)
    few = links.promising(rows, nodes, measure)
    assert sorted(r.node for r in few.collect()) == [0, 60] and few.columns == rows.columns
    assert [tuple(r) for r in links.block_links(few, nodes, measure).collect()] == [(0, 60)]
