import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import idfiles, packing, sentencepieces
from cadenza.llm.queries import PIECES, tokenizer_path
from cadenza.llm.tokens import WordIds
from tests.llm.cases import documents, frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["don't", "é,", "İx.", "a</w>", "<|endoftext|>", "\n", "x..", "'s", "ŉ", "A1b", " "]), max_size=8).map(" ".join))
def test_word_memory_gives_the_tokenizers_ids(text):
    words = WordIds.of(tokenizer_path())
    assert words.texts([text.encode()])[0] == words.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=40))
def test_plan_uses_every_piece_once(capacity, lengths):
    counts = collections.Counter(min(x, capacity) for x in lengths)
    plan = packing.plan_bins(counts, capacity, nodes=500)
    used = collections.Counter()
    for bins, filling in plan:
        assert bins > 0 and sum(filling) <= capacity
        for x in filling:
            used[x] += bins
    assert used == counts
    n = sum(b for b, _ in plan)
    assert packing.lower_bound(counts, capacity) <= n <= sum(b for b, _ in packing.best_fit(counts, capacity))


def test_plan_beats_best_fit_where_it_can():
    # best fit puts 6+3 first and needs three bins; two suffice
    counts = {6: 1, 5: 1, 3: 1, 2: 1, 4: 1}
    assert sum(b for b, _ in packing.plan_bins(counts, 10)) == 2


def brute_best(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k]:
                place(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(2, 20), max_size=9))
def test_plan_is_near_the_optimum_on_small_inputs(lengths):
    plan = packing.plan_bins(collections.Counter(lengths), 20)
    assert sum(b for b, _ in plan) - brute_best(sorted(lengths, reverse=True), 20) in (0, 1)


def test_packed_pieces(spark, tokenizer):
    rows = [r.asDict() for r in packing.pack_documents(frame(spark), tokenizer_path(), 512, 1).collect()]
    expected = collections.Counter()
    for doc_id, text, *_ in documents():
        ids = ids_of(tokenizer, text, 1)
        for k in range(0, len(ids), 512):
            expected[doc_id, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) == -(-sum(r["length"] for r in rows) // 512)


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(k, f"word{k} and more", "en", "a", 0) for k in range(9)]
    out = packing.sequences(frame(spark, rows), tokenizer_path(), 16).collect()
    got = {}
    for r in out:
        for d, a, b in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], len(r["ids"])]):
            got[d] = r["ids"][a:b]
    assert got == {d: ids_of(tokenizer, t, 1) for d, t, *_ in rows}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    folder = idfiles.write_ids(none, tokenizer_path())
    assert idfiles.read_ids(spark, folder).count() == 0
    assert sentencepieces.encode_texts(none, tokenizer_path(PIECES)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 300), max_size=700))
def test_elias_fano_round_trip_and_select(values):
    values = sorted(values)
    coded = idfiles.EliasFano.from_bytes(idfiles.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.all().tolist() == values
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.full(100_000, 700))
    assert len(idfiles.EliasFano.of(values).to_bytes()) < 100_000 * 13 / 8


@pytest.mark.parametrize("file_ids", [200, 1 << 22])
def test_id_files(spark, tokenizer, monkeypatch, file_ids):
    monkeypatch.setattr(idfiles, "FILE_IDS", file_ids)
    folder = idfiles.write_ids(frame(spark), tokenizer_path(), end_id=2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in idfiles.read_ids(spark, folder, with_ids=True).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((d for d, *_ in documents()), key=lambda d: (d is not None, d))
    at = 0
    for start, _, n, check, ids in got:
        assert start == at and n == len(ids) and check == crc(ids)
        at += n
    expected = collections.Counter((d, tuple(ids_of(tokenizer, t, 2))) for d, t, *_ in documents())
    assert collections.Counter((d, tuple(ids)) for _, d, _, _, ids in got) == expected


def test_one_document_by_select():
    file = idfiles.IdFile(idfiles.IdFile.pack([None, 4, 4, 900], [np.array(x, "<u4").tobytes() for x in ([1, 70000], [], [2], [3, 4, 5])]))
    assert file.doc_ids() == [None, 4, 4, 900]
    assert [file.document(i).tolist() for i in range(4)] == [[1, 70000], [], [2], [3, 4, 5]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=50) | st.lists(st.sampled_from(["the", " ", "  ", "▁", "\n", "aaaa", "über", "<s>", "<0x41>", "日本", "\U0001f600", "."]), max_size=12).map("".join))
def test_sentencepiece_parity(text):
    assert sentencepieces.parity(tokenizer_path(PIECES), [text]) == []


def test_sentencepiece_table(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    rows = sentencepieces.encode_texts(frame(spark), tokenizer_path(PIECES)).collect()
    expected = collections.Counter((d, tuple(theirs.encode(t or ""))) for d, t, *_ in documents())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected
    assert all(r.round_trip and r.n_ids == len(r.ids) and r.ids_crc32 == crc(r.ids) for r in rows)
    assert collections.Counter((r.doc_id, r.decoded) for r in rows) == collections.Counter((d, t or "") for d, t, *_ in documents())


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model written by hand (no training): scores decide between segmentations."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("abc", -9.0, 1), ("c", -3.5, 1), ("bc", -5.5, 1)]
    for piece, score, kind in pieces:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert sentencepieces.parity(str(path), ["abc", "ab bc", "cab abca", "", "a  b"]) == []


def test_search_goes_on_after_a_better_packing(monkeypatch):
    """From a bad incumbent and with the worst fillings first, improved packings lead on to the best one."""
    fillings = packing.fillings
    monkeypatch.setattr(packing, "best_fit", lambda counts, capacity: [(1, (x,)) for x, n in counts.items() for _ in range(n)])
    monkeypatch.setattr(packing, "fillings", lambda *a: [*fillings(*a), ()][::-1])
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}
    assert sum(n for n, _ in packing.plan_bins(counts, 10)) == 4 == packing.lower_bound(counts, 10)
