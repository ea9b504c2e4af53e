"""SentencePiece models through the tokenizers library: encoding and decoding of whole texts, with a parity check.

The model protobuf is parsed, and normaliser, white-space marker, scores (unigram) or merges in order of score (BPE) and
byte fallback are rebuilt as a tokenizers pipeline. As no piece holds the marker after another character (checked), a text
falls apart before each run of markers; a distinct unit is encoded once per worker, in multithreaded batches.

Models of type word or char, with user-defined pieces, or with the marker as suffix are refused. Null text is empty and
has no ids. Decoding turns ids back into UTF-8 bytes (byte pieces included), markers into spaces, and drops the leading
space that encoding added."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNITS = re.compile(rb" +[^ ]*")
_held: dict[tuple[str, int], "SentencePieces"] = {}


class SentencePieces:
    def __init__(self, path: str, threads: int = 2, most: int = 1_000_000):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            proto.ParseFromString(source.read())
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type not in (1, 2) or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces or any(t == USER for *_, t in self.pieces):
            raise ValueError("only unigram and BPE models with the marker as prefix and without user-defined pieces")
        self.prefix, self.plain = spec.add_dummy_prefix, not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if spec.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        self.model = Tokenizer(self._model(trainer))  # for units that are normal already
        self.full = Tokenizer(self._model(trainer))
        self.full.normalizer = self.normalizer
        self.separable = not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)
        self.as_bytes = [self._piece_bytes(p, t) for p, _, t in self.pieces]
        self.most, self.known = most, {}

    @classmethod
    def of(cls, path: str, threads: int) -> "SentencePieces":
        if (path, threads) not in _held:
            _held[path, threads] = cls(path, threads)
        return _held[path, threads]

    def _model(self, trainer):
        from tokenizers import models

        unknown = next(i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN)
        if trainer.model_type == 1:
            # control and unused pieces never match a text
            least = min(s for _, s, _ in self.pieces)
            vocabulary = [(p if t in (NORMAL, UNKNOWN, BYTE) else f"\0{i}", s if t == NORMAL else least - 10) for i, (p, s, t) in enumerate(self.pieces)]
            return models.Unigram(vocabulary, unknown, trainer.byte_fallback)
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        normal = {p for p, _, t in self.pieces if t == NORMAL}
        merges = [(-s, ids[a], ids[b], a, b) for p, s, t in self.pieces if t == NORMAL for k in range(1, len(p)) if (a := p[:k]) in normal and (b := p[k:]) in normal]
        return models.BPE(vocab=ids, merges=[m[3:] for m in sorted(merges)], unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=trainer.byte_fallback)

    @staticmethod
    def _piece_bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return " ⁇ ".encode() if kind == UNKNOWN else b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as unsigned 32-bit little-endian bytes."""
        if not (self.separable and self.plain and self.prefix):
            encoded = self.full.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in encoded]
        split = [self._units(t) for t in texts]
        known = self.known
        missing = list(set().union(*(set(units).difference(known) for units in split))) if split else []
        if missing:
            found = {}
            for k in range(0, len(missing), 8192):
                some = missing[k : k + 8192]
                encoded = self.model.encode_batch_fast([(u if u[:1] == b" " else b" " + u).decode().replace(" ", MARK) for u in some], add_special_tokens=False)
                found |= {u: np.array(e.ids, "<u4").tobytes() for u, e in zip(some, encoded)}
            if len(known) + len(found) <= self.most:
                known.update(found)
            else:
                known = {u: known[u] for units in split for u in units if u in known} | found
        get = known.__getitem__
        return [b"".join(map(get, units)) for units in split]

    @staticmethod
    def _units(text: bytes) -> list[bytes]:
        """Units without their one leading space; those with more spaces keep them all. The marker in a text is a space too."""
        if not text:
            return []
        text = text.replace(b"\xe2\x96\x81", b" ")
        if b"  " not in text and text[:1] != b" ":
            return text.split(b" ")
        return [u[1:] if u[1:2] != b" " else u for u in _UNITS.findall(b" " + text)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; bytes that are no UTF-8 become replacement characters."""
        out = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        out = out[1:] if self.prefix and out[:1] == b" " else out
        return out.decode("utf-8", "replace").encode()


def parity(path: str, texts: list[str]) -> list[int]:
    """Numbers of the texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), SentencePieces.of(path, 2)
    encoded = ours.encode([t.encode() for t in texts])
    expected = theirs.encode(texts)
    return [i for i, (a, b) in enumerate(zip(encoded, expected)) if np.frombuffer(a, "<u4").tolist() != b or ours.decode(a).decode() != theirs.decode(b)]


def encode_texts(docs: DataFrame, path: str, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (and the ids), text as decoded again, round_trip (decoded text equals the text)."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        import hashlib

        model = SentencePieces.of(path, threads)
        for part in parts:
            texts = [t or b"" for t in text_bytes(part["text"])]
            encoded = model.encode(texts)
            decoded = list(map(model.decode, encoded))
            out = {"doc_id": part["doc_id"], "n_ids": [len(e) // 4 for e in encoded], "ids_crc32": list(map(zlib.crc32, encoded))}
            out |= {"n_chars": [len(d.decode()) for d in decoded], "text_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}
            out |= {"round_trip": [a == b for a, b in zip(texts, decoded)]}
            if with_ids:
                out |= {"ids": [np.frombuffer(e, "<i4") for e in encoded], "decoded": [d.decode() for d in decoded]}
            yield out

    schema = "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_sha256 string, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    return map_texts(docs, ["doc_id", "text"], work, schema)
