"""Exact SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick pass gives the longest piece at every position of a word. Encoding walks from the left: it takes the longest
piece, or the next shorter one that is its prefix, which is compatible with the piece before it; two pieces are compatible if
merging their joined characters anew gives just these two. Where no piece fits, the last one is taken back and its end is
marked in a bitfield of failed positions, so no position fails twice. A sequence of pairwise compatible pieces is the
sequence that merging by score would give. Characters outside the vocabulary end a stretch and become byte pieces.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from accord.llm.common import mapped, table, with_texts
from accord.llm.wordcache import WordCache

SPACE = "▁"


class PieceEncoder:
    """Encoder for a BPE model with byte fallback, a dummy prefix and pieces that hold the space mark only in front."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.get_piece_size()
        skip = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(n)]
        self.ids = {self.model.id_to_piece(i): i for i in range(n) if not skip[i]}
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.known = {p for p in self.ids if len(p) == 1}
        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.finder.add_word(p, (len(p), i))
        self.finder.make_automaton()
        #: Of each id: the characters of its piece, and the id of the longest piece that begins it (-1: none).
        self.size, self.shorter = [0] * n, [-1] * n
        for p, i in self.ids.items():
            self.size[i] = len(p)
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.shift = n.bit_length()
        self.compatible = WordCache(self._compatible, 100_000)
        self.words = WordCache(self._word, 250_000)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or self.model.encode("a") != self.encode_stretch(SPACE + "a"):
            raise ValueError("pieces with an inner space mark, or no dummy prefix")
        self.lines = not any("\n" in p for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by score gives: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        left, right = (self.model.id_to_piece(i) for i in (pair >> self.shift, pair & (1 << self.shift) - 1))
        return self.merged(left + right) == [left, right]

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a text without blanks; characters that no piece stands for split it, and become bytes."""
        longest = [-1] * len(text)
        for end, (size, piece) in self.finder.iter(text):
            longest[end + 1 - size] = piece  # the matches of a start come with rising ends
        if self.known.issuperset(text):
            return self._backtrack(longest, 0, len(text))
        out: list[int] = []
        start = 0
        for k, x in enumerate(text):
            if x not in self.known:
                out += self._backtrack(longest, start, k)
                out += [self.bytes[b] for b in x.encode()]
                start = k + 1
        return out + self._backtrack(longest, start, len(text))

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        taken: list[int] = []
        failed = None  # a byte for each position that no sequence may end a piece at
        size, shorter, compatible, shift = self.size, self.shorter, self.compatible, self.shift
        at, before = start, -1
        piece = longest[at] if at < stop else -1
        while at < stop:
            while piece >= 0:
                end = at + size[piece]
                if end <= stop and not (failed and failed[end - start]) and (before < 0 or compatible[before << shift | piece]):
                    break
                piece = shorter[piece]
            if piece < 0:
                if failed is None:
                    failed = bytearray(stop - start + 1)
                failed[at - start] = 1
                if not taken:
                    raise ValueError("a stretch that merging can't give")
                piece = taken.pop()
                at -= size[piece]
            else:
                taken.append(piece)
                at += size[piece]
                before = piece
                piece = longest[at] if at < stop else -1
                continue
            before = taken[-1] if taken else -1
        return taken

    def _word(self, word: str) -> tuple[str, tuple[int, ...]]:
        """A part between spaces: with the mark in front, or after a line end without. Leading blanks of the key are further spaces."""
        ids = self.encode_stretch(word if word[:1] == "\n" else SPACE + word.replace(" ", SPACE))
        return ",".join(map(str, ids)), tuple(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text, as keys of self.words; no piece can stand across two of them."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            parts = line.split(" ")
            if k:
                parts[0] = "\n" + parts[0]
            if "" in parts:
                blanks = 0
                for part in parts[:-1]:
                    if part:
                        out.append(" " * blanks + part)
                        blanks = 0
                    else:
                        blanks += 1
                out.append(" " * blanks + parts[-1])
            else:
                out += parts
        return out

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in map(self.words.__getitem__, self.split(text)) for i in ids]

    def encode_with_digest(self, text: str) -> tuple[list[int], str]:
        """Ids, and the lowercase hex SHA-256 of the decimal ids joined by commas."""
        pairs = list(map(self.words.__getitem__, self.split(text)))
        return [i for _, ids in pairs for i in ids], hashlib.sha256(",".join([s for s, _ in pairs]).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """One encoder for each model and worker process; its caches outlive tasks, as most words of a task are those of others."""
    if model_path not in _ENCODERS:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        _ENCODERS[model_path] = PieceEncoder(model_path)
    return _ENCODERS[model_path]


def encoded(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, decoded of every document. Null and empty texts have no ids and decode to the empty text. Other columns play no part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = encoder(model_path)
        ids = [model.encode(x or "") for x in batch.column("text").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([model.decode(x) for x in ids], pa.string())})

    return mapped(with_texts(documents), run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """encoded() with digests in place of the ids and the decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        model = encoder(model_path)
        n, of_ids, of_text = [], [], []
        for x in batch.column("text").to_pylist():
            ids, digest = model.encode_with_digest(x or "")
            n.append(len(ids))
            of_ids.append(digest)
            of_text.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    return mapped(with_texts(documents), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `documents`.

    Null and empty texts have no ids and decode to the empty text. Texts are encoded whole. Pieces of equal scores merge from
    the left, as in the library. Repeated rows and null doc_ids come back as they are; an empty table gives an empty one; other
    columns play no part.
    """
    return encoded_digests(table(spark, sf_dir, "documents"), default_model())
