"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnscope.llm.common import with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Words whose pieces a worker remembers; others are searched each time.
REMEMBERED = 300_000


def read_pieces(path: str) -> list[tuple[str, float, str]]:
    """Piece, score and kind (``piece``, ``byte`` or ``other``) by id. The size is the vocabulary's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        odd = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append((model.id_to_piece(i), model.get_score(i), "other" if odd else "byte" if model.is_byte(i) else "piece"))
    return out


class Codec(dict):
    """Piece ids of words, as bytes of 32-bit numbers.

    A word stands for a blank and its characters, or, if it starts with a line feed, for itself. No
    piece crosses from another character to a blank, and a line feed is in no piece, so the best
    pieces of a text are those of its words; where a vocabulary breaks this, texts are searched whole.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known = {}
        self.byte_ids = {}
        self.surface: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "piece":
                known[piece] = (len(piece), score, i)
            if kind == "byte":
                self.byte_ids[int(piece[1:-1], 16)] = i
            self.surface.append(bytes([int(piece[1:-1], 16)]) if kind == "byte" else piece.replace(SPACE, " ").encode() if kind == "piece" else b"")
        for piece, value in known.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s, _ in known.values()), default=0.0) - 10
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in known)

    def __missing__(self, word: str) -> bytes:
        found = self.search(SPACE + word) if word[:1] != "\n" else self.fallback("\n") + self.search(word[1:])
        found = np.array(found, np.int32).tobytes()
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def search(self, text: str) -> list[int]:
        """Ids of the best segmentation. Outputs of the automaton at a position are the pieces that
        end there; each relaxes the best score. Of equal scores the longest piece is taken. A character
        that is no piece of its own can always be spelt in bytes."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, value in self.automaton.iter(text):
            ends[end].append(value)
        best, step = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for end, values in enumerate(ends):
            top, how = -1e300, None
            for size, score, piece in values:
                score += best[end + 1 - size]
                if score > top or score == top and size > how[0]:
                    top, how = score, (size, piece)
            if not any(v[0] == 1 for v in values) and best[end] + self.unknown > top:
                top, how = best[end] + self.unknown, (1, -1)
            best[end + 1], step[end + 1] = top, how
        out: list[list[int]] = []
        while n:
            size, piece = step[n]
            out.append([piece] if piece >= 0 else self.fallback(text[n - 1]))
            n -= size
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str) -> bytes:
        """A blank is put before the text. A literal piece blank is spelt in bytes."""
        if not text:
            return b""
        if self.splits and "  " not in text and text[0] not in " \n" and SPACE not in text:
            return b"".join(map(self.__getitem__, text.replace("\n", " \n").split(" ")))
        out = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out += self.fallback(SPACE)
            part = (SPACE if k == 0 else "") + part.replace(" ", SPACE)
            for run in re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", part) if self.splits else [part]:
                out += self.search(run)
        return np.array(out, np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """One codec for every worker process and vocabulary."""
    key = hash((len(shared.value), *shared.value[-1]))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def encode_pieces(documents: DataFrame, *, text: str = "text", model: str = MODEL, ids: str = "piece_ids") -> DataFrame:
    """Add ``ids``, the piece ids of every whole text.

    Scores of the vocabulary make the best segmentation; characters outside of it are spelt in bytes,
    so decoding restores every text. Null texts have null ids, empty texts none. All other columns
    stay; a column of the same name is replaced. The vocabulary is read by the driver and sent to the
    workers; its size does not depend on the data.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_pieces(model))
    out = documents.drop(ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(text).to_pylist()
                found = [codec.encode(t) if t is not None else None for t in texts]
                ends = np.cumsum([0, *(len(f or b"") // 4 for f in found)])
                values = pa.array(np.frombuffer(b"".join(f or b"" for f in found), np.int32))
                mask = pa.array([f is None for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)], [*batch.schema.names, ids])

    return out.mapInArrow(encode, with_fields(out, **{ids: T.ArrayType(T.IntegerType())}))


def decode_pieces(encoded: DataFrame, *, ids: str = "piece_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add ``text``, decoded from the piece ids. Null ids give null, none the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_pieces(model))
    out = encoded.drop(text)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                column = batch.column(ids)
                texts = [None if not column[i].is_valid else codec.decode(column[i].values.to_numpy()) for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return out.mapInArrow(decode, with_fields(out, **{text: T.StringType()}))
