"""SentencePiece encoding of a merge-type model by backtracking, and decoding.

Merging the best pair first gives the only sequence of pieces in which every two
neighbours, merged anew from their characters, give these two pieces again. So a text is
read from left to right: the longest piece that starts at a place (found for all places
at once by an Aho-Corasick automaton over the reversed pieces) is taken if it fits the
piece before it; else its next shorter prefix is tried. A place where no piece fits is
marked in a bitfield, the last piece is taken back and its shorter prefixes follow, so
each place fails once. Characters without a piece never merge and become their bytes.

No merge crosses a boundary that no piece holds. No piece of such a model holds a blank
behind another character, nor a letter beside a mark, so texts fall into blanks and the
word or marks behind them, and what was found for one is kept for its next occurrence. A
model with a blank inside a piece is read text by text instead.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
REPLACEMENT = "�"
KEPT_WORDS = 1 << 19
KEPT_CHARS = 64
KEPT_PAIRS = 1 << 18
NEVER = float("-inf")
OUT_BYTES = 4 << 20
# The piece types of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class Model:
    """Pieces of a model file in the order of their ids, as executors get them."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    end: int
    unknown_text: str
    led: bool

    @classmethod
    def read(cls, path: str) -> Model:
        """Model at ``path`` on the driver; one this module cannot follow exactly is refused."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep all characters of the text are supported")
        kinds = [p.type for p in proto.pieces]
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        model = cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kinds, trained.eos_id, trained.unk_surface, rules.add_dummy_prefix)
        known = {p for p, kind in zip(model.pieces, kinds) if kind == NORMAL}
        if any(c not in known for p in known for c in p):
            raise ValueError("a piece has a character that is no piece")
        return model


class Encoder:
    """Texts to ids on one executor."""

    def __init__(self, model: Model):
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        self.lead = BLANK if model.led else ""
        self.score = {model.pieces[i]: model.scores[i] for i in normal}
        # A piece that merging does not reach cannot stand in a text.
        self.id = {p: i for i in normal if self.merged(p := model.pieces[i]) == [p]}
        self.bytes = dict(zip(range(256), (i for i, kind in enumerate(model.kinds) if kind == BYTE)))
        self.backwards = ahocorasick.Automaton()
        for piece in self.id:
            self.backwards.add_word(piece[::-1], piece)
        self.backwards.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in self.id}
        inside = re.compile(f"[^{BLANK}]{BLANK}")
        self.by_word = not any(inside.search(p) for p in self.score)
        # Characters no piece joins with others: a run of them is a word of its own.
        apart = {chr(c) for c in range(128) if not chr(c).isalpha()}
        while mixed := {a if a in apart else b for p in self.score for a, b in zip(p, p[1:]) if a != BLANK and (a in apart) != (b in apart)}:
            apart -= mixed
        marks = re.escape("".join(sorted(apart)))
        other = f"|{BLANK}*[{marks}]+" if marks else ""
        self.words = re.compile(f"{BLANK}*[^{BLANK}{marks}]+{other}|{BLANK}+")
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The best pair first, the left one of equals, until no pair is a piece."""
        parts, score = list(text), self.score
        worth = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while worth:
            best = max(worth)
            if best == NEVER:
                break
            at = worth.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = score.get(parts[at - 1] + parts[at], NEVER)
            if at < len(worth):
                worth[at] = score.get(parts[at] + parts[at + 1], NEVER)
        return parts

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether both are what merging gives for their characters."""
        left, right = pair
        known = left not in self.id or right not in self.id or self.merged(left + right) == [left, right]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = known
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of the text; a character without a piece stands for itself."""
        size, pairs, shorter = len(text), self.pairs, self.shorter
        # Matches come longest first for each end, which is where the piece starts.
        longest = dict(reversed(list(self.backwards.iter(text[::-1]))))
        failed = bytearray(size // 8 + 1)
        backtracked = False
        taken: list[str] = []
        last, at = "", 0
        piece: str | None = longest.get(size - 1) or text[:1]
        while at < size:
            while piece is not None:
                stop = at + len(piece)
                if not (backtracked and failed[stop >> 3] >> (stop & 7) & 1):
                    if not at:
                        break
                    pair = (last, piece)
                    known = pairs.get(pair)
                    if known or (known is None and self.fits(pair)):
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                backtracked = True
                piece = taken.pop()
                last = taken[-1] if taken else ""
                at -= len(piece)
            else:
                taken.append(piece)
                last, at = piece, stop
                piece = longest.get(size - 1 - at) or text[at : at + 1]
        return taken

    def ids_of(self, word: str) -> bytes:
        pieces, id = self.split(word), self.id
        try:
            ids = [id[p] for p in pieces]
        except KeyError:
            ids = [i for p in pieces for i in ([id[p]] if p in id else map(self.bytes.__getitem__, p.encode()))]
        found = array("i", ids).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of the text as 32-bit numbers, without an end id."""
        if text:
            text = self.lead + text.replace(" ", BLANK)
        words = self.words.findall(text) if self.by_word else [text]
        kept = self.kept
        return b"".join([kept.get(w) or self.ids_of(w) for w in words])


class Decoder:
    """Ids to texts on one executor."""

    def __init__(self, model: Model):
        self.led = model.led
        said = {CONTROL: lambda p: "", UNKNOWN: lambda p: model.unknown_text, BYTE: lambda p: "", NORMAL: lambda p: p.replace(BLANK, " ")}
        self.text = [said[kind](p) for p, kind in zip(model.pieces, model.kinds)]
        self.blank = np.array([kind == NORMAL and p.startswith(BLANK) for p, kind in zip(model.pieces, model.kinds)])
        self.byte = np.full(len(model.pieces), -1, np.int16)
        self.byte[[i for i, kind in enumerate(model.kinds) if kind == BYTE]] = np.arange(256)

    def run_of_bytes(self, data: bytes) -> str:
        """A run of byte pieces; each byte that is not part of a character is replaced."""
        try:
            return data.decode()
        except UnicodeDecodeError as error:
            if error.start:
                return data[: error.start].decode() + self.run_of_bytes(data[error.start :])
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(REPLACEMENT)
                at += 1
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; of a model that leads texts with a blank, without that of the
        first piece that says anything."""
        if self.led:
            silent = 0
            while silent < len(ids) and not self.text[ids[silent]] and self.byte[ids[silent]] < 0:
                silent += 1
            if silent < len(ids) and self.blank[ids[silent]]:
                return self.text[ids[silent]][1:] + self.joined(ids[silent + 1 :])
        return self.joined(ids)

    def joined(self, ids: np.ndarray) -> str:
        values = self.byte[ids]
        raw = values >= 0
        if not raw.any():
            return "".join(map(self.text.__getitem__, ids.tolist()))
        cuts = np.flatnonzero(np.diff(raw)) + 1
        out = []
        for part, is_raw in zip(np.split(ids, cuts), raw[np.append(0, cuts)]):
            out.append(self.run_of_bytes(self.byte[part].astype(np.uint8).tobytes()) if is_raw else "".join(map(self.text.__getitem__, part.tolist())))
        return "".join(out)


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``OUT_BYTES`` each, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > OUT_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", end: bool = True, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """One row per document: its id, the ids of its whole text and, if named, the text
    decoded from them.

    NULL and empty texts have the end id only (none without ``end``); repeated rows give
    repeated results; very long texts are read word by word, and rows leave in portions of
    4 MB; other columns of ``docs`` are ignored. A blank and U+2581 are the same to such a
    model, so both are decoded as blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model)
        closing = np.array([model.end] if end else [], np.int32).tobytes()
        for batch in batches:
            texts = batch.column(1)
            for start, stop in _portions((pa.compute.binary_length(texts).fill_null(0)).to_pylist()):
                found = [encoder.encode(t.as_py() or "") + closing for t in texts.slice(start, stop - start)]
                lengths = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(found), np.int32)))
                columns = [batch.column(0).slice(start, stop - start), ids]
                if decoded_col:
                    columns.append(pa.array([decoder.decode(np.frombuffer(f, np.int32)) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))
    schema = T.StructType(fields)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in a further column; NULL ids give NULL.

    An id outside the model is an error. An existing column ``text_col`` is replaced.
    """
    kept = [c for c in df.columns if c != text_col]
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = [None if row.values is None else decoder.decode(row.values.to_numpy(zero_copy_only=False)) for row in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return df.select(*kept).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: id, number of ids, SHA-256 of the ids and of the decoded text."""
    found = encode(docs, Model.read(path), id_col, text_col, decoded_col="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
