"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary, its scores and the normaliser's settings are read from a SentencePiece model file. A text is
normalised as the model asks: a dummy space in front where it wants one, spaces as U+2581. Models with a character
map, with white space squeezed or as suffix aren't supported and are refused. A text's encoding is the segmentation
into pieces with the highest sum of scores; characters outside the vocabulary become their UTF-8 byte pieces, or the
unknown piece where the model has none, at a penalty below every score. Of equal sums the one whose last piece is
longer wins. Control and unknown pieces are never produced from text; user-defined pieces score above all others.

The search runs over characters as they come and keeps a window of boundaries. When the best paths of all boundaries
that a later piece can still start from, a piece's greatest length back, run through one boundary, ids up to it are
final: they are emitted and the window begins there, so memory is bounded for texts of any length. Where no piece
spans a place, such as in front of a word's space or around a line break, all paths meet at once, so a text falls into
stretches there; a stretch that recurs is searched once while a bounded table remembers its ids.

Decoding joins pieces, turns byte pieces back into UTF-8 and removes the dummy space. The round trip gives
back every text except one with U+2581 in it, which decodes as a space. Null and empty texts have no ids. Repeated
rows are encoded alike, other columns pass, and columns named as the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches, and their ids, in each of the two generations that a worker remembers.
CACHE, CACHE_IDS = 200_000, 2_000_000
#: Texts that are encoded together, in characters.
CHUNK_CHARS = 2_000_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Fields of a protocol buffer message: number, wire type, value."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield number, wire, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]  # (piece, score, type) of every id
    dummy_space: bool = True


def read_model(data: bytes) -> Model:
    """Pieces and settings of a model file."""
    pieces, dummy, squeeze, escape = [], 1, 1, 1
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif number == 2 and any(n == 24 and v for n, _, v in _fields(value)):
            raise ValueError("models with white space as suffix aren't supported")
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2 and v:
                    raise ValueError("models that map characters aren't supported")
                dummy, squeeze, escape = (v if n == k else old for k, old in ((3, dummy), (4, squeeze), (5, escape)))
    if squeeze or not escape:
        raise ValueError("models that squeeze white space, or keep it as it is, aren't supported")
    return Model(pieces, bool(dummy))


class _Numbered(dict):
    """Numbers its keys in the order they are asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Codec:
    """Encoder and decoder of a vocabulary."""

    def __init__(self, model: Model):
        self.dummy = model.dummy_space
        normal = [score for _, score, kind in model.pieces if kind == NORMAL]
        self.ids, self.scores = {}, {}
        self.bytes: list[int] | None = [0] * 256 if any(kind == BYTE for *_, kind in model.pieces) else None
        self.unknown = next((i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        for i, (p, score, kind) in enumerate(model.pieces):
            if kind in (NORMAL, USER):
                self.ids[p] = i
                self.scores[p] = len(p) * max(normal, default=0.0) - 0.1 if kind == USER else score
            elif kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min(normal, default=0.0) - 10.0
        # in front of a space after another character no piece spans the place, unless one holds such a pair
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # line breaks split stretches too where no piece holds one; NUL then stands for one in keys
        self.breaks = self.splits and not any("\n" in p or "\0" in p for p in self.ids)
        self.widest = 0
        self.spelt = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode()
            for p, _, kind in model.pieces
        ]
        self._forget()

    def _forget(self) -> None:
        """Empty the table of stretches."""
        self.numbers, self.old_numbers = _Numbered(), {}
        self.ends = self.old_ends = np.zeros(1, np.int64)
        self.flat = self.old_flat = np.empty(0, np.int32)

    def _age(self) -> None:
        """Begin a new generation of stretches. What recurs moves from the last one, so that common ones stay."""
        self.old_numbers, self.old_ends, self.old_flat = self.numbers, self.ends, self.flat
        self.numbers = _Numbered()
        self.ends, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def stream(self, chars: Iterator[str] | str) -> Iterator[tuple[int, ...]]:
        """Ids of a stretch of normalised text, as they become final."""
        get, penalty, longest = self.scores.get, self.penalty, self.longest
        window = ""  # characters from the last settled boundary on
        best, back = [0.0], [0]  # by boundary: best sum, and where its last piece starts
        end = 0
        for c in chars:
            window += c
            start = end
            end += 1
            top = best[start] + get(c, penalty)
            for at in range(start - 1, end - longest - 1 if end > longest else -1, -1):
                s = get(window[at:])
                if s is not None and best[at] + s >= top:
                    top, start = best[at] + s, at
            best.append(top)
            back.append(start)
            if end >= 2 * longest:
                self.widest = max(self.widest, end)
                # boundaries from which a later piece can start: follow their best paths until they meet
                alive = set(range(end - longest + 1, end + 1))
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(back[last])
                meet = alive.pop()
                if meet:
                    yield self._path(window, back, meet)
                    window, base, end = window[meet:], best[meet], end - meet
                    best = [x - base for x in best[meet:]]
                    back = [0, *(x - meet for x in back[meet + 1 :])]
        if window:
            yield self._path(window, back, end)

    def _path(self, window: str, back: list[int], end: int) -> tuple[int, ...]:
        out: list[int] = []
        while end:
            start = back[end]
            piece = window[start:end]
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes is None:
                out.append(self.unknown)
            else:
                out.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            end = start
        return tuple(reversed(out))

    def _keys(self, text: str) -> list[str]:
        """The stretches of a text under short names: without their first space, or with NUL for a first line break."""
        marked = text.replace(" ", SPACE)
        if self.breaks and "\0" not in marked:
            broken = (SPACE + marked).replace("\n", SPACE + "\0")
            if SPACE + SPACE not in broken:
                return broken.split(SPACE)[1:]
        if not self.splits:
            return [marked]
        out, spaces = [], 0
        for part in (SPACE + marked).split(SPACE)[1:]:
            spaces += 1
            if part:
                out.append(SPACE * (spaces - 1) + part)
                spaces = 0
        return out + [SPACE * (spaces - 1)] * (spaces > 0)

    def _stretch(self, key: str) -> str:
        return "\n" + key[1:] if self.breaks and key.startswith("\0") else SPACE + key

    def _learn(self) -> None:
        """Search the stretches that are new."""
        flat: list[int] = []
        ends: list[int] = []
        old = self.old_numbers
        for key in self.numbers.fresh:
            n = old.get(key)
            if n is not None:
                flat += self.old_flat[self.old_ends[n] : self.old_ends[n + 1]].tolist()
            else:
                for final in self.stream(self._stretch(key)):
                    flat += final
            ends.append(len(flat))
        if ends:
            self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.array(ends, np.int64)])
        self.numbers.fresh = []

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.numbers) > CACHE or len(self.flat) > CACHE_IDS:
            self._age()
        number = self.numbers.__getitem__
        lists = []
        for text in texts:
            if "\0" in text or not self.dummy:  # NUL itself, not a line break: ids at once, told by their sign
                lists.append(-1 - np.array([x for s in self._plain(text) for part in self.stream(s) for x in part], np.int64))
            else:
                keys = self._keys(text) if text else []
                lists.append(np.fromiter(map(number, keys), np.int64, len(keys)))
        self._learn()
        out = []
        for refs in lists:
            if len(refs) and refs[0] < 0:
                out.append((-1 - refs).astype(np.int32))
                continue
            start, stop = self.ends[refs], self.ends[refs + 1]
            size = stop - start
            total = int(size.sum())
            shift = np.repeat(start - (np.cumsum(size) - size), size)
            out.append(self.flat[np.arange(total) + shift])
        return out

    def _plain(self, text: str) -> list[str]:
        """A text's stretches themselves, split at spaces only, or the text where no space is put in front of it."""
        if not self.dummy:
            return [text.replace(" ", SPACE)] if text else []
        held, self.breaks = self.breaks, False
        try:
            return [SPACE + k for k in self._keys(text)]
        finally:
            self.breaks = held

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(read_model(model))
    return _codecs[key]


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; at most a few MB, it goes to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


#: Columns that encoded() adds.
NEW = ["ids", "n_ids", "round_trip"]


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The documents with ids (array of int), n_ids, and round_trip: whether the ids decode to the text."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    common.bound_batches(docs)
    docs = docs.drop(*(c for c in NEW if c in docs.columns))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        codec = _codec(model.value)
        for batch in batches:
            flat, same, held, size = [], [], [], 0
            for i, text in enumerate(batch.column(place)):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= CHUNK_CHARS or i == batch.num_rows - 1:
                    ids = codec.encode_all(held)
                    same += [codec.decode(x.tolist()) == t for x, t in zip(ids, held, strict=True)]
                    flat += ids
                    held, size = [], 0
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(np.diff(ends).astype(np.int64), pa.int64()), pa.array(same, pa.bool_())], [*batch.schema.names, *NEW])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decoded(encodings: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows with their ids' text as column decoded; null ids give null."""
    model = encodings.sparkSession.sparkContext.broadcast(model_bytes(path))
    rest = encodings.drop("decoded")
    place = rest.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        codec = _codec(model.value)
        for batch in batches:
            out = [None if x.as_py() is None else codec.decode(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))
