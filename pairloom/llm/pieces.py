"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file (transducers.py has their algebra):

  normaliser  writes the leading space and spaces as the piece space, and every other character as it is;
  lexicon     a trie that reads characters and writes a piece at its end, again and again. A character that is no
              piece is written as its bytes' pieces (byte fallback), or as unknown where a model has none of these;
  order       reads pieces and weighs them. In a BPE model its states are the last piece, and an arc weighs the
              contradictions to the merge order: 1 if merging the characters of the last piece and the next one, the
              earliest merge first, would not give these two again, else 0. Merges inside a span go the same way
              whether its surroundings are there or not as long as none crosses its ends, so the one segmentation
              without a contradiction is what merging gives. In a unigram model a piece weighs its negative log
              probability, in the lexicon, and the order is free.

Normaliser and lexicon are composed and written out once. An input is composed with that and the order, and the
shortest path of the tropical semiring gives its pieces; the composition is explored only where that path goes. Cuts between two characters that no piece holds side by side lie on every path,
so an input is composed stretch by stretch, and distinct stretches once. Models with a compiled normaliser, user or
unused pieces raise.

Decoding concatenates pieces and bytes, writes spaces back and takes the leading one away; ids that are no text
(unknown, control) decode to nothing, bytes that are no UTF-8 to the replacement character. encode then decode gives
the text back.

Nulls count as empty texts; the empty text has no pieces; an empty table gives an empty result; repeated rows are
encoded alike; columns beside id and text
are ignored by the digests and kept by encode and decode, whatever their names. Texts are encoded whole; the caches
of a worker are bounded.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import documents, fresh, map_arrow, text_of, tokenizer_path
from .merges import Kept
from .transducers import EPSILON, REST, Composed, Lexicon, Machine, Table, shortest_path

SPACE = "▁"
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much less likely an unknown character is than the least likely piece; fixed value.
UNKNOWN_PENALTY = 10.0


def normaliser(prefix: bool) -> Table:
    """State 0 stands at the beginning of a text, state 1 inside it."""
    n = Table(0)
    n.arc(0, EPSILON, (SPACE,) if prefix else (), 0.0, 1)
    n.arc(1, " ", (SPACE,), 0.0, 1)
    n.arc(1, REST, (REST,), 0.0, 1)
    n.end(1)
    return n


class MergeOrder(Machine):
    """Reads pieces; an arc weighs 1 if the merge order contradicts the boundary or the piece, else 0.

    texts: by number, of the pieces that merging makes; rank: of each such text of two characters or more, the
    smaller, the earlier it is merged. Other pieces never merge.
    """

    start = -1

    def __init__(self, texts: dict[int, str], rank: dict[str, float], most_pairs: int = 2_000_000):
        self.texts, self.rank = texts, rank
        self.beside = {pair for t in texts.values() for pair in zip(t, t[1:], strict=False)}
        self.weights = Kept(self._weight, most_pairs)

    def merged(self, text: str) -> list[str]:
        """What merging makes of the characters: always the earliest merge, of equal ones the leftmost."""
        parts, rank = list(text), self.rank
        while True:
            ranks = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(p[0] + p[1])) is not None]
            if not ranks:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _weight(self, pair: int) -> float:
        a, b = self.texts.get((pair >> 20) - 1), self.texts.get(pair & 0xFFFFF)
        if b is None:
            return 0.0
        if a is None or (a[-1], b[0]) not in self.beside:
            return 0.0 if len(b) == 1 or self.merged(b) == [b] else 1.0
        return 0.0 if self.merged(a + b) == [a, b] else 1.0

    def arcs(self, state: int, label):
        return () if label is EPSILON else (((label,), self.weigh(state, label), label),)

    def weigh(self, state: int, label: int) -> float:
        return self.weights[(state + 1) << 20 | label]


class Free(Machine):
    """Reads pieces in any order, without weight."""

    def arcs(self, state: int, label):
        return () if label is EPSILON else (((label,), 0.0, 0),)


class PieceMachine:
    def __init__(self, path: str, most_words: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        kind = model.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or USER in kinds or UNUSED in kinds:
            raise ValueError("only BPE and unigram models with an identity normaliser are read")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        texts = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        score = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = model.trainer_spec.byte_fallback and len(of_byte) == 256
        self.output = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p.piece[1:-1], 16)]) if k == BYTE else p.piece.replace(SPACE, " ").encode() for p, k in zip(model.pieces, kinds, strict=True)]
        if kind == UNIGRAM and min(score.values(), default=0.0) < 0:
            raise ValueError("a piece of a unigram model is likelier than 1")
        strange = max(score.values(), default=0.0) + UNKNOWN_PENALTY if kind == UNIGRAM else 0.0

        def fallback(c: str) -> tuple[tuple[int, ...], float]:
            return tuple(of_byte[b] for b in c.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,), strange

        if kind == BPE and any(c not in texts for t in texts for c in t):
            raise ValueError("a piece holds a character that is no piece")
        # what doesn't depend on the input is composed and written out
        lexicon = Lexicon({t: (i, score[t] if kind == UNIGRAM else 0.0) for t, i in texts.items()}, fallback).after(normaliser(bool(self.prefix)))
        order = MergeOrder({i: t for t, i in texts.items()}, {t: s for t, s in score.items() if len(t) > 1}) if kind == BPE else Free()
        self.machine = Composed(lexicon, order)
        inside = (0, order.start)
        # the stretch at the beginning of a text, and those inside it
        self.first = Kept(lambda s: self._path(s, None), max(2, most_words // 8))
        self.words = Kept(lambda s: self._path(s, inside), most_words)
        self.split = self._cuts([t for t in texts if len(t) > 1], {t for t in texts if len(t) == 1}) if self.bytes else regex.compile(r"(?s).+")

    def _path(self, stretch: str, start) -> bytes:
        ids = shortest_path(self.machine, stretch, start)[0]
        if not self.bytes:  # unknown characters side by side are one piece
            ids = [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]
        return pack(f"<{len(ids)}i", *ids)

    @staticmethod
    def _cuts(pieces: list[str], characters: set[str]) -> regex.Pattern:
        """The pattern of stretches: cut before a space, between letters and marks that no piece has side by side, and around characters that no piece has."""
        beside = {(a, b) for t in pieces for a, b in zip(t, t[1:], strict=False)}
        if any(b == SPACE != a for a, b in beside):
            return regex.compile(r"(?s).+")
        after_letter = {b for a, b in beside if a.isalpha()}
        own = "".join(regex.escape(c) for c in ".,;:!?|()[]{}\"#*$%&+=<>/" if c not in after_letter)
        # control characters outside the lexicon stand alone
        outside = "".join(c for c in "\n\r\t" if c not in characters)
        space = f" {SPACE}"
        return regex.compile(f"[{space}]*\\p{{L}}+(?=[{space}{own}{outside}]|$)|[{outside}]|[{space}]*[^{space}{outside}]+|[{space}]+" if outside else f"[{space}]*[^{space}]+|[{space}]+")

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers, put together stretch by stretch."""
        if not text:
            return b""
        found = self.split.findall(text)
        first = self.first[found[0]]
        # several at once: the loop stays in C
        return first + b"".join(itemgetter(*found[1:])(self.words)) if len(found) > 2 else first + b"".join(map(self.words.__getitem__, found[1:]))

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text by stretch."""
        found = self.split.findall(text)
        return [tuple(np.frombuffer((self.words if k else self.first)[s], "<i4").tolist()) for k, s in enumerate(found)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(itemgetter(*ids)(self.output) if len(ids) > 1 else map(self.output.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text.removeprefix(" ") if self.prefix else text


@lru_cache(maxsize=2)
def machine(name: str) -> PieceMachine:
    """One for each worker process, whatever the number of tasks it runs."""
    return PieceMachine(tokenizer_path(name))


def encode_pieces(docs: DataFrame, text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with an array column `ids`, in place of one of that name if there is one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "ids"]
    (whole,) = fresh(docs, "text")
    rows = docs.select(*rest, text_of(text).alias(whole))

    def start():
        m = machine(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, flat = [0], []
            for s in batch.column(whole):
                flat.append(np.frombuffer(m.packed(s.as_py()), "<i4"))
                ends.append(ends[-1] + len(flat[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            at = batch.schema.get_field_index(whole)
            return pa.RecordBatch.from_arrays([*batch.columns[:at], ids], names=[*batch.schema.names[:at], "ids"])

        return step

    schema = StructType([*rows.drop(whole).schema, StructField("ids", ArrayType(IntegerType()))])
    return map_arrow(rows, start, schema)


def decode_pieces(df: DataFrame, ids: str = "ids", to: str = "decoded", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """df with the text of each row's ids; null for null."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != to]
    (own,) = fresh(df, "ids")
    rows = df.select(*rest, F.col(f"`{ids}`").cast("array<int>").alias(own))

    def start():
        m = machine(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index(own)
            texts = [None if x is None else m.decode(x) for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*batch.schema.names[:at], to])

        return step

    return map_arrow(rows, start, StructType([*rows.drop(own).schema, StructField(to, StringType())]))


def piece_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers), ids, and round_trip: whether decoding gives the text back."""
    out = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def start():
        m = machine(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, flat, digests, same = [0], [], [], []
            for s in batch.column("text"):
                s = s.as_py()
                data = m.packed(s)
                flat.append(np.frombuffer(data, "<i4"))
                same.append(m.decode(flat[-1].tolist()) == s)
                digests.append(hashlib.sha256(data).hexdigest())
                ends.append(ends[-1] + len(flat[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(digests), pa.array(same), ids], schema=out)

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_arrow(rows, start, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean, ids array<int>")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))
