"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

The vocabulary file (token bytes and ranks) is serialised straight into a sentencepiece BPE model: every token becomes a
piece written in the printable byte alphabet, scored by its negative rank, with identity normalisation. A text is cut
into pre-tokens by the vocabulary's published pattern, each pre-token is byte-mapped and encoded by that model, and
decoding is the inverse mapping. Piece ids are the ranks, the unknown piece takes the free id after the last rank.

The serialised model (about 1 MB, fixed by the vocabulary and not by the data) is broadcast once; encoding is a
vectorised Arrow function on a narrow plan: no shuffle, and the input is read once.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens remembered by a Python worker; beyond this many the memory is emptied, results do not change.
REMEMBERED = 200_000


def byte_alphabet() -> list[str]:
    """A printable, space-free character for each of the 256 bytes (the published byte-level BPE alphabet)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in alphabet:
            alphabet[b] = chr(spare)
            spare += 1
    return [alphabet[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank. Ranks must be 0..n-1 without gaps."""
    ranked: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranked[int(rank)] = base64.b64decode(token)
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [ranked[i] for i in range(len(ranked))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto for the ranked byte tokens (wire format written directly)."""
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _flag(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    out += _field(2, _flag(3, 2) + _flag(4, len(tokens) + 1))
    out += _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder over a serialised model; one per Python worker."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._pre_tokens = regex.compile(pattern)
        alphabet = byte_alphabet()
        self._to_piece = {b: ord(c) for b, c in enumerate(alphabet)}
        self._to_byte = {c: b for b, c in enumerate(alphabet)}
        self._known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the empty and the null text have no tokens, hence an empty list."""
        known, cut = self._known, [self._pre_tokens.findall(t) if t else [] for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for words in cut for p in words if p not in known})
        if new:
            mapped = [p.encode("utf-8").decode("latin-1").translate(self._to_piece) for p in new]
            known.update(zip(new, self._model.encode(mapped)))
        out = []
        for words in cut:
            ids: list[int] = []
            for p in words:
                ids += known[p]
            out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        piece, to_byte = self._model.id_to_piece, self._to_byte
        return [bytes(to_byte[c] for i in row for c in piece(int(i))).decode("utf-8", "replace") for row in ids]


@lru_cache(maxsize=4)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def ship_model(spark: SparkSession, folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY):
    """Serialise the vocabulary on the driver and broadcast the model (size fixed by the vocabulary)."""
    return spark.sparkContext.broadcast(serialise_model(read_ranks(f"{folder}/{vocabulary}")))


def encode_column(text: Column, shipped) -> Column:
    """``array<int>`` of token ids of a text column."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(_codec(shipped.value).encode(texts.to_pylist()), pa.list_(pa.int32()))

    return ids(text)


def decode_column(ids: Column, shipped) -> Column:
    """Text of an ``array<int>`` column; null ids give null."""
    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        lists = rows.to_pylist()
        found = iter(_codec(shipped.value).decode([x for x in lists if x is not None]))
        return pa.array([None if x is None else next(found) for x in lists], pa.string())

    return text(ids)


def count_column(text: Column, shipped) -> Column:
    """Number of tokens of a text column, without moving the ids out of Python."""
    @F.arrow_udf("int")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([len(x) for x in _codec(shipped.value).encode(texts.to_pylist())], pa.int32())

    return size(text)


def encode_corpus(
    documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = DEFAULT_FOLDER
) -> DataFrame:
    """``key`` and ``ids`` of every row.

    Null and empty texts have the empty list; repeated keys and repeated rows are kept one for one; an empty table gives
    an empty result; other columns, whatever their names, are neither read nor returned.
    """
    shipped = ship_model(documents.sparkSession, folder)
    return documents.select(F.col(key), encode_column(F.col(text), shipped).alias("ids"))
