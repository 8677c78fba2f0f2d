"""Byte-level BPE: encode texts by a vocabulary of byte ranks, and decode ids.

A sentencepiece BPE model is serialised straight from the rank file. Each byte is written
as one printable character, a piece's score is its negative rank, normalisation is the
identity, so merging the best-scored pair is merging the lowest rank. The unknown piece
takes the id after the last rank; it can never occur, as every byte is a piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import mapped

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens remembered by a task before it starts anew; bounds memory, not results.
_REMEMBERED = 100_000
_TOGETHER = 200


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Ranks by byte string, from lines of base64 and rank."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The protocol buffer of a sentencepiece BPE model whose ids are the ranks."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without holes and hold every single byte")
    letters = byte_letters()
    pieces = [
        _block(1, "".join(letters[b] for b in piece).encode()) + struct.pack("<Bf", 0x15, -rank)
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    # piece type 2 is the unknown piece; model type 2 is BPE
    pieces.append(_block(1, b"<unk>") + struct.pack("<Bf", 0x15, 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(ranks))
    trainer += b"".join(_number(f, (1 << 64) - 1) for f in (41, 42, 43))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, identity)


class Codec:
    """Encoder and decoder of one task. Remembers the pre-tokens it has met."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = pieces
        self.decimal = [str(i) for i in range(len(pieces))]
        self._split = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._letters = dict(zip(map(chr, range(256)), byte_letters()))
        self._table = str.maketrans(self._letters)
        self._known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each whole text; new pre-tokens go to the model together, a few texts at a time."""
        for at in range(0, len(texts), _TOGETHER):
            split = [self._split(text) for text in texts[at:at + _TOGETHER]]
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            known = self._known
            new = list(set().union(*split).difference(known))
            letters = [t.encode().decode("latin-1").translate(self._table) for t in new]
            known.update(zip(new, map(tuple, self._model.encode(letters, num_threads=1))))
            for tokens in split:
                yield list(chain.from_iterable(map(known.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.pieces.__getitem__, ids))


def _codec(spark: SparkSession, path: str | None, pattern: str):
    """A function that makes a task's codec; the vocabulary (under 2 MB) goes out once."""
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast((model_bytes(ranks), sorted(ranks, key=ranks.get)))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(*sent.value, pattern))
        return made[0]

    return codec


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids) of every row. Null and empty texts have no ids; repeated rows stay repeated.

    Texts of any length are encoded whole; other columns are ignored.
    """
    codec = _codec(docs.sparkSession, path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return mapped(rows, f"id {kind}, ids array<int>", lambda b: {
        "id": b["id"], "ids": list(codec().encode([t or "" for t in b["text"]])),
    }).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, bytes) of every row of ids; null and empty lists give no bytes."""
    codec = _codec(rows.sparkSession, path, pattern)
    kind = rows.schema[id_col].dataType.simpleString()
    some = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    return mapped(some, f"id {kind}, bytes binary", lambda b: {
        "id": b["id"], "bytes": [codec().decode(x or []) for x in b["ids"]],
    }).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
            pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256), and ids if wanted.

    The first digest is of the decimal ids joined by commas, the second of the bytes that
    the ids decode to. Nulls and repeated rows are as in ``encode``.
    """
    codec = _codec(docs.sparkSession, path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(b):
        c = codec()
        out = {"id": b["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for ids in c.encode([t or "" for t in b["text"]]):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(np.array(ids, np.int32))
        return out

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return mapped(rows, schema + ", ids array<int>" * with_ids, run).withColumnRenamed("id", id_col)
