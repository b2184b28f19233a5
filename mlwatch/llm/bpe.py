"""Byte-level BPE: texts to token ids with the tokenizers library over Arrow batches, and back.

A rank file gives the vocabulary; its merges are recovered from the ranks. A text is cut by the vocabulary's
pattern, each piece's UTF-8 bytes are written as the byte-level characters the library works on, and the library's
BPE model merges them; equal pieces of a worker are merged once. Decoding looks ids up in the reversed byte table.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.models import BPE

from mlwatch.llm.rows import by_batch, received, sent, table

VOCABULARY = "byte_bpe_50k.tiktoken"
# A worker remembers the ids of so many pieces, then starts afresh; longer pieces are not remembered.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
# Texts beyond this length are cut into pieces little by little.
LONG_CHARS = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges before this token's leave of it; None if they don't leave two."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Vocabulary:
    """Ranks and merges of a rank file, with the tables that workers make from them on first use."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        halves = (_halves(t, self.ranks) for t in sorted(self.ranks, key=self.ranks.get) if len(t) > 1)
        self.merges, self.pattern, self.ready = [x for x in halves if x], pattern, None

    def encoder(self) -> Pieces:
        if self.ready is None:
            self.ready = Pieces(self)
        return self.ready

    def byte_table(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}


class Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; missing ones are made by the library."""

    def __init__(self, vocabulary: Vocabulary):
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        as_text = lambda token: "".join(chars[b] for b in token)
        self.model = BPE(
            {as_text(t): r for t, r in vocabulary.ranks.items()},
            [(as_text(a), as_text(b)) for a, b in vocabulary.merges],
            ignore_merges=True,
        )
        self.split = regex.compile(vocabulary.pattern)
        self.bytes_of = vocabulary.byte_table()
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)

    def __missing__(self, piece: str) -> bytes:
        chars = piece.encode().decode("latin-1").translate(self.to_chars)
        ids = np.array([t.id for t in self.model.tokenize(chars)], "<u4").tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) <= LONG_CHARS:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        groups = batched((m[0] for m in self.split.finditer(text)), 1 << 16)
        return b"".join(b"".join(map(self.__getitem__, group)) for group in groups)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in characters of each token: of all characters that it holds a byte of."""
        ends = np.cumsum(self.lengths[np.frombuffer(packed, "<u4")])
        if not len(ends):
            return ends, ends
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        starts = np.concatenate([[0], ends[:-1]])
        return char[starts], char[ends - 1] + 1


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file at ``path`` for the workers; read by the driver, a few MB whatever the corpus."""
    return sent(spark, Vocabulary(path or public_tokenizers.path(VOCABULARY)))


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids): the tokens of every whole text; ``ids`` holds little-endian unsigned 32-bit integers.

    ``offsets`` adds arrays starts and ends, each token's place in characters, where a character that is split
    among tokens belongs to each; ``decoded`` adds the bytes that the ids decode to. No special tokens: their
    strings are ordinary text. A null or empty text has no tokens; every row gives a row, repeated ones too.
    Extra columns are ignored; an empty table gives no rows.
    """
    held = vocabulary(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> dict:
        pieces = received(held).encoder()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [pieces.encode(t) for t in texts]
        out = {id_col: batch.column(0), "ids": pa.array(ids, pa.binary())}
        out["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
        if offsets:
            places = [pieces.offsets(x, t) for x, t in zip(ids, texts)]
            out["starts"] = pa.array([s for s, _ in places], pa.list_(pa.int64()))
            out["ends"] = pa.array([e for _, e in places], pa.list_(pa.int64()))
        if decoded:
            out["decoded"] = pa.array([pieces.decode(x) for x in ids], pa.binary())
        return out

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids binary"
    schema += ", starts array<long>, ends array<long>" * offsets + ", decoded binary" * decoded
    return by_batch(docs.select(id_col, text_col), run, schema)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded, text): the bytes of the ids, and their text.

    Characters split among tokens are whole again, as bytes are joined before they are read as UTF-8; bytes that
    are no UTF-8 become U+FFFD in ``text`` alone. Null ids are no tokens; ids outside the vocabulary raise.
    """
    held = vocabulary(tokens.sparkSession, path)

    def run(batch: pa.RecordBatch) -> dict:
        pieces = received(held).encoder()
        data = [pieces.decode(x or b"") for x in batch.column(1).to_pylist()]
        texts = [d.decode("utf-8", "replace") for d in data]
        return {id_col: batch.column(0), "decoded": pa.array(data, pa.binary()), "text": pa.array(texts, pa.string())}

    schema = f"{id_col} {dict(tokens.dtypes)[id_col]}, decoded binary, text string"
    return by_batch(tokens.select(id_col, ids), run, schema)


def streamed_text(parts: Iterator[bytes]) -> Iterator[str]:
    """Decoded token bytes as text, part by part: the bytes of an unfinished character wait for the next part."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield reader.decode(part)
    yield reader.decode(b"", final=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents"), decoded=True)
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
