"""BPE encoding and decoding of whole documents.

Encoding runs the transducer of `bpe` over the pieces of each text; decoding is a state machine that takes ids and
gives text as soon as its bytes are complete, holding at most an unfinished character.

Defined results: null or empty text: no ids, empty decoded text; ids, digests and texts of repeated rows are equal; very
long texts and words: whole; null keys and ties: a row each; empty table: no rows; other columns pass through, columns
named like the results are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import held, with_columns
from glyphmill.llm.bpe import BpeModel, byte_letters
from glyphmill.llm.pieces import Splitter, UnitEncoder

_CHUNK = 1 << 15


class Decoder:
    """Ids to text, incrementally, by a state machine over bytes: each id gives bytes, and bytes give text as soon as a
    character is whole; an invalid sequence gives U+FFFD. Its state is at most an unfinished character, and whether a
    token came before.

    A file with a byte-level decoder turns the letters of its tokens back into bytes. A file without one has the library
    join the tokens as they are spelt, with a space between: there an id gives the bytes of its spelling, after a space
    unless it is the first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        spelt = spec["decoder"] is None
        self.between = b" " if spelt else b""
        letters = {c: b for b, c in enumerate(byte_letters())}
        size = max(names) + 1
        self.bytes = [names.get(i, "").encode() if spelt else bytes(letters[c] for c in names.get(i, "")) for i in range(size)]

    def pieces(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Text of successive chunks of ids, in UTF-8."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids, before = iter(ids), b""
        while chunk := [x for x, _ in zip(ids, range(_CHUNK), strict=False)]:
            yield state.decode(before + self.between.join(map(self.bytes.__getitem__, chunk))).encode()
            before = self.between
        yield state.decode(b"", final=True).encode()

    def text(self, ids: Iterable[int]) -> str:
        return b"".join(self.pieces(ids)).decode()


@held
def _units(path: str, words: bool) -> UnitEncoder:
    model = BpeModel(path)
    split = Splitter(tokenizers.Tokenizer.from_file(path), words)
    return UnitEncoder(split, lambda ps: model.encode_words([p.encode() for p in ps]), model.special)


@held
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _per_document(flat: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(counts)
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        yield flat[end - n : end]


def encode(df: DataFrame, path: str, text: str = "text", words: bool = True) -> DataFrame:
    """df with n_tokens and ids."""

    def make():
        units = _units(path, words)

        def slices(column):
            for first, last, flat, counts in units(column):
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
                yield first, last, [pa.array(counts, pa.int64()), ids]

        return slices

    return with_columns(df, text, [("n_tokens", "long"), ("ids", "array<int>")], make)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of each row's ids (null ids: empty)."""

    def make():
        decoder = _decoder(path)

        def slices(column):
            yield 0, len(column), [pa.array([decoder.text(row or ()) for row in column.to_pylist()], pa.string())]

        return slices

    return with_columns(df, ids, [(to, "string")], make)


def round_trip(df: DataFrame, path: str, text: str = "text", words: bool = True, ids_too: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, digests of the ids and of the text they decode to; and the ids."""

    def make():
        units, decoder = _units(path, words), _decoder(path)

        def slices(column):
            for first, last, flat, counts in units(column):
                ids_sha, text_sha = [], []
                for ids in _per_document(flat, counts):
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    digest = hashlib.sha256()
                    for part in decoder.pieces(ids.tolist()):
                        digest.update(part)
                    text_sha.append(digest.hexdigest())
                arrays = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if ids_too:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32())))
                yield first, last, arrays

        return slices

    return with_columns(df, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "array<int>")] if ids_too else [])], make)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
