"""Encoding of a corpus with a public byte-level BPE tokenizer from a local rank file, by the tiktoken library.

Texts are cut at safe boundaries first: between a character that is no white space and a white-space run no token ever
spans, whatever the text, so the pieces encode alone to exactly the ids of the whole. Long pieces, as in scripts without
spaces, are cut again between a letter and what is none: a run of letters is a match of its own in the pattern, which
looks at nothing before it. That bounds what the library sees of a long text at once, and pieces that came before (words
of a language are few) are looked up instead of encoded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# fixed values: the pre-splitting pattern that belongs to the public byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Unicode White_Space, which is what \s means in PATTERN; Python's own \s has four characters more.
SPACE = "\t-\r \x85\xa0" + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_AFTER_LETTERS = regex.compile(r"(?<=\p{L})(?=[^\p{L}\p{Cn}])")
MOST_KEPT = 150_000
LONGEST_KEPT = 200


class Encoder:
    """Ids of texts and bytes of ids. The memory of known pieces is bounded and never changes a result."""

    def __init__(self, rank_file: str) -> None:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(os.path.basename(rank_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._known: dict[str, list[int]] = {}
        self._table: pa.Array | None = None

    def _ids(self, piece: str) -> list[int]:
        # digits after a mark, as in times, begin a token of their own: both sides are more often known than the whole
        cut = max(piece.rfind(":"), piece.rfind(","), piece.rfind(".")) + 1
        if cut and (tail := piece[cut:]).isdigit() and tail.isascii():
            known, head = self._known.get, piece[:cut]
            return (known(head) or self._new(head)) + (known(tail) or self._new(tail))
        if len(piece) > LONGEST_KEPT:
            cuts, known = [0, *(m.start() for m in _AFTER_LETTERS.finditer(piece)), len(piece)], self._known.get
            return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in known(piece[a:b]) or self._new(piece[a:b])]
        return self._new(piece)

    def _new(self, piece: str) -> list[int]:
        ids = self._encode(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self._known) >= MOST_KEPT:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def _lists(self, text: str) -> list[list[int]]:
        pieces = _PIECES.findall(text)
        lists = list(map(self._known.get, pieces))
        if None in lists:
            lists = [self._ids(piece) if found is None else found for piece, found in zip(pieces, lists, strict=True)]
        return lists

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text, names of special tokens being ordinary text; none for an empty or null text."""
        return list(chain.from_iterable(self._lists(text))) if text else []

    def count(self, text: str | None) -> int:
        """The number of ids of the text."""
        return sum(map(len, self._lists(text))) if text else 0

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids; cut anywhere, they need not be whole characters."""
        return b"".join(map(self._bytes.__getitem__, ids))


    def tokens(self) -> pa.Array:
        """The bytes of every id, by position."""
        if self._table is None:
            self._table = pa.array([self._bytes.get(i) for i in range(max(self._bytes) + 1)], pa.binary())
        return self._table


@lru_cache(maxsize=4)
def encoder(rank_file: str = RANK_FILE) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(rank_file)


def _map(rank_file: str, count: bool, schema: pa.Schema):
    """The last column, a text, becomes its ids or their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file)
        for batch in batches:
            *others, texts = batch.columns
            if count:
                last = pa.array([own.count(t) for t in texts.to_pylist()], schema.field(len(others)).type)
                yield pa.RecordBatch.from_arrays([*others, last], schema=schema)
                continue
            step = 256
            for at in range(0, batch.num_rows, step):
                ids = [np.array(own.encode(t), np.int32) for t in texts.slice(at, step).to_pylist()]
                borders = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                last = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*[o.slice(at, step) for o in others], last.cast(schema.field(len(others)).type)], schema=schema)

    return run


def _mapped(df: DataFrame, key: str, text: str, field: StructField, rank_file: str, count: bool) -> DataFrame:
    schema = StructType([StructField(key, df.schema[key].dataType), field])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_map(rank_file, count, to_arrow_schema(schema)), schema)


def token_ids(df: DataFrame, key: str, text: str, rank_file: str = RANK_FILE) -> DataFrame:
    """key and ids, array<int>, one row for each row of df. No shuffle; an empty or null text has an empty list.

    rank_file must be readable at this path on every executor. Repeated rows and null keys come out as they are.
    """
    return _mapped(df, key, text, StructField("ids", ArrayType(IntegerType(), True)), rank_file, False)


def token_counts(df: DataFrame, key: str, text: str, rank_file: str = RANK_FILE) -> DataFrame:
    """key and tokens, the number of ids of the text (0 for an empty or null one), one row for each row of df."""
    return _mapped(df, key, text, StructField("tokens", IntegerType()), rank_file, True)


def decoded(df: DataFrame, ids: str, rank_file: str = RANK_FILE) -> DataFrame:
    """df with the column ids replaced by its raw bytes; a null list stays null, an id outside the file is an error."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def to_bytes(lists: pa.Array) -> pa.Array:
        tokens = encoder(rank_file).tokens()
        offsets = lists.offsets if lists.null_count == 0 else None
        if offsets is None:  # a null list has no ids of its own
            offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32))
        flat = tokens.take(lists.flatten())
        first = offsets[0].as_py()
        made = pa.ListArray.from_arrays(pc.subtract(offsets, first) if first else offsets, flat)
        joined = pc.binary_join(made, b"")
        return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary())) if lists.null_count else joined

    return df.withColumn(ids, to_bytes(F.col(f"`{ids}`")))
