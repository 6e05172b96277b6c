"""Byte-level BPE with a local rank file: whole texts to ids, ids back to bytes.

The regular expression that cuts a text into pieces is the costly and fragile part on long texts: a very long run of
blanks overflows the matcher's stack. Texts are therefore cut beforehand where no match can cross:

* between a character that is no white space and a following blank or line feed: a match that holds the former ends
  there, and the pattern never looks behind;
* at runs of LONG_RUN white space characters or more. Such a run is one piece up to its last character (up to its end at
  the end of the text), which is encoded without the pattern.

Null and empty texts give no ids. Repeated rows give equal results; every row is treated alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from docketflow.llm.rows import map_rows

MAX_RANK_BYTES = 16_000_000
CUT_CHARS = 50_000
LONG_RUN = 2_000

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")
_CUT = re.compile(r"(?<=\S)[ \n]")


def read_ranks(path: str) -> bytes:
    """The rank file, whose size is checked because it travels with the tasks."""
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def _encodings(data: bytes, pattern: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    by_pattern = tiktoken.Encoding("by_pattern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return by_pattern, tiktoken.Encoding("one_piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, data: bytes, pattern: str):
        self._pieces, self._whole = _encodings(data, pattern)

    def _cut(self, text: str) -> list[int]:
        """Ids of a text without long white space runs."""
        if len(text) <= CUT_CHARS:
            return self._pieces.encode_ordinary(text)
        ids, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + CUT_CHARS)
            end = found.start() if found else len(text)
            ids += self._pieces.encode_ordinary(text[at:end])
            at = end
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < LONG_RUN:
            return self._pieces.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            ids += self._cut(text[at:run.start()])
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._whole.encode_ordinary(text[run.start():at])
        return ids + self._cut(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return self._pieces.decode_bytes(ids)


def _digest(codec: Codec, text: str | None) -> tuple[int, str, str]:
    ids = codec.encode(text)
    return (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(codec.decode(ids)).hexdigest())


def digests(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return map_rows(docs.select(key, text), _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                    make=lambda: Codec(ranks, pattern), keep=True)


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``token_ids`` and ``n_tokens`` (these replace columns of the same names)."""
    kind = StructType([StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    @F.pandas_udf(kind)
    def encode(texts):
        import pandas as pd
        codec = Codec(ranks, pattern)
        ids = [codec.encode(t) for t in texts]
        return pd.DataFrame({"token_ids": ids, "n_tokens": [len(x) for x in ids]})

    return _with_fields(docs, encode(F.col(text)), ["token_ids", "n_tokens"])


def decode_ids(df: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns of ``df``, with ``decoded``: the text of the ids (bytes that are no UTF-8 become U+FFFD)."""
    @F.pandas_udf(StringType())
    def decode(rows):
        codec = Codec(ranks, pattern)
        return rows.map(lambda x: codec.decode([] if x is None else list(x)).decode("utf-8", "replace"))

    return df.withColumn("decoded", decode(F.col(ids)))


def _with_fields(df: DataFrame, struct, names: list[str]) -> DataFrame:
    kept = [df[c] for c in df.columns if c not in names]
    return df.select(*kept, struct.alias("__made")).select(*[c for c in df.columns if c not in names], "__made.*")
