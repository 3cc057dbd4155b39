"""Encoding of texts with a public tokenizer over Arrow batches, byte and character offsets, and decoding.

The vocabulary file is a parameter; the executors read it by path, so it must be on every machine or in a shared folder.
Ids of an empty text and of a null text are the empty list. No special tokens are added, and the strings of special tokens
in a text are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files where neither the session (fondaco.tokenizers) nor the environment names one.
FOLDER = "/opt/tokenizers"


def vocabulary(spark: SparkSession | None = None, name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file."""
    folder = (spark.conf.get("fondaco.tokenizers", "") if spark else "") or os.environ.get("FONDACO_TOKENIZERS", "") or FOLDER
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once in each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed.

    Printable Latin-1 characters stand for themselves; the other bytes take the characters from 256 on in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def id_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id."""
    t, table = tokenizer(path), byte_table()
    vocab = t.get_vocab(with_added_tokens=True)
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if token in special else bytes(table[c] for c in token)
    return tuple(out)


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; equal texts of the batch are encoded once."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    ids = {t: e.ids for t, e in zip(distinct, tokenizer(path).encode_batch(distinct, add_special_tokens=False))}
    return [ids[t] if t else [] for t in texts]


def byte_offsets(ids: list[int], path: str) -> list[tuple[int, int]]:
    """Start and end of each id in the text's UTF-8 bytes; together they cover it without a gap."""
    table, at, out = id_bytes(path), 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at = out[-1][1]
    return out


def char_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as character spans; an id that holds part of a character spans the whole of it."""
    first: list[int] = []  # the character of each byte
    for k, c in enumerate(text):
        first.extend([k] * len(c.encode("utf-8", "surrogatepass")))
    return [(first[a], first[b - 1] + 1) if b > a else ((first[a], first[a]) if a < len(first) else (len(text), len(text))) for a, b in spans]


def decode_ids(ids: list[int] | None, path: str) -> str | None:
    """The text of ids; a character split over ids is put together again, a broken one becomes U+FFFD. Null stays null."""
    if ids is None:
        return None
    table = id_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):  # long texts come in small pieces of a batch, so memory stays bounded
                yield work(b.slice(k, 256))

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of every row; rows with a null or empty text have the empty list."""
    kind = df.schema[key].dataType.simpleString()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_texts(b.column(1).to_pylist(), path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return _in_batches(df.select(F.col(key), F.col(text)), work, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, n_tokens) of every row."""
    cols = [key, *carry]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", n_tokens bigint"

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(i) for i in encode_texts(b.column(len(cols)).to_pylist(), path)]
        return pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(n, pa.int64())], names=[*cols, "n_tokens"])

    return _in_batches(df.select(*cols, F.col(text).alias("__text")), work, schema)


def encode_with_offsets(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids, byte_start, byte_end, char_start, char_end), one list element per id."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "ids", "byte_start", "byte_end", "char_start", "char_end"]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        ids = encode_texts(texts, path)
        spans = [byte_offsets(i, path) for i in ids]
        chars = [char_offsets(t or "", s) for t, s in zip(texts, spans)]
        lists = [ids, *[[[x[k] for x in s] for s in which] for which in (spans, chars) for k in (0, 1)]]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], names=names)

    return _in_batches(df.select(F.col(key), F.col(text)), work, f"`{key}` {kind}, " + ", ".join(f"{c} array<int>" for c in names[1:]))


def decode(ids: Column | str, path: str) -> Column:
    """Column of texts from a column of ids."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode_ids(x, path), na_action="ignore")

    return run(ids)
