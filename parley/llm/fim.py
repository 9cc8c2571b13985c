"""Fill-in-the-middle: a text is cut at two drawn tokens and told as prefix, suffix and middle, or suffix first.

A token is a run of the letters A-Z and a-z, or any other single character. Texts are UTF-8 bytes, and sets of their places are big integers
with a byte for each place: ``bytes.translate`` makes the mask of a class, a shift by a byte and a boolean operation mark where tokens
begin, ``bit_count`` tells how many there are, and halving the mask again and again finds where the token of a rank begins. All of it is
linear in the text, and nothing is made per token.

What is drawn depends on the seed and the id alone, so a lost task draws the same again: with the first four groups of eight hex digits of the
SHA-256 of ``seed:id``, the cuts are the first two modulo n + 1, the smaller first; the third decides whether the text stays plain, the fourth
which form it takes.

Defined results: a null text is an empty one; a text that is empty or holds a sentinel stays plain; a null id is drawn for as ``seed:``; rows
that share an id share their draws, not their cuts; an empty table gives an empty table; other columns are kept, and those with the
names of added ones are replaced. Texts may be of any length and go through one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import bound_batches, free_name, others

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
_ALPHA = bytes(1 if chr(b).isalpha() and b < 128 else 0 for b in range(256))
#: First bytes of characters: all but those of the form 10xxxxxx.
_LEAD = bytes(0 if b & 0xC0 == 0x80 else 1 for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """A bit at 8 x place for every byte that ``table`` maps to 1."""
    return int.from_bytes(data.translate(table), "little")


def token_starts(data: bytes) -> int:
    letters = mask(data, _ALPHA)
    # A letter begins no token if the byte before it is a letter too.
    return mask(data, _LEAD) ^ (letters & (letters << 8))


def place_of(starts: int, rank: int, size: int) -> int:
    """The place of the bit number ``rank`` (from 0) of a mask over ``size`` bytes; ``size`` if there are no more than ``rank`` bits."""
    if rank >= starts.bit_count():
        return size
    at = 0
    while size > 1:
        half = size // 2
        low = starts & ((1 << 8 * half) - 1)
        held = low.bit_count()
        if rank < held:
            starts, size = low, half
        else:
            starts, rank, at, size = starts >> 8 * half, rank - held, at + half, size - half
    return at


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(data: bytes, key: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, characters of prefix and of middle, and the output."""
    starts = token_starts(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(seed, key)
    if not data or any(x in data for x in (_P, _S, _M)) or h3 % 100 >= rate:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (place_of(starts, x, len(data)) for x in (first, second))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    chars = (mask(prefix, _LEAD).bit_count(), mask(middle, _LEAD).bit_count())
    if h4 % 100 < spm_rate:
        return n, "spm", *chars, b"".join((_S, suffix, _P, prefix, _M, middle))
    return n, "psm", *chars, b"".join((_P, prefix, _S, suffix, _M, middle))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``.

    Of 100 texts about ``rate`` are transformed, and of these ``spm_rate`` of 100 begin with the suffix.
    """
    bound_batches(docs.sparkSession)
    keep = others(docs, *ADDED)
    raw, key = free_name(docs, "_raw"), free_name(docs, "_key")
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(raw), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transformed(x.as_py(), k.as_py(), seed, rate, spm_rate) for x, k in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(ADDED)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=[*keep, *ADDED])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType())
    schema = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in keep)).schema.fields, *(T.StructField(c, t) for c, t in zip(ADDED, kinds, strict=True))])
    return own.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part of it holds a sentinel, and sentinels do not overlap, so the first of each ends a part."""
    before, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda mark: F.substring_index(before, mark, 1)
    psm = F.concat(F.substr(first(SUFFIX), F.lit(len(PREFIX) + 1)), middle, F.substring_index(before, SUFFIX, -1))
    spm = F.concat(F.substring_index(before, PREFIX, -1), middle, F.substr(first(PREFIX), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
