"""Bitmaps of a fixed size over hashes: which keys are worth emitting at all.

A bitmap tells for certain that a key is not in a set; keys share bits, so it
never decides a result. It has the same size whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOG_BITS = 26
BITS = 2**_LOG_BITS  # 8 MB
_TASK_STEP = 2654435761


def bit_of_long(key: Column) -> Column:
    """The bit of a 64-bit hash."""
    return key.bitwiseAND(F.lit(BITS - 1))


def bit_of_row(row: Column) -> Column:
    """The bit of a row number: a task's number in the bits from the 40th, counted below them."""
    return (row + F.shiftright(row, 40) * F.lit(_TASK_STEP)).bitwiseAND(F.lit(BITS - 1))


def bit_of_name(name: Column) -> Column:
    """The bit of a binary name: its first bits."""
    return F.shiftright(F.conv(F.hex(F.substring(name, 1, 4)), 16, 10).cast("bigint"), 32 - _LOG_BITS)


def collected(bits: DataFrame, bit: Column) -> np.ndarray:
    """The bitmap of all values of ``bit``; 8 MB at most reach the driver."""
    place = bit + 1  # the functions count from 1
    parts = bits.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for row in parts.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bytes")).collect():
        bitmap[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bytes"], np.uint8)
    return bitmap


def _held(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7)) & 1 == 1


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have their bit set."""
    return _held(bitmap, (keys & np.uint64(BITS - 1)).astype(np.int64))


def holds_rows(bitmap: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which row numbers have their bit set."""
    return _held(bitmap, (rows + (rows >> 40) * _TASK_STEP) & (BITS - 1))


def holds_pairs(bitmap: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which pairs of a 64-bit hash and a row number have the bit set that is the sum of both's."""
    return _held(bitmap, ((keys & (BITS - 1)) + (rows + (rows >> 40) * _TASK_STEP)) & (BITS - 1))


def holds_names(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names (rows of bytes) have their bit set."""
    first = np.ascontiguousarray(names[:, :4]).view(">u4")[:, 0]
    return _held(bitmap, (first >> (32 - _LOG_BITS)).astype(np.int64))


def as_binary(names: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as a binary column."""
    buffer = pa.py_buffer(np.ascontiguousarray(names).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, buffer]).cast(pa.binary())
