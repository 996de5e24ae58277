"""Checksums, names, sizes and Bloom-filter arithmetic as column expressions, with numpy where SQL overflows."""

from __future__ import annotations

import math
import re
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
#: The share of false positives that filters are sized for.
FALSE_POSITIVES = 0.01


def crc(data: Column | str) -> Column:
    """CRC-32 (IEEE) of bytes."""
    return F.crc32(F.col(data) if isinstance(data, str) else data)


def file_name(number: Column, suffix: str) -> Column:
    """A numbered file's name, with six digits at least."""
    return F.format_string(f"%06d.{suffix}", number)


def file_number(name: Column, suffix: str) -> Column:
    """The number in a file's name, null if it is not such a name."""
    return F.try_to_number(F.regexp_extract(name, rf"^(\d{{1,18}})\.{re.escape(suffix)}$", 1), F.lit("9" * 18)).cast("long")


def sample_key(number: Column) -> Column:
    return F.format_string("key:%08d", number)


def sample_value(number: Column) -> Column:
    return F.format_string("val:%08d", number)


def entry_bytes(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a key and its value; what flush triggers count."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def bloom_bits(entries: Column, false_positives: float = FALSE_POSITIVES) -> Column:
    """Bits of a filter for so many entries, eight at least; null for none."""
    bits = F.ceil(-entries * math.log(false_positives) / math.log(2) ** 2)
    return F.when(entries > 0, F.greatest(F.lit(8), bits)).cast("long")


def bloom_hashes(entries: Column, bits: Column) -> Column:
    """Hash functions of a filter with so many bits, one at least; null for no entries."""
    return F.when(entries > 0, F.greatest(F.lit(1), F.round(bits / entries * math.log(2)))).cast("long")


def fnv1a(data: bytes) -> int:
    """FNV-1a of bytes, modulo 2**64."""
    out = FNV_OFFSET
    for byte in data:
        out = ((out ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return out


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a_column(data: pd.Series) -> pd.Series:
    """FNV-1a of every value, all values stepping through their bytes together."""
    values = [b"" if x is None else bytes(x) for x in data]
    out = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    for i in range(max(map(len, values), default=0)):
        there = np.fromiter((i < len(x) for x in values), dtype=bool, count=len(values))
        byte = np.fromiter((x[i] for x in values if i < len(x)), dtype=np.uint64)
        out[there] = (out[there] ^ byte) * np.uint64(FNV_PRIME)
    return pd.Series([None if x is None else Decimal(int(h)) for x, h in zip(data, out, strict=True)])


class Bloom:
    """A filter over byte strings by double hashing of the halves of FNV-1a, with 32-bit wrap-around."""

    def __init__(self, entries: int, false_positives: float = FALSE_POSITIVES) -> None:
        if entries <= 0:
            raise ValueError("a filter needs entries")
        bits = max(8, math.ceil(-entries * math.log(false_positives) / math.log(2) ** 2))
        self.hashes = max(1, math.floor(bits / entries * math.log(2) + 0.5))
        self.bits = np.zeros((bits + 7) // 8, dtype=np.uint8)

    @classmethod
    def of(cls, hashes: int, bits: bytes) -> Bloom:
        out = cls.__new__(cls)
        out.hashes, out.bits = hashes, np.frombuffer(bits, dtype=np.uint8).copy()
        return out

    def _places(self, key: bytes) -> np.ndarray:
        whole = fnv1a(key)
        high, low = whole >> 32, whole & 0xFFFFFFFF
        return np.array([((high + i * low) & 0xFFFFFFFF) % (8 * len(self.bits)) for i in range(self.hashes)])

    def add(self, key: bytes) -> None:
        at = self._places(key)
        np.bitwise_or.at(self.bits, at // 8, (1 << (at % 8)).astype(np.uint8))

    def __contains__(self, key: bytes) -> bool:
        at = self._places(key)
        return bool((self.bits[at // 8] >> (at % 8) & 1).all())
