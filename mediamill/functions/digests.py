"""Checksums, digests and ciphers of binary columns."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_ADLER = 65_521


def crc32(c: Column) -> Column:
    return F.crc32(c)


def md5(c: Column) -> Column:
    return F.md5(c)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def sha384(c: Column) -> Column:
    return F.sha2(c, 384)


def sha512(c: Column) -> Column:
    return F.sha2(c, 512)


@F.pandas_udf(LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of each value; null stays null."""
    return data.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


def adler32_combine(a: Column, b: Column, length_b: Column) -> Column:
    """Adler-32 of two parts put together, from those of the parts and the length of the second."""
    a, b = a.cast("long"), b.cast("long")
    low = lambda x: x.bitwiseAND(0xFFFF)
    high = lambda x: F.shiftrightunsigned(x, 16).bitwiseAND(0xFFFF)
    s1 = F.pmod(low(a) + low(b) - 1, F.lit(_ADLER))
    s2 = F.pmod(high(a) + high(b) + F.pmod(length_b.cast("long"), F.lit(_ADLER)) * F.pmod(low(a) - 1, F.lit(_ADLER)), F.lit(_ADLER))
    return F.shiftleft(s2, 16).bitwiseOR(s1)


def zlib_trailer(adler: Column) -> Column:
    """The four big-endian bytes that end a zlib stream."""
    return F.unhex(F.lpad(F.hex(adler.cast("long")), 8, "0"))


def aes_cbc_decrypt(data: Column, key: Column) -> Column:
    """AES in CBC mode with the initial vector in the first 16 bytes and PKCS padding; null where the data don't decrypt."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))
