"""Hash fractions as they come out of a whole md5, in 64-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """The md5 of `text`, read as one number, modulo `modulus`: of both halves, the upper one times 2^64 mod `modulus`."""
    h = F.md5(text)
    high = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    return (((high % modulus) * pow(2, 64, modulus) + low % modulus) % modulus).cast("int")


def file_stem(path: Column) -> Column:
    """The file name without directories and its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
