"""Secrets as data.

A key written into an expression would show in plans, logs and the web UI.  As a column of a
one-row table it is joined in and only its name shows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixed_values as fv

MOST_BROADCAST = 10_000


def derived_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key; slow on purpose, run once per passphrase, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, fv.KDF_ITERATIONS, 32)


def hmac_blocks(key: bytes) -> bytes:
    """What HMAC-SHA256 puts before its inner and its outer message: the key, padded and masked twice."""
    padded = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in padded) + bytes(b ^ 0x5C for b in padded)


def expanded(blocks: Column, info: Column) -> Column:
    """A 256-bit key for this information: the first step of HKDF's expansion, HMAC(key, info + 0x01)."""
    inner = F.sha2(F.concat(F.substring(blocks, 1, 64), info, F.lit(b"\x01")), 256)
    return F.unhex(F.sha2(F.concat(F.substring(blocks, 65, 64), F.unhex(inner)), 256))


def with_keys(rows: DataFrame, keys: dict[str, bytes | str], on: str) -> DataFrame:
    """Add ``_key``, looked up by the value of ``on``: one entry per save, broadcast while few."""
    spark = SparkSession.getActiveSession()
    kind = "binary" if all(isinstance(k, bytes) for k in keys.values()) else "string"
    table = spark.createDataFrame(list(keys.items()), f"{on} string, _key {kind}")
    return rows.join(F.broadcast(table) if len(keys) <= MOST_BROADCAST else table, on)
