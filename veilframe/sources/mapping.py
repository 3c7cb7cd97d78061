"""The table from token to original value: saving, loading, encryption, merging.

Keys form a hierarchy.  The passphrase and a salt of the store give a master key, by a slow derivation that runs once
on the driver however many saves there are.  Each save has a random key of its own; the header, a small table
beside the mapping, holds it sealed under the master key.  A scope's key (all columns but token and value) is
expanded from its save's key by a Column expression, so values are sealed and opened where they are.  A new passphrase
seals the header anew and leaves the mapping alone.
"""

from __future__ import annotations

import os
import secrets

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.hidden import derived_key, expanded, hmac_blocks, with_keys

HEADER = "save string, salt string, wrapped binary"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A saved table, None if there is none."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _scope(mapping: DataFrame) -> Column:
    """The scope of a row as text, with the names of its columns."""
    names = sorted(c for c in mapping.columns if c not in ("token", "value", "save"))
    return F.to_json(F.struct(F.lit("").alias("_"), *[F.col(c).cast("string").alias(c) for c in names])).cast("binary")


def _sealing(mapping: DataFrame) -> tuple[Column, Column]:
    """A row's key and the extra data that is checked with its value."""
    scope = _scope(mapping)
    return expanded(F.col("_key"), scope), F.concat(scope, F.lit(b"|"), F.col("token").cast("binary"))


def _header(spark: SparkSession, save: str, blocks: bytes, salt: str, master: bytes) -> DataFrame:
    """One row: the save's key sealed under the master key."""
    row = spark.createDataFrame([(save, salt, bytearray(blocks))], "save string, salt string, blocks binary")
    return _wrapped(row, {salt: master})


def _wrapped(rows: DataFrame, masters: dict[str, bytes]) -> DataFrame:
    sealed = F.aes_encrypt(F.col("blocks"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("save"))
    return with_keys(rows, masters, "salt").select("save", "salt", sealed.alias("wrapped"))


def _unwrapped(header: DataFrame, master: bytes, salt: str) -> DataFrame:
    """save and its key; a wrong passphrase is an error."""
    opened = F.aes_decrypt(F.col("wrapped"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("save"))
    return with_keys(header, {salt: master}, "salt").select("save", opened.alias("_key"))


def store_salt(header: DataFrame) -> str | None:
    """The salt that all saves of a store share, None if it has no saves."""
    ends = header.agg(F.min("salt").alias("low"), F.max("salt").alias("high")).first()
    if ends["low"] != ends["high"]:
        raise ValueError("the header holds saves of several stores")
    return ends["low"]


def encrypted(mapping: DataFrame, passphrase: str, salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Values under AES-256-GCM with a column ``save``, and the header row of this save.

    ``salt`` is the store's; a new store gets a new one.
    """
    salt = salt or os.urandom(fv.KDF_SALT_BYTES).hex()
    save, blocks = secrets.token_hex(16), hmac_blocks(secrets.token_bytes(32))
    keyed = with_keys(mapping.withColumn("save", F.lit(save)), {save: blocks}, "save")
    key, extra = _sealing(mapping)
    sealed = F.aes_encrypt(F.col("value"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), extra)
    header = _header(mapping.sparkSession, save, blocks, salt, derived_key(passphrase, bytes.fromhex(salt)))
    return keyed.withColumn("value", sealed).select(*mapping.columns, "save"), header


def decrypted(mapping: DataFrame, header: DataFrame, passphrase: str) -> DataFrame:
    """The opposite of ``encrypted``; a wrong passphrase and a save without a key are errors, not nulls."""
    salt = store_salt(header) or ""
    keys = _unwrapped(header, derived_key(passphrase, bytes.fromhex(salt)), salt)
    key, extra = _sealing(mapping)
    opened = F.aes_decrypt(F.col("value"), key, F.lit("GCM"), F.lit("DEFAULT"), extra).cast("string")
    missing = F.raise_error(F.lit("the header has no AES key for a save")).cast("string")
    return mapping.join(keys, "save", "left").withColumn("value", F.when(F.col("_key").isNull(), missing).otherwise(opened)).select(
        *[c for c in mapping.columns if c != "save"]
    )


def _rings(path: str) -> str:
    return f"{path}.keys"


def _last_ring(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """The header under the newest passphrase."""
    rings = _read(spark, _rings(path), HEADER + ", ring int")
    last = rings.agg(F.max("ring")).first()[0] if rings is not None else None
    return None if last is None else (last, rings.where(F.col("ring") == last).drop("ring"))


def save_mapping(
    mapping: DataFrame,
    path: str,
    passphrase: str | None = None,
    partition_by: tuple[str, ...] = (),
    mode: str = "overwrite",
) -> None:
    if not passphrase:
        mapping.write.mode(mode).partitionBy(*partition_by).parquet(path)
        return
    ring, header = _last_ring(mapping.sparkSession, path) or (0, None)
    salt = store_salt(header) if header is not None else None
    rows, key = encrypted(mapping, passphrase, salt)
    # The key comes first: a save whose header is there but whose rows are not is an empty one.
    key.write.mode("append").parquet(f"{_rings(path)}/ring={ring}")
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load_mapping(spark: SparkSession, path: str, passphrase: str | None = None) -> DataFrame:
    """A saved mapping; a path that does not exist is an empty one."""
    rows = _read(spark, path)
    if rows is None:
        return spark.createDataFrame([], "token string, value string")
    if not passphrase:
        return rows
    found = _last_ring(spark, path)
    if found is None:
        raise ValueError(f"{path} has no header of AES keys")
    return decrypted(rows, found[1], passphrase)


def change_passphrase(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Seal the keys of all saves under a new passphrase; the mapping itself is not touched."""
    ring, header = _last_ring(spark, path)
    salt, fresh = store_salt(header), os.urandom(fv.KDF_SALT_BYTES).hex()
    keys = _unwrapped(header, derived_key(old, bytes.fromhex(salt)), salt).select("save", F.lit(fresh).alias("salt"), F.col("_key").alias("blocks"))
    _wrapped(keys, {fresh: derived_key(new, bytes.fromhex(fresh))}).write.parquet(f"{_rings(path)}/ring={ring + 1}")


def merged(older: DataFrame, newer: DataFrame, *scope: str) -> DataFrame:
    """Both mappings; where a token is in both, the newer value."""
    rows = older.withColumn("_age", F.lit(0)).unionByName(newer.withColumn("_age", F.lit(1)))
    latest = rows.groupBy(*scope, "token").agg(F.max_by("value", "_age").alias("value"))
    return latest.select(*scope, "token", "value")
