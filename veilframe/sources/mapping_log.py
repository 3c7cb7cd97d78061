"""A mapping store as a log of versions.

Each append is a version, a table bucketed by scope and token and sorted within its buckets; nothing that is
written changes.  A snapshot is the latest value of every token up to a version: one base, which holds all before it, and
the few versions since.  Only the latter are shuffled.  The base keeps its buckets when it is joined with them and with the tokens
of texts, and a scope of any size is spread over the buckets.  Compaction writes the latest values as a new base;
older snapshots stay readable.

The manifest, one row per version, is written last: a version without its row is not there.  The driver reads the rows
since the last compaction, which ``append`` makes at least every ``most_versions`` versions.  Rows without a scope or a token are not
kept, as no text can refer to them.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.types import ENTRY
from ..operators.joins import HOT_ROWS, join_hot_keys
from ..operators.restore import restore
from ..functions.text import tokens_in
from . import mapping as mp

MANIFEST = "version bigint, base boolean, name string"


class MappingLog:
    """Columns ``scope`` (one name), token, value; values are sealed if there is a passphrase."""

    def __init__(
        self, spark: SparkSession, path: str, scope: str, kind: str = "bigint", buckets: int = 32, passphrase: str | None = None, most_versions: int = 64
    ):
        self.spark, self.path, self.scope, self.kind = spark, path.rstrip("/"), scope, kind
        self.buckets, self.passphrase, self.most_versions = buckets, passphrase, most_versions

    def _manifest(self, version: int | None = None) -> list[Row]:
        """The newest base up to a version, if there is one, and the versions after it."""
        rows = mp._read(self.spark, f"{self.path}/manifest", MANIFEST)
        if rows is None:
            return []
        rows = rows.where(F.col("version") <= version) if version is not None else rows
        base = rows.where("base").agg(F.max("version")).first()[0] or 0
        return sorted(rows.where(F.col("version") >= base).collect(), key=lambda r: (r.version, r.name))

    def version(self) -> int:
        return max((r.version for r in self._manifest()), default=0)

    def _table(self, name: str) -> DataFrame:
        """A version's table, known to this session by its place and its buckets."""
        if not self.spark.catalog.tableExists(name):
            value = "value binary, save string" if self.passphrase else "value string"
            self.spark.sql(
                f"CREATE TABLE {name} ({self.scope} {self.kind}, token string, {value}) USING parquet "
                f"CLUSTERED BY ({self.scope}, token) SORTED BY ({self.scope}, token) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(name)

    def _commit(self, rows: DataFrame, version: int, base: bool) -> int:
        name = f"mapping_{os.urandom(8).hex()}"
        rows.repartition(self.buckets, self.scope, "token").write.format("parquet").bucketBy(self.buckets, self.scope, "token").sortBy(
            self.scope, "token"
        ).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.spark.createDataFrame([(version, base, name)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def append(self, mapping: DataFrame) -> int:
        """A new version; a token that comes twice in it counts with its largest value."""
        rows = mapping.select(F.col(self.scope).cast(self.kind).alias(self.scope), "token", "value").where(F.col(self.scope).isNotNull() & F.col("token").isNotNull())
        rows = rows.groupBy(self.scope, "token").agg(F.max("value").alias("value"))
        if self.passphrase:
            found = mp._last_ring(self.spark, self.path)
            rows, header = mp.encrypted(rows, self.passphrase, mp.store_salt(found[1]) if found else None)
            header.write.mode("append").parquet(f"{self.path}.keys/ring={found[0] if found else 0}")
        since = self._manifest()
        made = self._commit(rows, max((r.version for r in since), default=0) + 1, not since)
        if len(since) + 1 > self.most_versions:
            self.compact()
        return made

    def _parts(self, version: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        """The base as it is stored, and what the versions after it hold last; None where there is none."""
        first, *rest = self._manifest(version) or [None]
        if first is None:
            return None, None
        base = self._table(first.name)
        if not rest:
            return base, None
        rows = functools.reduce(DataFrame.unionByName, [self._table(r.name).withColumn("_version", F.lit(r.version)) for r in rest])
        held = [c for c in base.columns if c not in (self.scope, "token")]
        return base, rows.groupBy(self.scope, "token").agg(F.max_by(F.struct(*held), "_version").alias("_new"))

    def _latest(self, version: int | None) -> DataFrame | None:
        """The latest rows as they are stored, sealed if they are."""
        base, newer = self._parts(version)
        if newer is None:
            return base
        keys = [self.scope, "token"]
        held = F.struct(*[c for c in base.columns if c not in keys])
        old = base.select(*keys, held.alias("_old")).join(newer, keys, "left").select(*keys, F.coalesce("_new", "_old").alias("_held"))
        fresh = newer.join(base, keys, "left_anti").select(*keys, F.col("_new").alias("_held"))
        return old.unionByName(fresh).select(*keys, "_held.*")

    def compact(self) -> int:
        """Write the latest values as one version, still sealed under their saves' keys."""
        rows = self._latest(None)
        return self._commit(rows, self.version() + 1, True) if rows is not None else 0

    def _opened(self, rows: DataFrame) -> DataFrame:
        return mp.decrypted(rows, mp._last_ring(self.spark, self.path)[1], self.passphrase) if self.passphrase else rows

    def snapshot(self, version: int | None = None) -> DataFrame:
        """scope, token and the latest value up to a version (all of them by default)."""
        rows = self._latest(version)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.scope} {self.kind}, token string, value string")
        return self._opened(rows)

    def _answers(self, asked: DataFrame, version: int | None) -> DataFrame:
        """The tokens asked for that the log holds, with their values as stored: they move to the base's buckets."""
        base, newer = self._parts(version)
        keys = [self.scope, "token"]
        held = [c for c in base.columns if c not in keys]
        found = asked.join(base.select(*keys, F.struct(*held).alias("_held")), keys, "left")
        if newer is not None:
            found = found.join(newer, keys, "left").withColumn("_held", F.coalesce("_new", "_held"))
        return found.where(F.col("_held").isNotNull()).select(*asked.columns, "_held.*")

    def restored(self, texts: DataFrame, key: str, text: str = "response", version: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
        """Texts (unique ``key``, scope, text) with ``entity_map`` and ``rehydrated_text``.

        Each token that texts of a scope hold meets the log once; the answers go back to the texts, spread over
        tasks where very many texts hold the same token.
        """
        nothing = F.array().cast(f"array<{ENTRY}>")
        asked = texts.select(key, self.scope, F.explode(F.array_distinct(F.transform(tokens_in(F.col(text)), F.upper))).alias("token"))
        if not self._manifest(version):
            return restore(texts.withColumn("entity_map", nothing), text, "entity_map")
        answers = self._opened(self._answers(asked.select(self.scope, "token").distinct(), version))
        found = join_hot_keys(asked, answers, self.scope, "token", hot_rows=hot_rows).where(F.col("value").isNotNull())
        maps = found.groupBy(key).agg(F.collect_list(F.struct("token", "value")).alias("entity_map"))
        return restore(texts.join(maps, key, "left").withColumn("entity_map", F.coalesce("entity_map", nothing)), text, "entity_map")
