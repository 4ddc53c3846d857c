"""Tables that are changed by adding generations, with one pointer to what is current.

A store is a folder of tables.  A change writes, for each table, the new rows and the *scopes* whose
earlier rows it takes back (a tombstone each), and nothing else: what is written follows the change
and not the table.  A manifest names the parts of all tables that make up one version; renaming a new
manifest into its place is the whole commit.  Readers hold on to one manifest, so they see all tables
before a change or all after it, and parts stay until :meth:`Store.vacuum`.

``rows/generation=7/attempt=…``     rows of generation 7
``removed/generation=7/attempt=…``  scopes whose rows of earlier generations are gone
``_versions/00000000000000000007.json``   the manifest of version 7

A row is live unless its scope was removed by a later generation.  Many small generations are merged
by :meth:`Store.maintain`, smallest and newest first, so each row is rewritten about the logarithm of
the number of generations times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources import files

VERSIONS = "_versions"
#: Generations of one table beyond which maintenance merges some.
MOST_PARTS = 12
#: A part is merged with newer ones that together are larger than this share of it.
MERGE_SHARE = 0.25


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


@dataclass(frozen=True)
class Part:
    """What one generation holds of a table: a merged part stands for generations ``first`` to ``last``."""

    first: int
    last: int
    rows: str | None
    removed: str | None
    n_rows: int = 0
    n_removed: int = 0

    @property
    def size(self) -> int:
        return self.n_rows + self.n_removed


@dataclass(frozen=True)
class Table:
    """Columns of a table, and the one by which rows are taken back."""

    name: str
    schema: str
    scope: str

    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()


@dataclass(frozen=True)
class Change:
    """New rows of a table, and a table of the scopes whose earlier rows go (null: none)."""

    rows: DataFrame | None = None
    removed: DataFrame | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    parts: dict[str, list[Part]] = field(default_factory=dict)
    #: Last batch that each writer has committed.
    writers: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        read = json.loads(text)
        parts = {name: [Part(**p) for p in own] for name, own in read["parts"].items()}
        return cls(read["version"], parts, read["writers"])


class Snapshot:
    """One version of a store, whatever is committed meanwhile."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.manifest = store, manifest

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        return self.store._live(self.store.tables[name], self.manifest.parts.get(name, []))


class Store:
    """Tables below one folder of a file system that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, tables: Iterable[Table]):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {table.name: table for table in tables}

    # --- reading ---------------------------------------------------------------

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that was not removed yet."""
        if version is None:
            version = max(self._versions(), default=0)
        return Snapshot(self, self._manifest(version))

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def _live(self, table: Table, parts: list[Part]) -> DataFrame:
        """Rows of the given parts whose scope no later one of them removes.

        Removals name the last generation that asked for them; a small table of removals is
        broadcast by Spark, a large one is joined by the scope like any other.
        """
        rows = self._read(table, "rows", parts, f"{table.schema}, generation long, attempt string")
        columns = [c for c in rows.columns if c not in ("generation", "attempt")]
        later = [p for p in parts if p.removed and p.last > min((q.last for q in parts if q.rows), default=p.last)]
        if not later:
            return rows.select(columns)
        scope_type = rows.schema[table.scope].dataType.simpleString()
        gone = (
            self._read(table, "removed", later, f"{table.scope} {scope_type}, generation long, attempt string")
            .groupBy(F.col(table.scope).alias("_scope"))
            .agg(F.max("generation").alias("_gone"))
        )
        held = rows.join(gone, F.col(table.scope) == F.col("_scope"), "left")
        return held.where("_gone IS NULL OR generation >= _gone").select(columns)

    def _read(self, table: Table, kind: str, parts: list[Part], schema: str) -> DataFrame:
        base = f"{self.path}/{table.name}/{kind}"
        paths = [f"{base}/{path}" for p in parts if (path := p.rows if kind == "rows" else p.removed)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    # --- changing --------------------------------------------------------------

    def commit(
        self, changes: dict[str, Change], writer: str | None = None, batch: int | None = None, base: Snapshot | None = None
    ) -> int:
        """Write one generation of all given tables and make it current; its version is returned.

        ``base`` is the version the change was made from; a change from an older one is refused.  A
        batch that its writer has committed already is not written again, so a stream may repeat it.
        """
        base = base or self.snapshot()
        if self.committed(writer, batch, base):
            return base.manifest.version
        version = base.manifest.version + 1
        parts = {name: list(own) for name, own in base.manifest.parts.items()}
        for name, change in changes.items():
            part = self._write(self.tables[name], change, version, version)
            if part.size:
                parts.setdefault(name, []).append(part)
        writers = dict(base.manifest.writers)
        if writer is not None and batch is not None:
            writers[writer] = batch
        self._publish(Manifest(version, parts, writers))
        return version

    @staticmethod
    def committed(writer: str | None, batch: int | None, base: Snapshot) -> bool:
        return writer is not None and batch is not None and base.manifest.writers.get(writer, -1) >= batch

    def _write(self, table: Table, change: Change, first: int, last: int) -> Part:
        """Files of one generation; a folder of its own for each attempt."""
        place = f"generation={last}/attempt={uuid.uuid4().hex}"
        paths, counts = {}, {}
        for kind, df in (("rows", change.rows), ("removed", change.removed)):
            counts[kind], paths[kind] = 0, None
            if df is None:
                continue
            scopes = df.select(table.scope).where(F.col(table.scope).isNotNull()).distinct()
            seen = Observation()
            (
                (df.select(*table.columns()) if kind == "rows" else scopes)
                .hint("rebalance", table.scope)
                .observe(seen, F.count(F.lit(1)).alias("n"))
                .write.parquet(f"{self.path}/{table.name}/{kind}/{place}")
            )
            counts[kind] = seen.get["n"]
            paths[kind] = place if counts[kind] else None
        return Part(first, last, paths["rows"], paths["removed"], counts["rows"], counts["removed"])

    # --- maintenance -----------------------------------------------------------

    def maintain(
        self, most: int = MOST_PARTS, tidy: dict[str, Callable[[DataFrame], DataFrame]] | None = None, whole: bool = False
    ) -> bool:
        """Merge generations of tables that have more than ``most``; ``whole`` merges all of them.

        ``tidy`` names for a table what the rows of a merge may lose, such as versions beyond the
        fifth; it must come to the same when it is applied to parts of a table and then to the rest.
        """
        base = self.snapshot()
        parts, merged = dict(base.manifest.parts), False
        for name, own in base.manifest.parts.items():
            chosen = own if whole else _mergeable(own, most)
            if len(chosen) < 2 and not whole:
                continue
            table, kept = self.tables[name], own[: len(own) - len(chosen)]
            rows = self._live(table, chosen)
            if tidy and name in tidy:
                rows = tidy[name](rows)
            # Removals still concern the parts below; without any there is nothing left to remove.
            removed = None
            if kept and any(p.removed for p in chosen):
                scope = f"{table.scope} {rows.schema[table.scope].dataType.simpleString()}"
                removed = self._read(table, "removed", chosen, f"{scope}, generation long, attempt string").select(table.scope)
            part = self._write(table, Change(rows, removed), chosen[0].first, chosen[-1].last)
            parts[name] = [*kept, part] if part.size else kept
            merged = True
        if merged:
            self._publish(Manifest(base.manifest.version + 1, parts, base.manifest.writers))
        return merged

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete parts that none of the newest versions names, and older manifests; the parts deleted."""
        versions = sorted(self._versions())
        kept = versions[-keep_versions:]
        named = set()
        for version in kept:
            for name, own in self._manifest(version).parts.items():
                named |= {f"{name}/{kind}/{p}" for part in own for kind, p in (("rows", part.rows), ("removed", part.removed)) if p}
        gone = 0
        for name in self.tables:
            for kind in ("rows", "removed"):
                for generation in files.names(self.spark, f"{self.path}/{name}/{kind}"):
                    number = int(generation.removeprefix("generation=")) if generation.startswith("generation=") else None
                    if number is None or number > (kept[-1] if kept else 0):
                        continue  # not a part, or one that is being written
                    for attempt in files.names(self.spark, f"{self.path}/{name}/{kind}/{generation}"):
                        if f"{name}/{kind}/{generation}/{attempt}" not in named:
                            files.delete(self.spark, f"{self.path}/{name}/{kind}/{generation}/{attempt}")
                            gone += 1
        for version in versions[:-keep_versions]:
            files.delete(self.spark, self._manifest_path(version))
        return gone

    # --- manifests -------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/{VERSIONS}/{version:020d}.json"

    def _versions(self) -> list[int]:
        names = files.names(self.spark, f"{self.path}/{VERSIONS}")
        return [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != "."]

    def _manifest(self, version: int) -> Manifest:
        if version == 0:
            return Manifest()
        text = self.spark.read.text(self._manifest_path(version), wholetext=True).first()
        return Manifest.from_json(text.value)

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest aside and rename it; a manifest that is there already is never replaced."""
        aside = f"{self.path}/{VERSIONS}/.{uuid.uuid4().hex}.tmp"
        files.write_text(self.spark, aside, manifest.to_json())
        if not files.move(self.spark, aside, self._manifest_path(manifest.version)):
            files.delete(self.spark, aside)
            raise Conflict(f"version {manifest.version} of {self.path} was committed by another writer")


def _mergeable(parts: list[Part], most: int) -> list[Part]:
    """The newest parts that are not small beside what comes after them, if there are too many parts."""
    if len(parts) <= most:
        return []
    start, newer = len(parts) - 2, parts[-1].size
    while start > 0 and (newer > MERGE_SHARE * parts[start - 1].size or start > most // 2):
        newer += parts[start].size
        start -= 1
    return parts[start:]
