"""A store of immutable shards with size-tiered compaction, in DataFrame operations only.

Arrivals are appended as they come, one Parquet shard per task. Compaction puts
shards in tiers by size, takes runs of neighbours within a tier until they fill
a target-sized file, and rewrites each run as one shard; one round rewrites all
its runs in one job, with each run dealt to a partition of its own. A version of
the store is a manifest: the list of live shards, written beside the others and
renamed into place, which fails if that version exists already. Readers see the
old version or the new one, never a mixture, and a job that dies before the
rename leaves files that no manifest names.

The driver handles metadata only, one line a shard. Rows never pass through it.

Defined results: nulls, empty texts, repeated rows and columns of any name are
stored as they are, and names clash with nothing: where a column is called ``_metadata``
the files' metadata are still found. An empty arrival commits a version without new shards.
Reading a store whose versions are all empty gives an empty table. A writer that finds its
version taken appends again on the newest one; a compaction then plans anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waymark.llm._arrow import unused
from waymark.scratch import Scratch, delete_path

TARGET_BYTES = 128 << 20
#: Shards under this are all of the lowest tier; each tier is FANOUT times the one below.
FLOOR_BYTES = 1 << 20
FANOUT = 4
#: Shards rewritten in one round; further ones wait for the next round.
ROUND_SHARDS = 10_000
#: Times that a writer starts again on the newest version when another has committed first.
ATTEMPTS = 8
#: Arrivals of ``op10_sharding``: the table comes in this many appends.
ARRIVALS = 4


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


def tier(size: int, floor_bytes: int = FLOOR_BYTES, fanout: int = FANOUT) -> int:
    level, edge = 0, floor_bytes
    while size >= edge:
        level, edge = level + 1, edge * fanout
    return level


def plan_runs(shards: tuple[Shard, ...], target: int, floor_bytes: int = FLOOR_BYTES, fanout: int = FANOUT, most: int = ROUND_SHARDS) -> list[list[Shard]]:
    """Runs to merge, each within one tier, in order of arrival. A run is closed when it
    reaches the target; a shorter rest is merged if it has ``fanout`` shards at least."""
    by_tier: dict[int, list[Shard]] = {}
    for shard in shards:
        if shard.bytes < target // 2:
            by_tier.setdefault(tier(shard.bytes, floor_bytes, fanout), []).append(shard)
    runs, taken = [], 0
    for level in sorted(by_tier):
        run: list[Shard] = []
        for shard in [*by_tier[level], None]:
            full = run and (shard is None or sum(x.bytes for x in run) + shard.bytes > target)
            if full:
                if len(run) >= fanout or (shard is not None and len(run) > 1):
                    runs.append(run)
                    taken += len(run)
                run = []
            if shard is None or taken >= most:
                break
            run.append(shard)
    return runs


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, floor_bytes: int = FLOOR_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.floor, self.fanout = target_bytes, floor_bytes, fanout

    # -- manifests ---------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, None, ())
        lines = [json.loads(x.value) for x in self.spark.read.text(self._manifest_path(version)).orderBy(F.monotonically_increasing_id()).collect()]
        head = next(x for x in lines if "schema" in x)
        return Manifest(version, head["schema"], tuple(Shard(**x) for x in sorted((x for x in lines if "seq" in x), key=lambda x: x.pop("seq"))))

    def _commit(self, base: Manifest, schema: str | None, shards: tuple[Shard, ...]) -> Manifest:
        """Write the next version beside the others, then rename it; the rename never replaces a file."""
        new = Manifest(base.version + 1, schema, shards)
        text = "\n".join([json.dumps({"version": new.version, "schema": schema}), *(json.dumps(asdict(s) | {"seq": i}) for i, s in enumerate(shards))])
        fs, draft = self._fs(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(self._manifest_path(new.version)), none)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {new.version} exists") from error
            raise
        return new

    # -- shards ------------------------------------------------------------

    def _write(self, df: DataFrame) -> tuple[Shard, ...]:
        """Write ``df``, a shard per task that has rows, and list what was written."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        rows = self.spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(folder)
        meta = rows.metadataColumn("_metadata")
        found = rows.groupBy(meta["file_path"].alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.max(meta["file_size"]).alias("bytes"))
        return tuple(Shard(x.path, x.rows, x.bytes) for x in sorted(found.collect()))

    def append(self, docs: DataFrame) -> Manifest:
        """Write the arrivals as small shards and commit them."""
        written = self._write(docs)
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self._commit(base, docs.schema.json(), base.shards + written)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} writers came first")

    def compact(self) -> Manifest:
        """Merge runs, round by round, until no tier has a run; each round commits a version."""
        conflicts, base = 0, self.manifest()
        while runs := plan_runs(base.shards, self.target, self.floor, self.fanout):
            where = {s.path: i for i, run in enumerate(runs) for s in run}
            # At most ROUND_SHARDS rows, so this side is small whatever the store holds.
            groups = F.broadcast(self.spark.createDataFrame(list(where.items()), "path string, run int"))
            rows = self._rows(base.schema, list(where))
            (path,) = unused(rows, "shard_path")
            located = rows.withColumn(path, rows.metadataColumn("_metadata")["file_path"])
            merged = located.join(groups, located[path] == groups["path"]).repartitionById(len(runs), groups["run"]).drop(groups["run"], groups["path"]).drop(path)
            written = self._write(merged)
            try:
                base = self._commit(base, base.schema, tuple(s for s in base.shards if s.path not in where) + written)
            except Conflict:
                conflicts, base = conflicts + 1, self.manifest()
                if conflicts == ATTEMPTS:
                    raise
        return base

    def _rows(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            raise ValueError("the store has no version yet")
        if not manifest.shards:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(manifest.schema)))
        return self._rows(manifest.schema, [s.path for s in manifest.shards])

    def vacuum(self) -> int:
        """Delete shards and manifests that the newest version no longer names; returns how many shards went."""
        last = self.manifest()
        live = {s.path for s in last.shards}
        gone: set[str] = set()
        for version in self.versions():
            if version < last.version:
                gone |= {s.path for s in self.manifest(version).shards} - live
                delete_path(self.spark, self._manifest_path(version))
        for path in gone:
            delete_path(self.spark, path)
        return len(gone)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored in ARRIVALS appends and compacted, as the committed version gives them back."""
    store = ShardStore(spark, f"{Scratch(spark, 'shards').path}/store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for n in range(ARRIVALS):
        store.append(docs.filter(arrival == n))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP10_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
