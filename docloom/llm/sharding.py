"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder of Spark's file system. Each arrival is a run: a folder ``data/<run>`` of
shards (``part-*`` files) that are never changed. ``manifest/v<N>.json`` lists the runs of version N
with their sizes: a few dozen lines at any size of the corpus, as there are at most ``fanout`` runs a
tier and tiers grow by powers of ``fanout``. A writer adds files first and then commits version
N + 1 by renaming a finished file to a name that must not exist yet: readers see all of a
commit or nothing. Of two writers one fails and commits again upon the new version; a merge whose runs
another one has merged gives up its files. Files of a failed job are in no manifest. The rename must be atomic
and refuse existing names, as those of HDFS and local disks do; on object stores that can't, put the manifest
folder (``manifest_root``) on a file system that can.

append: one run of small shards, as many as the input has partitions.
compact: runs are put in tiers by size (tier i: up to ``base_bytes * fanout**i``); a tier with ``fanout``
runs is merged into one run of files of about ``target_bytes``, by one job without a shuffle, which joins the
input's read partitions. Repeats until no tier is full. Only folder names and sizes pass through the
driver, never rows or lists of files. Old runs stay readable for older versions until vacuum(); a bulk load can
vacuum as it goes.

Defined cases: rows, with nulls, repeats, very long texts and extra columns of any name, come back as they went
in; an empty input commits a version that has its schema and no rows. shard_rows replaces columns
that are named like those it adds.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import without

TARGET_BYTES = 128 << 20
BASE_BYTES = 1 << 20
FANOUT = 4
#: Runs that one bulk load arrives in.
ARRIVALS = 8
ADDED = ("shard", "shard_bytes", "run", "tier", "version")
_ARRIVAL = "__dl_arrival"


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    runs: tuple[Run, ...]


class ManifestConflict(RuntimeError):
    """Another writer has committed first, and this change doesn't fit its version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES, manifest_root: str | None = None):
        self.spark, self.root, self.target_bytes, self.fanout, self.base_bytes = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        self.manifests = (manifest_root or f"{self.root}/manifest").rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._hadoop.Path(name)
        return path.getFileSystem(self._conf), path

    # manifests

    def latest(self) -> Version | None:
        fs, folder = self._at(self.manifests)
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        return self.version(max(numbers)) if numbers else None

    def version(self, number: int) -> Version:
        fs, path = self._at(f"{self.manifests}/v{number:08d}.json")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(found["version"], found["schema"], tuple(Run(**r) for r in found["runs"]))

    def _put(self, version: Version) -> None:
        """Write a version under its name, or raise ManifestConflict if there is one."""
        body = json.dumps({"version": version.number, "schema": version.schema, "runs": [vars(r) for r in version.runs]})
        fs, draft = self._at(f"{self.manifests}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        _, name = self._at(f"{self.manifests}/v{version.number:08d}.json")
        context = self._hadoop.FileContext.getFileContext(name.toUri(), self._conf)
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(name), none)  # fails if the name exists
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(name):
                raise ManifestConflict(f"version {version.number} exists") from e
            raise

    def commit(self, schema: str, add: tuple[Run, ...], remove: tuple[Run, ...] = ()) -> Version:
        """The newest version with runs added and removed; upon a conflict, once more on what is newest then."""
        while True:
            now = self.latest()
            if now and _plain(now.schema) != _plain(schema):
                raise ValueError("arrivals have another schema than the store")
            runs = now.runs if now else ()
            if not set(remove) <= set(runs):
                raise ManifestConflict("a run to be merged is not in the newest version")
            new = Version(now.number + 1 if now else 1, now.schema if now else schema, tuple(r for r in runs if r not in remove) + add)
            try:
                self._put(new)
                return new
            except ManifestConflict:
                continue  # some writer has made progress

    # runs

    def _run(self, path: str) -> tuple[Run, ...]:
        """The run in a folder, none if it has no shards; sizes are summed by the file system."""
        fs, folder = self._at(f"{self.root}/{path}")
        if not fs.exists(folder):
            return ()
        found = [s.getLen() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        return (Run(path, sum(found), len(found)),) if found else ()

    def append(self, arrivals: DataFrame) -> Version:
        """Add one run of shards; the schema must be that of the store."""
        now = self.latest()
        schema = arrivals.schema.json()
        if now and _plain(now.schema) != _plain(schema):
            raise ValueError("arrivals have another schema than the store")
        path = f"data/{uuid.uuid4().hex}"
        arrivals.write.parquet(f"{self.root}/{path}")
        return self.commit(schema, self._run(path))

    def load(self, rows: DataFrame, arrivals: int = ARRIVALS, keep: int | None = None) -> Version:
        """A bulk load: rows are dealt into arrivals by one job, each committed by itself and compacted as it comes.

        With ``keep``, only so many of the newest versions stay readable: runs that were merged go after each
        merge, so that the store never holds two copies of all rows. Only for a store with one writer.
        """
        schema, path = rows.schema.json(), f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_ARRIVAL, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals)).cast("int"))
        dealt.write.partitionBy(_ARRIVAL).parquet(f"{self.root}/{path}")
        now = None
        for i in range(arrivals):
            run = self._run(f"{path}/{_ARRIVAL}={i}")
            if run:
                now = self.commit(schema, run)
                now = self.compact()
                if keep:
                    self.vacuum(keep)
        return now or self.commit(schema, ())

    def tier(self, size: int) -> int:
        """0: up to base_bytes; i: up to base_bytes * fanout**i."""
        i, limit = 0, self.base_bytes
        while size > limit:
            i, limit = i + 1, limit * self.fanout
        return i

    def compact(self) -> Version | None:
        """Merge full tiers, the smallest first, until none is left; one commit for each merge."""
        while now := self.latest():
            tiers: dict[int, list[Run]] = {}
            for run in now.runs:
                tiers.setdefault(self.tier(run.bytes), []).append(run)
            full = [t for t, runs in tiers.items() if len(runs) >= self.fanout]
            if not full:
                return now
            merged = tuple(tiers[min(full)][: self.fanout])
            path = f"data/{uuid.uuid4().hex}"
            parts = max(1, -(-sum(r.bytes for r in merged) // self.target_bytes))
            self._read(now.schema, merged).coalesce(parts).write.parquet(f"{self.root}/{path}")
            try:
                self.commit(now.schema, self._run(path), merged)
            except ManifestConflict:  # another compaction was first
                fs, folder = self._at(f"{self.root}/{path}")
                fs.delete(folder, True)
        return None

    def _read(self, schema: str, runs: tuple[Run, ...]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{r.path}" for r in runs])

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number) if number else self.latest()
        if version is None:
            raise FileNotFoundError(f"no version in {self.manifests}")
        return self._read(version.schema, version.runs)

    def vacuum(self, keep: int = 1, orphan_hours: float = 168) -> int:
        """Delete runs that older versions list and none of the last ``keep`` does, and with them those versions.

        A folder that no version lists may belong to a writer that hasn't committed yet: it goes only
        when it is older than ``orphan_hours``. The number of folders deleted.
        """
        now = self.latest()
        if now is None:
            return 0
        fs, folder = self._at(self.manifests)
        numbers = sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        old = [n for n in numbers if n <= now.number - keep]
        live = {r.path for n in numbers if n not in old for r in self.version(n).runs}
        dead = {r.path for n in old for r in self.version(n).runs} - live
        for n in old:  # first the versions, so that none lists runs that are gone
            fs.delete(self._at(f"{self.manifests}/v{n:08d}.json")[1], False)
        gone, horizon = 0, (time.time() - orphan_hours * 3600) * 1000
        for path in dead:
            data, target = self._at(f"{self.root}/{path}")
            gone += bool(data.delete(target, True))
        data, top = self._at(f"{self.root}/data")
        for found in data.listStatus(top):
            name = f"data/{found.getPath().getName()}"
            used = any(r == name or r.startswith(f"{name}/") for r in live)
            if not used and found.getModificationTime() < horizon:
                gone += bool(data.delete(found.getPath(), True))
        return gone


def _plain(schema: str) -> list:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(schema)).fields]


def shard(documents: DataFrame, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, arrivals: int = ARRIVALS) -> ShardStore:
    """Load the documents into a new store as arrivals of small shards, compacted as they come; only the newest version stays."""
    store = ShardStore(documents.sparkSession, root, target_bytes, fanout)
    store.load(documents, arrivals, keep=1)
    return store


def shard_rows(store: ShardStore) -> DataFrame:
    """The store's rows with shard (the file, below the root), shard_bytes, run, tier and version."""
    version = store.latest()
    rows = store.read()
    if not version.runs:
        added = [F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit("").alias("run"), F.lit(0).alias("tier")]
    else:
        # a run is one of a few dozen: its tier is a constant for each
        of = F.create_map(*[F.lit(x) for r in version.runs for x in (r.path, store.tier(r.bytes))])
        path = F.col("_metadata.file_path")
        run = F.regexp_extract(path, rf"/(data/[0-9a-f]{{32}}(?:/{_ARRIVAL}=\d+)?)/[^/]*$", 1)
        added = [F.concat_ws("/", run, F.element_at(F.split(path, "/"), -1)).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), run.alias("run"), of[run].alias("tier")]
    kept = without(rows, *ADDED).columns
    return rows.select(*["`" + c.replace("`", "``") + "`" for c in kept], *added, F.lit(version.number).alias("version"))
