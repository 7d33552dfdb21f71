"""A content-addressed store as a Spark data source: written in two phases, read by runs of its shard folders.

An object lies at aa/bb/<hash> below a store's root. Tasks of a write put every object they hold into all its stores,
below <root>/_staged/<job>/<attempt>, with an index of what they wrote; a store that fails leaves the others alone. The
commit notes the attempts that succeeded, one name a task, and nothing else; the files of these are then moved to their
places by tasks, which may be run again, since a move that was made is found made. An abort takes the job's folder, which
no task makes, out of the way of tasks that still run, and removes it. So a task that fails half-way leaves nothing, and
of several attempts at one task one counts.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..functions import payloads
from ..functions.scalars import is_content_hash
from .shared import BATCH_BYTES, shared_folder, small_batches

FORMAT = "stowage_objects"
SCHEMA = "external_id string, size bigint, payload binary"
#: Partitions of a read; each lists a run of the 256 first folders.
RUNS = 64
_PREFIXES = [f"{i:02x}" for i in range(256)]


class Place(NamedTuple):
    """A store that is written: its name, its root, and the codec of what it holds ('none' or 'zstd')."""

    name: str
    root: str
    codec: str = "none"


def local(root: str) -> str:
    """The path of a root, which must be mounted where tasks run."""
    return "/" + root[5:].lstrip("/") if root.startswith("file:") else root


def place_of(external_id: str) -> str:
    return f"{external_id[:2]}/{external_id[2:4]}/{external_id}"


def _put(path: str, body: bytes) -> None:
    with open(path, "wb") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(path, 0o644)


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.job, self.places = options["job"], [Place(*p) for p in json.loads(options["places"])]

    def write(self, iterator: Iterator) -> Attempt:
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}"
        packer, index, broken = zstandard.ZstdCompressor(), {p: [] for p in self.places}, set()
        for p in self.places:
            try:
                os.mkdir(f"{local(p.root)}/_staged/{self.job}/{name}")
            except OSError:  # this store's trouble, not the task's; or the job was aborted
                broken.add(p)
        for row in iterator:
            for p in self.places:
                if p in broken:
                    continue
                body = packer.compress(bytes(row.content)) if p.codec == "zstd" else bytes(row.content)
                try:
                    _put(f"{local(p.root)}/_staged/{self.job}/{name}/{row.external_id}", body)
                except OSError:
                    broken.add(p)
                    continue
                index[p].append((row.external_id, len(body)))
        for p in self.places:
            if p not in broken:
                try:
                    _put(f"{local(p.root)}/_staged/{self.job}/{name}/index", "".join(f"{i} {n}\n" for i, n in index[p]).encode())
                except OSError:
                    pass
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        names = [m.name for m in messages if m is not None]
        for p in self.places:
            try:
                _put(f"{local(p.root)}/_staged/{self.job}/committed", json.dumps(names).encode())
            except OSError:
                pass

    def abort(self, messages: list[Attempt | None]) -> None:
        for p in self.places:
            folder = f"{local(p.root)}/_staged/{self.job}"
            try:
                os.rename(folder, f"{folder}-aborted")
            except OSError:
                continue
            shutil.rmtree(f"{folder}-aborted", ignore_errors=True)


@dataclass
class _Run(InputPartition):
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.payload, self.runs = local(options["path"]), options.get("payload", "true") == "true", int(options.get("runs", RUNS))
        self.only: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("external_id",):
                wanted = {w for w in wanted if isinstance(w, str) and re.fullmatch("[0-9a-f]{64}", w)}  # nothing else has a place
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[_Run]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is not there: what it holds is unknown, not missing")
        edges = [256 * k // self.runs for k in range(self.runs + 1)]
        runs = [_Run(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return runs if self.only is None else [r for r in runs if any(i[:2] in _PREFIXES[r.first : r.end] for i in self.only)]

    def _names(self, run: _Run) -> Iterator[str]:
        if self.only is not None:
            yield from (place_of(i) for i in sorted(self.only) if i[:2] in _PREFIXES[run.first : run.end])
            return
        for a in _PREFIXES[run.first : run.end]:
            if os.path.isdir(f"{self.root}/{a}"):
                for b in sorted(os.listdir(f"{self.root}/{a}")):
                    yield from (f"{a}/{b}/{n}" for n in sorted(os.listdir(f"{self.root}/{a}/{b}")))

    def _found(self, run: _Run) -> Iterator[tuple]:
        for name in self._names(run):
            try:
                with open(f"{self.root}/{name}", "rb") as f:
                    yield os.path.basename(name), os.fstat(f.fileno()).st_size, f.read() if self.payload else None
            except FileNotFoundError:
                continue

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._found(partition):
            more = len(row[0]) + len(row[2] or b"")
            if rows and (held + more > BATCH_BYTES or len(rows) == _BATCH_ROWS):
                yield _batch(rows)
                rows, held = [], 0
            rows.append(row)
            held += more
        if rows:
            yield _batch(rows)


_BATCH_ROWS = 10_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"external_id": pa.string(), "size": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class ObjectStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def objects(spark: SparkSession, root: str, payload: bool = True, runs: int = RUNS) -> DataFrame:
    """external_id, size, payload (null unless wanted) of what a store holds; a root that isn't there is an error."""
    spark.dataSource.register(ObjectStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).option("runs", runs).load(root)


def staged(content: DataFrame, places: Sequence[Place]) -> str:
    """Phase one: puts content (external_id, content) below all places and commits it; returns the job. What isn't a content hash is left out."""
    job = uuid.uuid4().hex
    for p in places:
        try:
            os.makedirs(f"{local(p.root)}/_staged/{job}")
        except OSError:
            pass
    content.sparkSession.dataSource.register(ObjectStore)
    rows = content.select("external_id", "content").where(is_content_hash(F.col("external_id")) & F.col("content").isNotNull())
    with small_batches(content.sparkSession):
        rows.write.format(FORMAT).option("job", job).option("places", json.dumps(list(places))).mode("append").save()
    return job


def published(spark: SparkSession, places: Sequence[Place], job: str) -> DataFrame:
    """Phase two, by tasks, as often as need be: external_id, target, stored_bytes of what lies in its place now. Write the result; a lazy one moves again."""
    rows = []
    for p in places:
        try:
            with open(f"{local(p.root)}/_staged/{job}/committed") as f:
                rows += [(p.name, local(p.root), name) for name in json.load(f)]
        except OSError:
            continue

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, root, name in batch.itertuples(index=False):
                folder, found = f"{root}/_staged/{job}/{name}", []
                if not os.path.exists(f"{folder}/index"):
                    continue
                with open(f"{folder}/index") as f:
                    lines = [x.split() for x in f]
                for external_id, size in lines:
                    own, final = f"{folder}/{external_id}", f"{root}/{place_of(external_id)}"
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    try:
                        os.replace(own, final)
                    except FileNotFoundError:
                        pass  # moved before
                    if os.path.exists(final):
                        found.append((external_id, target, int(size)))
                yield pd.DataFrame(found, columns=["external_id", "target", "stored_bytes"])

    table = spark.createDataFrame(rows, "target string, root string, attempt string")
    return table.repartition(max(1, len(rows))).mapInPandas(move, "external_id string, target string, stored_bytes long")


def stored(content: DataFrame, places: Sequence[Place]) -> DataFrame:
    """Writes content (external_id, content) to all places: external_id, target, ok, stored_bytes of every pair, refused hashes and broken stores included."""
    spark = content.sparkSession
    job = staged(content, places)
    path = shared_folder(spark, "published")
    published(spark, places, job).write.parquet(path)
    for p in places:
        shutil.rmtree(f"{local(p.root)}/_staged/{job}", ignore_errors=True)
    done = spark.read.schema("external_id string, target string, stored_bytes long").parquet(path).dropDuplicates(["external_id", "target"])
    every = content.select("external_id").distinct().withColumn("target", F.explode(F.array(*(F.lit(p.name) for p in places))))
    return every.join(done, ["external_id", "target"], "left").select("external_id", "target", F.col("stored_bytes").isNotNull().alias("ok"), F.coalesce("stored_bytes", F.lit(0)).cast("long").alias("stored_bytes"))


def restored(wanted: DataFrame, source: str, target: str) -> DataFrame:
    """Brings objects (external_id) from one store into another, as plain content: external_id, outcome, bytes.

    What the target holds intact is skipped; what is corrupt there is replaced, if the source has it right. missing: the
    source doesn't have it; failed: what it has isn't the object, or couldn't be written; a refused hash failed. Copies
    in ``wanted`` are one. bytes are those of the content.
    """
    spark = wanted.sparkSession
    ids = wanted.select("external_id").distinct()
    os.makedirs(local(target), exist_ok=True)
    digest = F.col("external_id")
    there = objects(spark, target).join(ids, "external_id", "left_semi").select("external_id", payloads.told(F.col("payload"), digest).alias("t")).where("t.ok").select("external_id", F.col("t.size").alias("there"))
    path = shared_folder(spark, "restore")
    with small_batches(spark):
        there.write.parquet(f"{path}/there")
    there = spark.read.schema("external_id string, there long").parquet(f"{path}/there")
    held = objects(spark, source).select("external_id", "payload", F.lit(True).alias("held"))
    rest = ids.join(there, "external_id", "left_anti").join(held, "external_id", "left")
    with small_batches(spark):
        rest.select("external_id", F.coalesce("held", F.lit(False)).alias("held"), payloads.content_of(F.col("payload"), digest).alias("content")).write.parquet(f"{path}/rest")
    rest = spark.read.schema("external_id string, held boolean, content binary").parquet(f"{path}/rest")
    done = stored(rest.where("content is not null").select("external_id", "content"), [Place("target", target)]).where("ok").select("external_id", F.lit(True).alias("ok"))
    judged = rest.select("external_id", "held", F.octet_length("content").cast("long").alias("bytes")).join(done, "external_id", "left")
    outcome = F.when(~is_content_hash(digest), "failed").when(~F.col("held"), "missing").when(F.col("ok"), "restored").otherwise("failed")
    fresh = judged.select("external_id", outcome.alias("outcome"), F.when(F.col("ok"), F.col("bytes")).otherwise(0).alias("bytes"))
    return there.select("external_id", F.lit("skipped").alias("outcome"), F.col("there").alias("bytes")).unionByName(fresh)
