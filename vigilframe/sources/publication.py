"""Published tables: immutable versions, and a numbered manifest that names the one in force.

Rows are written once, into a folder of their own; while they are written, their count
and sums of their hashes are observed, which tell equal tables whatever the order of
rows.  A version becomes the published one by a single rename of its manifest to the
next number, which fails if the number exists.  So readers see the old table or the new
one, a failed write leaves the old one, and of two writers one is told of the other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    digest: str
    rows: int
    schema: str
    changed: bool = True


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    path, fs = _files(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifests/{number:012}.json"


def latest(spark: SparkSession, root: str) -> Version | None:
    """The version in force; None before the first."""
    if not (numbers := _numbers(spark, root)):
        return None
    body = spark.read.text(_manifest(root, numbers[-1]), wholetext=True).first()[0]
    return Version(**json.loads(body), changed=False)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The published table; None before the first version."""
    if (version := latest(spark, root)) is None:
        return None
    return spark.read.schema(version.schema).parquet(version.path)


def _switch(spark: SparkSession, root: str, version: Version) -> None:
    """Makes a version the published one, in one step."""
    path, fs = _files(spark, root)
    draft, target = path(f"{root}/manifests/.{uuid.uuid4().hex}"), path(_manifest(root, version.number))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({k: v for k, v in asdict(version).items() if k != "changed"}).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{target} exists") from e
        raise


def publish(rows: DataFrame, root: str, ignored: tuple[str, ...] = ("generatedAt",), most_bytes: int | None = None, after: int | None = None) -> Version:
    """Publish ``rows`` unless the table in force holds just them.

    Columns in ``ignored`` don't make a difference.  ``most_bytes`` bounds the rows'
    JSON; ``after`` is the number of the version that the rows were derived from (0:
    none), so that a version published meanwhile is not replaced unseen.
    """
    spark = rows.sparkSession
    now = latest(spark, root)
    if after is not None and after != (now.number if now else 0):
        raise Conflict(f"{root} is at version {now.number if now else 0}, not {after}")
    named = sorted(c for c in rows.columns if c not in ignored)
    seen, folder = Observation(uuid.uuid4().hex), f"{root}/versions/{uuid.uuid4().hex}"
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *[F.to_json(F.struct(c)) for c in named]).cast("decimal(38,0)"))
    size = F.sum(F.octet_length(F.to_json(F.struct(*named))) + 1)
    rows.observe(seen, F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"), size.alias("bytes")).write.parquet(folder)
    path, fs = _files(spark, root)
    found = seen.get
    digest = f"{found['n']}:{found['a'] or 0}:{found['b'] or 0}"
    if most_bytes is not None and (found["bytes"] or 0) > most_bytes:
        fs.delete(path(folder), True)
        raise ValueError(f"{found['bytes']} bytes, more than {most_bytes}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if now and (now.digest, now.schema) == (digest, schema):
        fs.delete(path(folder), True)
        return now
    version = Version((now.number if now else 0) + 1, folder, digest, found["n"], schema)
    try:
        _switch(spark, root, version)
    except Conflict:
        fs.delete(path(folder), True)
        raise
    return version


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes versions but the last ``keep`` that were published, and what was never published; gives their number.

    Not to be run beside a writer, whose version is not published yet.
    """
    path, fs = _files(spark, root)
    held = set()
    for number in _numbers(spark, root)[-keep:]:
        held.add(json.loads(spark.read.text(_manifest(root, number), wholetext=True).first()[0])["path"].rpartition("/")[2])
    folder = path(f"{root}/versions")
    gone = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
