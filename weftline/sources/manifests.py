"""Manifests of output folders: files by their path in the folder, hashed by pieces.

A file is read by executors piece by piece, so that none is ever a value in memory, and a large one
is many tasks. A file of one piece has its plain sha256; one of several has the sha256 over its
pieces' digests, which are listed too, so that a check can say which piece changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical

#: Bytes of a piece, and of what a task holds of it at once.
PIECE_BYTES, READ_BYTES = 256 << 20, 4 << 20
SCHEMA_VERSION = "weftline.artifact_manifest.v1"
FILE = "struct<path:string,bytes:bigint,sha256:string,pieces:array<string>>"


def qualified(spark: SparkSession, path: str) -> str:
    """A folder with its scheme, as Spark names the files in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def _opened(uri: str):
    """(file system, path in it) of a folder or file, as Arrow knows them."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file://") else uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _listed(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Paths below the root and sizes of all files, empty ones too, in one pass over the folders."""
    from pyarrow import fs

    for _ in batches:
        system, top = _opened(root)
        found = [f for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File]
        named = [(f.path[len(top) :].lstrip("/"), f.size) for f in found]
        shown = [(p, n) for p, n in named if not any(x[:1] in "._" for x in p.split("/"))]
        for at in range(0, len(shown), 10_000):
            some = shown[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in some], pa.string()), "bytes": pa.array([n for _, n in some], pa.int64())})


def _digests(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, top = _opened(root)
            digest, left = hashlib.sha256(), row["length"]
            with system.open_input_file(f"{top}/{row['path']}") as file:
                file.seek(row["offset"])
                while left:
                    some = file.read(min(READ_BYTES, left))
                    if not some:
                        raise OSError(f"{row['path']} became shorter")
                    digest.update(some)
                    left -= len(some)
            out = {"path": [row["path"]], "bytes": [row["bytes"]], "piece": [row["piece"]], "digest": [digest.digest()]}
            yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("piece", pa.int64()), ("digest", pa.binary())]))


def files(spark: SparkSession, root: str, piece: int = PIECE_BYTES) -> DataFrame:
    """path (below root), bytes, sha256, pieces of all files of a folder and those below it.

    Names that begin with a dot or an underscore are left out, as Spark's readers do. The folder
    has to be one that Arrow can open on the executors (local or shared, HDFS, S3, GCS).
    """
    top = qualified(spark, root)
    listed = spark.range(1, numPartitions=1).mapInArrow(partial(_listed, root=top), "path string, bytes long")
    count = F.greatest(F.ceil(F.col("bytes") / piece), F.lit(1)).cast("long")
    each = listed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    each = each.withColumn("offset", F.col("piece") * piece).withColumn("length", F.least(F.lit(piece), F.col("bytes") - F.col("offset")))
    dealt = each.repartition("path", "piece")
    found = dealt.mapInArrow(partial(_digests, root=top), "path string, bytes long, piece long, digest binary")
    one = found.groupBy("path", "bytes").agg(F.sort_array(F.collect_list(F.struct("piece", "digest"))).alias("x"))
    digests = F.transform("x", lambda p: p["digest"])
    several = F.size("x") > 1
    whole = F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))
    return one.select(
        "path",
        "bytes",
        F.when(several, F.sha2(whole, 256)).otherwise(F.lower(F.hex(digests[0]))).alias("sha256"),
        F.when(several, F.transform(digests, lambda d: F.lower(F.hex(d)))).otherwise(F.array().cast("array<string>")).alias("pieces"),
    )


def artifact_manifest(
    spark: SparkSession,
    root: str,
    kind: str,
    command: list[str] = (),
    config: object = None,
    parents: list[str] = (),
    created_at: str | None = None,
    source_revision: str = "unknown",
    metadata: dict | None = None,
    artifact_id: str | None = None,
    piece: int = PIECE_BYTES,
) -> DataFrame:
    """One row: the manifest of a folder, all files in the order of their paths.

    The id is the kind and the first 16 digits of the sha256 of all else, as canonical JSON.
    """
    head = {
        "schema_version": SCHEMA_VERSION,
        "artifact_kind": kind,
        "created_at": created_at or datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z"),
        "source_revision": source_revision,
        "config_sha256": canonical.sha256_text(canonical.dumps(config)),
        "metadata": canonical.dumps(metadata or {}),
    }
    one = files(spark, root, piece).agg(F.sort_array(F.collect_list(F.struct("path", "bytes", "sha256", "pieces"))).alias("files"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    one = one.select(
        *(F.lit(v).alias(k) for k, v in head.items()), texts(command).alias("command"), texts(parents).alias("parents"), "files"
    )
    ident = F.concat(F.lit(f"{kind}-"), F.substring(canonical.canonical_sha256(F.struct(*one.columns)), 1, 16))
    return one.select((F.lit(artifact_id) if artifact_id else ident).alias("artifact_id"), "*")


def unsafe(path: Column) -> Column:
    """Whether a path could leave its folder: absolute, of another drive, or upwards."""
    return (path == "") | path.rlike(r"^([/\\]|[A-Za-z]:|[a-z0-9+.-]+://)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def verify_manifest(spark: SparkSession, manifest: DataFrame, root: str, known: list[str] = (), piece: int = PIECE_BYTES) -> DataFrame:
    """path, problem, pieces for every file and parent that isn't as the manifest says.

    Problems: missing, unlisted, changed (with the numbers of the changed pieces, where there are
    several), listed_twice, unsafe_path, unknown_parent.
    """
    listed = manifest.select(F.explode("files").alias("f")).select("f.*")
    odd = listed.where(unsafe(F.col("path"))).select("path", F.lit("unsafe_path").alias("problem"))
    twice = listed.groupBy("path").count().where("count > 1").select("path", F.lit("listed_twice").alias("problem"))
    want = listed.where(~unsafe(F.col("path"))).select("path", *(F.col(c).alias(f"want_{c}") for c in ("bytes", "sha256", "pieces")))
    joined = want.join(files(spark, root, piece), "path", "full")
    changed = (F.col("bytes") != F.col("want_bytes")) | (F.col("sha256") != F.col("want_sha256"))
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("want_bytes").isNull(), "unlisted").when(changed, "changed")
    most = F.greatest(F.size("pieces"), F.size("want_pieces"))
    differ = F.filter(
        F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: ~F.equal_null(F.get("pieces", i), F.get("want_pieces", i)),
    )
    none = F.array().cast("array<int>")
    bad = joined.select("path", problem.alias("problem"), F.when(problem == "changed", differ).otherwise(none).alias("pieces"))
    lost = manifest.select(F.explode("parents").alias("path")).where(~F.col("path").isin(*known)).select("path", F.lit("unknown_parent").alias("problem"))
    others = odd.unionByName(twice).unionByName(lost).withColumn("pieces", none)
    return bad.where("problem is not null").unionByName(others)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text (a report, a manifest) as one file; an existing one is an error."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = found.getFileSystem(spark._jsc.hadoopConfiguration()).create(found, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or null if there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_manifest(spark: SparkSession, manifest: DataFrame, path: str) -> str:
    """The manifest as indented JSON with sorted keys; returns its artifact's id."""
    row = manifest.first()
    text = json.dumps(row.asDict(recursive=True), indent=2, sort_keys=True)
    write_text(spark, path, text + "\n")
    return row.artifact_id


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = f"artifact_id string, schema_version string, artifact_kind string, created_at string, source_revision string, config_sha256 string, metadata string, command array<string>, parents array<string>, files array<{FILE}>"
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
