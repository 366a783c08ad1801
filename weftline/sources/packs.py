"""Execution packs with what goes beside them, and the gate that they pass before publishing.

A pack is a folder: ``pack`` (JSON lines), ``manifest.json`` (counts of what is in it),
``attribution.json``, ``sandbox_audit_summary.json``, ``claim_boundary.md`` and
``artifact_manifest.json`` (hashes of the files). Records come with their outputs; nothing is run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import text as T
from ..operators.pools import problem_splits
from . import manifests

# The columns that a manifest counts by, and the gate's checks in order.
COUNTED = {
    "split_counts": "split",
    "output_type_distribution": "output_type",
    "output_kind_distribution": "output_kind",
    "execution_status_distribution": "execution_status",
    "source_breakdown": "source_dataset",
    "license_breakdown": "license",
}
HELD_OUT = "held_out_for_eval"
CHECKS = (
    "manifest_schema_version_supported", "pack_jsonl_present", "attribution_json_present", "sandbox_audit_summary_present",
    "claim_boundary_embedded", "pack_jsonl_checksum_matches", "claim_boundary_fingerprint_matches", "all_licenses_permissive",
    "every_source_has_attribution", "record_count_nonzero",
)
SCHEMA_VERSION = "weftline.execution_pack.v1"
CLAIM_BOUNDARY = (
    "# What this pack supports\n\nIt holds code, inputs and recorded outputs of public submissions. It is research evidence: it\n"
    "supports no claim about programs, inputs or models outside of it.\n"
)


def without_held_out(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that may enter a pack, one row with held_out_eval_excluded_count)."""
    held = F.coalesce(F.col(HELD_OUT), F.lit(False))
    return records.where(~held), records.agg(F.count_if(held).alias("held_out_eval_excluded_count"))


def record_id() -> F.Column:
    """The id of an execution record: problem, submission and input."""
    return F.concat_ws("::", "source_problem_id", "source_submission_id", "input_id")


def pack_counts(packed: DataFrame) -> DataFrame:
    """One row: record_count, and a sorted map of counts for each column of COUNTED; one scan."""
    cols = list(COUNTED.values())
    sets = packed.groupingSets([[F.col(c)] for c in cols] + [[]], *cols).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")
    )
    maps = []
    for i, (name, c) in enumerate(COUNTED.items()):
        level = (1 << len(cols)) - 1 - (1 << len(cols) - 1 - i)
        entry = F.struct(F.coalesce(F.col(c), F.lit("missing")), "n")
        maps.append(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("g") == level, entry)))).alias(name))
    total = F.coalesce(F.max(F.when(F.col("g") == (1 << len(cols)) - 1, F.col("n"))), F.lit(0))
    return sets.agg(total.alias("record_count"), *maps)


def write_execution_pack(
    records: DataFrame,
    root: str,
    pack_id: str,
    rejects: DataFrame | None = None,
    parents: list[dict] = (),
    train: float = 0.85,
    val: float = 0.05,
    seed: int = 42,
    created_at: str | None = None,
) -> dict:
    """Write a pack of all records that aren't held out, split by problem; returns its manifest.

    records: source_dataset, source_problem_id, source_submission_id, input_id, license,
    license_attribution_url, output_type, output_kind, execution_status, held_out_for_eval, and
    whatever else they carry. rejects: reason, n of what was left out before. A folder that
    exists is an error, as are shares that leave nothing to test; an empty pack is written too.
    """
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("train and val are shares, and leave one for test")
    spark = records.sparkSession
    kept, held = without_held_out(records)
    splits = problem_splits(kept.select("source_problem_id"), "source_problem_id", train, val, str(seed))
    packed = kept.drop(HELD_OUT).join(splits, "source_problem_id").withColumn("record_id", record_id())
    packed = packed.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    columns = sorted(packed.columns)
    packed.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(f"{root}/pack")
    written = spark.read.schema(packed.select(*columns).schema).json(f"{root}/pack")
    counts = pack_counts(written).first().asDict()
    urls = written.groupBy("source_dataset").agg(F.min("license_attribution_url").alias("url")).where("url is not null")
    attribution = {r.source_dataset: r.url for r in urls.collect()}  # a row for each source
    audit = {r.reason: r.n for r in rejects.groupBy("reason").agg(F.sum("n").alias("n")).collect()} if rejects is not None else {}
    excluded = held.first()[0]
    if excluded:
        audit[HELD_OUT] = audit.get(HELD_OUT, 0) + excluded
    manifest = counts | {
        "schema_version": SCHEMA_VERSION, "pack_id": pack_id, "split_by": "source_problem_id", "seed": seed, "train_frac": train, "val_frac": val,
        "sandbox_reject_counts": audit, "held_out_eval_excluded_count": excluded, "parent_artifacts": list(parents),
        "claim_boundary": {"fingerprint": canonical.sha256_text(CLAIM_BOUNDARY)}, "pack_checksum": pack_checksum(spark, root),
    }
    for name, text in (
        ("manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n"),
        ("attribution.json", json.dumps(attribution, indent=2, sort_keys=True) + "\n"),
        ("sandbox_audit_summary.json", json.dumps(audit, indent=2, sort_keys=True) + "\n"),
        ("claim_boundary.md", CLAIM_BOUNDARY),
    ):
        manifests.write_text(spark, f"{root}/{name}", text)
    whole = manifests.artifact_manifest(
        spark, root, "dataset", ["execution-pack"], {"seed": seed}, created_at=created_at, artifact_id=pack_id,
        metadata={"record_count": manifest["record_count"], "schema": SCHEMA_VERSION},
    )
    manifests.write_manifest(spark, whole, f"{root}/artifact_manifest.json")
    return manifest


def pack_checksum(spark: SparkSession, root: str) -> str:
    """One digest of the pack's files, whatever order they are listed in."""
    one = manifests.files(spark, f"{root}/pack").agg(F.sort_array(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("x"))
    return one.select(canonical.canonical_sha256(F.col("x"))).first()[0]


def publish_gate(spark: SparkSession, root: str, licenses: tuple[str, ...] = T.PERMISSIVE_LICENSES) -> DataFrame:
    """check, ok, finding: the ten checks of a pack's folder, in order; a lost manifest is an error.

    All texts that are read here are small; the pack itself is hashed by the executors.
    """
    text = manifests.read_text(spark, f"{root}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"no manifest in {root}")
    manifest = json.loads(text)
    attribution, audit, boundary = (manifests.read_text(spark, f"{root}/{x}") for x in ("attribution.json", "sandbox_audit_summary.json", "claim_boundary.md"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pack")
    present = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    checksum = pack_checksum(spark, root) if present else None
    other = sorted(set(manifest.get("license_breakdown") or {}) - set(licenses))
    lacking = sorted(set(manifest.get("source_breakdown") or {}) - set(json.loads(attribution or "{}")))
    fingerprint = (manifest.get("claim_boundary") or {}).get("fingerprint")
    results = (
        (manifest.get("schema_version") == SCHEMA_VERSION, f"schema version {manifest.get('schema_version')}"),
        (present, "no pack"),
        (attribution is not None, "no attribution.json"),
        (audit is not None, "no sandbox_audit_summary.json"),
        (boundary == CLAIM_BOUNDARY, "claim_boundary.md is missing" if boundary is None else "claim_boundary.md has another text"),
        (present and checksum == manifest.get("pack_checksum"), f"checksum of the pack is {checksum}"),
        (fingerprint == canonical.sha256_text(CLAIM_BOUNDARY), "fingerprint of another boundary"),
        (not other, f"licenses: {', '.join(other)}"),
        (not lacking, f"sources without attribution: {', '.join(lacking)}"),
        (int(manifest.get("record_count", 0)) > 0, "no records"),
    )
    rows = [(i, name, ok, None if ok else finding) for i, (name, (ok, finding)) in enumerate(zip(CHECKS, results, strict=True))]
    return spark.createDataFrame(rows, "position int, check string, ok boolean, finding string")
