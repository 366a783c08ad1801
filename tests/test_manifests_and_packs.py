"""Manifests by path and piece, canonical JSON, execution packs and their gate."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import canonical
from weftline.operators import rows
from weftline.sources import manifests, packs


def problems(spark, manifest, root, **how):
    return {(r.path, r.problem, tuple(r.pieces)) for r in manifests.verify_manifest(spark, manifest, str(root), **how).collect()}


def test_nested_files_of_one_name(spark, tmp_path):
    for split in "ab":
        (tmp_path / f"split={split}").mkdir()
        (tmp_path / f"split={split}" / "part-0").write_bytes(split.encode() * 10)
    (tmp_path / "empty x").write_bytes(b"")
    made = manifests.artifact_manifest(spark, str(tmp_path), "dataset", ["build"], {"n": 1}, ["p1", "p2"], created_at="2026-01-01T00:00:00Z").cache()
    row = made.first()
    assert [(f.path, f.bytes, f.sha256, f.pieces) for f in row.files] == [
        (p, len(x), hashlib.sha256(x).hexdigest(), []) for p, x in (("empty x", b""), ("split=a/part-0", b"a" * 10), ("split=b/part-0", b"b" * 10))
    ]
    assert row.config_sha256 == hashlib.sha256(b'{"n":1}').hexdigest() and row.artifact_id.startswith("dataset-") and len(row.artifact_id) == 24
    assert problems(spark, made, tmp_path, known=["p1", "p2"]) == set()
    path = f"{tmp_path}-manifest/m.json"
    assert manifests.write_manifest(spark, made, path) == row.artifact_id
    again = manifests.read_manifest(spark, path)
    assert again.first() == row
    (tmp_path / "split=a" / "part-0").write_bytes(b"c" * 10)
    (tmp_path / "split=b" / "part-0").rename(tmp_path / "split=b" / "part-1")
    assert problems(spark, again, tmp_path, known=["p1"]) == {
        ("split=a/part-0", "changed", ()), ("split=b/part-0", "missing", ()), ("split=b/part-1", "unlisted", ()), ("p2", "unknown_parent", ()),
    }


def test_pieces(spark, tmp_path):
    data = bytes(range(256)) * 10
    (tmp_path / "f").write_bytes(data)
    made = manifests.artifact_manifest(spark, str(tmp_path), "model", piece=1000).cache()
    file = made.first().files[0]
    digests = [hashlib.sha256(data[i : i + 1000]) for i in (0, 1000, 2000)]
    assert file.pieces == [d.hexdigest() for d in digests]
    assert file.sha256 == hashlib.sha256(b"".join(d.digest() for d in digests)).hexdigest()
    (tmp_path / "f").write_bytes(data[:1500] + b"x" + data[1501:])
    assert problems(spark, made, tmp_path, piece=1000) == {("f", "changed", (1,))}
    (tmp_path / "f").write_bytes(data[:2000])
    assert problems(spark, made, tmp_path, piece=1000) == {("f", "changed", (2,))}


def test_a_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big", "wb") as f:
        f.truncate((2 << 30) + 5)  # sparse
    row = manifests.files(spark, str(tmp_path)).first()
    assert (row.path, row.bytes, len(row.pieces)) == ("big", (2 << 30) + 5, 9) and len(set(row.pieces)) == 2


def test_paths_that_leave_the_folder(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"a")
    one = f"named_struct('path', p, 'bytes', 1L, 'sha256', 's', 'pieces', array())"
    paths = ["../a", "/etc/a", "x/../../a", "C:\\a", "file:///a", "", "a", "a"]
    made = spark.createDataFrame([(p,) for p in paths], "p string").agg(F.collect_list(F.expr(one)).alias("files")).withColumn("parents", F.array().cast("array<string>"))
    got = problems(spark, made, tmp_path)
    assert {p for p, why, _ in got if why == "unsafe_path"} == set(paths) - {"a"} and ("a", "listed_twice", ()) in got


def test_canonical_json(spark):
    value = {"b": None, "a": {"z": 1.5, "ä": [1, None], "e": "ß\n\"\u2028"}, "m": {"k2": 1, "k1": 2}}
    df = spark.createDataFrame([(None, (1.5, [1, None], "ß\n\"\u2028"), {"k2": 1, "k1": 2})], "b string, a struct<z: double, `ä`: array<long>, e: string>, m map<string,long>")
    text = df.select(canonical.canonical_json(F.struct("b", "a", "m")), canonical.canonical_sha256(F.struct("b", "a", "m"))).first()
    want = json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert text[0] == want and text[1] == hashlib.sha256(want.encode()).hexdigest()
    assert spark.range(2).select(canonical.canonical_json("id")).collect()[1][0] == "1"
    for bad in ("double('nan')", "date'2026-01-01'", "1.5bd"):
        with pytest.raises(Exception, match="JSON"):
            spark.range(1).select(canonical.canonical_json(F.expr(bad))).collect()


def test_ids(spark):
    edit = spark.createDataFrame([("s", "r", "c", "p.py", ("x", None))], "source string, repo string, commit string, path string, dedup struct<b: string, a: string>")
    body = {"source": "s", "repo": "r", "commit": "c", "path": "p.py", "dedup": {"a": None, "b": "x"}}
    want = "transition-" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
    assert edit.select(rows.transition_id(edit)).first()[0] == want
    one = spark.createDataFrame([("d", "p/1", "s1", "3")], "dataset string, problem_id string, submission_id string, input_id string")
    assert rows.execution_records(one).first().record_id == "p/1::s1::3"


RECORD = "source_dataset string, source_problem_id string, source_submission_id string, input_id string, license string, license_attribution_url string, output_type string, output_kind string, execution_status string, held_out_for_eval boolean"


def test_packs_and_their_gate(spark, tmp_path):
    data = [(f"d{i % 2}", f"p{i // 3}", f"s{i}", "0", "mit", f"u{i % 2}", "int", "value", "ok" if i % 5 else "raised", i % 10 == 0 or None) for i in range(60)]
    records = spark.createDataFrame(data, RECORD)
    rejects = spark.createDataFrame([("timeout", 2), ("timeout", 1)], "reason string, n long")
    root = f"{tmp_path}/pack"
    manifest = packs.write_execution_pack(records, root, "pack-1", rejects, [{"path": "in.jsonl"}])
    kept = [r for r in data if not r[9]]
    assert manifest["record_count"] == len(kept) == 54 and manifest["held_out_eval_excluded_count"] == 6
    assert manifest["source_breakdown"] == {s: sum(r[0] == s for r in kept) for s in ("d0", "d1")} and manifest["sandbox_reject_counts"] == {"timeout": 3, "held_out_for_eval": 6}
    assert sum(manifest["split_counts"].values()) == 54 and set(manifest["split_counts"]) == {"train", "val", "test"}
    written = spark.read.json(f"{root}/pack")
    assert written.groupBy("source_problem_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert written.where("record_id = 'p3::s9::0'").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        packs.write_execution_pack(records, root, "pack-1")

    def failed():
        for crc in (tmp_path / "pack").rglob(".*.crc"):  # files are changed by hand here
            crc.unlink()
        return {r.check for r in packs.publish_gate(spark, root).collect() if not r.ok}

    assert failed() == set() and [r.check for r in packs.publish_gate(spark, root).orderBy("position").collect()] == list(packs.CHECKS)
    whole = manifests.read_manifest(spark, f"{root}/artifact_manifest.json")
    assert {r[1] for r in problems(spark, whole, root)} == {"unlisted"}  # the manifest itself
    body = json.loads((tmp_path / "pack" / "manifest.json").read_text())

    def rewritten(**changes):
        (tmp_path / "pack" / "manifest.json").write_text(json.dumps(body | changes))
        return failed()

    assert rewritten(schema_version="x") == {"manifest_schema_version_supported"} and rewritten(record_count=0) == {"record_count_nonzero"}
    assert rewritten(license_breakdown={"mit": 1, "gpl-3.0": 2}) == {"all_licenses_permissive"} and rewritten(claim_boundary={}) == {"claim_boundary_fingerprint_matches"}
    assert rewritten(source_breakdown={"d0": 1, "d9": 1}) == {"every_source_has_attribution"} and rewritten() == set()
    (tmp_path / "pack" / "claim_boundary.md").write_text("other")
    assert failed() == {"claim_boundary_embedded"}
    part = next((tmp_path / "pack" / "pack").glob("part-*"))
    part.write_text(part.read_text() + "{}\n")
    assert failed() == {"claim_boundary_embedded", "pack_jsonl_checksum_matches"}
    for name in ("attribution.json", "sandbox_audit_summary.json"):
        (tmp_path / "pack" / name).unlink()
    assert {"attribution_json_present", "sandbox_audit_summary_present"} <= failed()
    (tmp_path / "pack" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        packs.publish_gate(spark, root)


def test_an_empty_pack(spark, tmp_path):
    manifest = packs.write_execution_pack(spark.createDataFrame([], RECORD), f"{tmp_path}/e", "none")
    assert manifest["record_count"] == 0 and manifest["split_counts"] == {}
    assert [r.check for r in packs.publish_gate(spark, f"{tmp_path}/e").collect() if not r.ok] == ["record_count_nonzero"]
    with pytest.raises(ValueError, match="shares"):
        packs.write_execution_pack(spark.createDataFrame([], RECORD), f"{tmp_path}/f", "none", train=0.9, val=0.1)
