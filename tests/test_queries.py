"""Every registered query of the library's own operators against its SQL, and unit cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import catalogue
from weftline.functions import text as T
from weftline.operators import curation

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) & set(catalogue.ORACLES)))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    want = oracle.sql(catalogue.ORACLES[name])
    assert cols == sorted(want.columns)
    rows = [dict(zip(want.columns, x)) for x in want.fetchall()]
    assert got == sorted(tuple(shown(r[c]) for c in cols) for r in rows)


def test_license_names(spark):
    cases = [
        ("  MIT  License ", "mit"),
        ("Apache_License-2.0", "apache-2.0"),
        ("N/A", None),
        (None, None),
        ("GPL-3.0", "gpl-3.0"),
        ("The Unlicense", "unlicense")
    ]
    df = spark.createDataFrame(cases, "a string, b string").select("b", T.normal_license(F.col("a")).alias("n"))
    assert all(r.b == r.n for r in df.collect())


def test_license_gate_raises(spark):
    df = spark.createDataFrame([("mit",), ("gpl-3.0",)], "l string").withColumn("decision", T.license_decision(F.col("l")))
    curation.enforce_license_gate(df.where("decision.allowed"))
    with pytest.raises(ValueError, match="license_not_allowed"):
        curation.enforce_license_gate(df)


def test_split_dedup_cases(spark):
    rows = [
        (0, "train", "t1", "p1"),
        (1, "train", "t1", "p1"),
        (2, "train", "t2", "p1"),
        (3, "val", "t9", "p1"),
        (4, "test", "t5", "p5"),
        (5, "test", "t5", "p5")
    ]
    out = curation.split_dedup(spark.createDataFrame(rows, "id int, split string, t string, p string"), "t", "p", "id")
    got = {r.id: (r.drop_reason, r.match_type, r.matched_id) for r in out.collect()}
    assert got[0] == (None, None, None) and got[1] == ("exact_duplicate", "exact_transition", 0) and got[2] == (
        "exact_duplicate", "exact_before_after", 0
    )
    assert got[3] == (
        "train_leakage", "exact_before_after", 2
    ) and got[4][0] is None and got[5] == ("exact_duplicate", "exact_transition", 4)


def test_split_dedup_near_leakage(spark):
    key = -0x123456789ABCDEF
    rows = [
        (0, "train", "p0", key),
        (1, "train", "p1", key ^ 1),
        (2, "val", "p2", key ^ 7),
        (3, "test", "p3", key ^ 15),
        (4, "val", "p1", key),
        (5, "train", "p5", key),
        (6, "test", "p6", (key ^ 6) ^ (1 << 40)),
        (7, "test", "p6", ~key),
        (8, "val", "p6", ~key)
    ]
    df = spark.createDataFrame(rows, "id int, split string, p string, state long").withColumn("t", F.col("p"))
    got = {
        r.id: (r.drop_reason, r.match_type, r.matched_id) for r in curation.split_dedup(df, "t", "p", "id", "state").collect()
    }
    near = lambda i: ("train_leakage", "near_state", i)
    none = (None, None, None)
    assert got == {
        0: none,
        1: none,
        2: near(0),
        3: near(1),
        4: ("train_leakage", "exact_before_after", 1),
        5: none,
        6: near(0),
        7: none,
        8: ("exact_duplicate", "exact_transition", 7)
    }


def test_split_dedup_near_query_equals_brute_force(spark):
    from weftline.functions import pyast

    got = {r.doc_id: r for r in catalogue.QUERIES["split_dedup_near"](spark, FOLDER).collect()}
    exact = {r.doc_id: r for r in catalogue.QUERIES["split_dedup"](spark, FOLDER).collect()}
    state = {
        r.doc_id: r.s & (2**64 - 1) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(
            "doc_id", pyast.simhash("text").alias("s")
        ).collect()
    }
    for i, r in exact.items():
        if r.split != "train" and r.drop_reason != "train_leakage":
            near = [j for j in sorted(exact) if exact[j].split == "train" and (state[i] ^ state[j]).bit_count() <= 3]
            assert (
                got[i].match_type, got[i].matched_id
            ) == ("near_state", near[0]) if near else got[i].match_type != "near_state"
    assert any(r.match_type == "near_state" for r in got.values())


def test_near_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    keys = [rng.getrandbits(40) for _ in range(40)]
    keys += [k ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for k in keys[:25]]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    got = {(r.left_id, r.right_id, r.distance) for r in curation.near_pairs(df, "id", "k", 3).collect()}
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    ids = sorted(first.values())
    assert got == {
        (a, b, (keys[a] ^ keys[b]).bit_count()) for a in ids for b in ids if a < b and (keys[a] ^ keys[b]).bit_count() <= 3
    }


def test_members_of_equal_keys(spark):
    df = spark.createDataFrame([(3, 7), (1, 7), (5, 7), (2, 9), (4, None), (6, None)], "id long, k long")
    assert {
        (r.id, r.representative) for r in curation.key_members(df, "id", "k").collect()
    } == {(3, 1), (1, 1), (5, 1), (2, 2), (4, 4), (6, 6)}


def test_every_document_has_a_representative(spark):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    members = {r.doc_id: r.representative for r in catalogue.QUERIES["near_dup_members_md5"](spark, FOLDER).collect()}
    pairs = {i for r in catalogue.QUERIES["near_dup_pairs_md5"](spark, FOLDER).collect() for i in (r.left_id, r.right_id)}
    assert set(members) == ids and all(members[i] == i for i in pairs) and any(i != r for i, r in members.items())


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<long>")
    assert df.select(T.checked_width(F.col("ids"), 5)).first()[0] == [1, 2, 3, 0, 0]
    with pytest.raises(Exception, match="longer"):
        df.select(T.checked_width(F.col("ids"), 2)).collect()
