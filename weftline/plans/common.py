"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to as many parts as a shuffle has.

    A small file is one part, whose rows a slow function would take one after the other; the
    number is given, since parts of few bytes would else be put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Bytes of lineitem's files for each part that it is dealt to.
LINE_BYTES = 16 << 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem dealt by order, to more parts the larger its files are, so no task's part grows with it."""
    li = read(spark, sf_dir, "lineitem")
    parts = int(li._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // LINE_BYTES
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return li.repartition("l_orderkey")
    return li.repartition(min(parts, 1 << 20), "l_orderkey")


#: A licence that a document names, as its notices spell it.
LICENSE_LINE = (
    ("Apache License, Version 2.0", "Apache License_2.0"),
    ("MIT License", "MIT  License"),
    ("GNU General Public License, version 3", "GPL-3.0"),
    ("CC BY-NC 4.0", "CC-BY-NC-4.0")
)


def named_license(text):
    found = None
    for line, name in LICENSE_LINE:
        found = F.when(
            F.contains(text, F.lit(line)), name
        ) if found is None else found.when(F.contains(text, F.lit(line)), name)
    return found


#: The same in SQL: each document's normal licence (or null), and the decision on it.
LICENSED_SQL = """
  lic AS (SELECT *, CASE WHEN contains(text, 'Apache License, Version 2.0') THEN 'apache-2.0'
      WHEN contains(text, 'MIT License') THEN 'mit'
      WHEN contains(text, 'GNU General Public License, version 3') THEN 'gpl-3.0'
      WHEN contains(text, 'CC BY-NC 4.0') THEN 'cc-by-nc-4.0' END AS license FROM documents),
  dec AS (SELECT *, coalesce(license IN ('apache-2.0', 'mit'), false) AS allowed,
      CASE WHEN license IS NULL THEN 'missing_license' WHEN license IN ('apache-2.0', 'mit') THEN 'allowed'
      ELSE 'license_not_allowed' END AS reason FROM lic)"""

#: The unit interval of a key: 13 hex digits of sha256, exact in a double.
UNIT_SQL = "(('0x' || substr(sha256('0:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def split_sql(key: str) -> str:
    u = UNIT_SQL.format(key=key)
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'val' ELSE 'test' END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: id, source, licence decision, split by source and id, text keys."""
    docs = read(spark, sf_dir, "documents")
    key = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        "source",
        "lang",
        "text",
        "n_chars",
        T.license_decision(named_license(F.col("text"))).alias("decision"),
        T.split_name(key).alias("split"),
        T.parts_hash(F.col("text")).alias("pair"),
        T.parts_hash(F.col("text"), F.col("lang")).alias("transition")
    )
