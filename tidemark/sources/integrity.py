"""File checksums, manifest differences and personal-data scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
    )


def verify_manifest(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row per problem: missing, unlisted, invalid hash, checksum or size mismatch."""
    a = actual.select("name", F.col("sha256").alias("hash_now"), F.col("size_bytes").alias("size_now"))
    j = recorded.join(a, "name", "full_outer")
    problems = F.array_compact(F.array(
        F.when(F.col("hash_now").isNull(), F.lit("missing")),
        F.when(F.col("sha256").isNull() & F.col("hash_now").isNotNull(), F.lit("unlisted")),
        F.when(F.col("sha256").isNotNull() & ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
               F.lit("invalid_hash")),
        F.when(F.col("hash_now") != F.col("sha256"), F.lit("checksum_mismatch")),
        F.when(F.col("size_now") != F.col("size_bytes"), F.lit("size_mismatch")),
    ))
    return j.select("name", F.explode(problems).alias("problem"))


def set_difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Entries on one side only, tagged."""
    missing = expected.exceptAll(present).withColumn("side", F.lit("missing"))
    return missing.unionByName(present.exceptAll(expected).withColumn("side", F.lit("extra")))


# Address pattern and the domains reserved for examples.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EXAMPLE_DOMAINS = ("example.com", "example.net", "example.org")


def email_leaks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every address outside the reserved domains, over the whole text."""
    found = documents.filter(F.contains(text, F.lit("@"))).select(
        key, F.posexplode(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))
        .alias("match_pos", "address")
    )
    domain = F.lower(F.substring_index("address", "@", -1))
    return found.filter(~domain.isin(*EXAMPLE_DOMAINS))
