"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

import secrets

from . import oracle
from .clustering import clustering
from .common import shared_dir, table
from .decontamination import decontamination
from .language_id import language_id
from .mixing import mix
from .near_duplicates import near_duplicates
from .neighbours import nearest
from .packing import packed
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .surrogates import surrogates
from .token_counts import token_counts
from .token_files import token_files
from .whitening import whitening


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


def _surrogate_key(spark) -> str:
    """What the session names; else a random key that is made once for the shared folder and kept there, so that reruns agree."""
    if named := spark.conf.get("spark.lumenfold.surrogates.key", None):
        return named
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lumenfold/surrogates.key")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        made = files.create(path, False)
        made.writeBytes(secrets.token_hex(32))
        made.close()
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def op8_surrogates(spark, sf_dir):
    return surrogates(table(spark, sf_dir, "documents"), _surrogate_key(spark))


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening(table(spark, sf_dir, "embeddings"))


def op13_clustering(spark, sf_dir):
    return clustering(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_token_files, op4_nearest_neighbours, op5_language_id, op6_decontamination, op7_suffix_dedup, op8_surrogates, op9_mixing, op10_near_duplicates, op11_packing, op12_whitening, op13_clustering)}

ORACLE_SQL = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op6_decontamination": oracle.DECONTAMINATION,
    "op10_near_duplicates": oracle.NEAR_DUPLICATES,
}
