"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op3_fingerprints
from .license_scans import op9_license_scans
from .license_sql import op9_sql
from .piece_encoding import op6_piece_encoding
from .quality_classifier import op8_quality_classifier
from .quality_rules import op10_quality_rules
from .secret_scans import op5_secret_scans
from .secret_sql import op5_sql
from .sharding import op1_sharding
from .simhash_dedup import op4_simhash_dedup
from .toxicity import op2_toxicity
from .source_mixing import op7_source_mixing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_toxicity, op3_fingerprints, op4_simhash_dedup, op5_secret_scans, op6_piece_encoding, op7_source_mixing, op8_quality_classifier, op9_license_scans, op10_quality_rules]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scans": op5_sql(), "op9_license_scans": op9_sql()}
