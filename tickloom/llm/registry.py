"""The queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op5_byte_bpe
from .decontaminate import op2_decontamination
from .divergence import OP12_SQL, op12_source_divergence
from .filter_audit import OP13_SQL, op13_filter_interactions
from .group_join import OP11_SQL, op11_jaccard_components
from .html_text import op1_html_text
from .line_dedup import OP7_SQL, op7_line_dedup
from .near_dup import op10_near_duplicates
from .pii import op3_pii_surrogates
from .quality_rules import OP8_SQL, op8_quality_rules
from .repeats import OP6_SQL, op6_repeated_passages
from .token_files import op4_token_files
from .warc import OP9_SQL, op9_warc_merkle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_decontamination": op2_decontamination,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_token_files": op4_token_files,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc_merkle": op9_warc_merkle,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_jaccard_components": op11_jaccard_components,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interactions": op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_repeated_passages": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_warc_merkle": OP9_SQL,
        "op11_jaccard_components": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_interactions": OP13_SQL,
    }
