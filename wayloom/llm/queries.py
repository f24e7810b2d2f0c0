"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe
from .chat import OP6_SQL, op6_chat
from .decontaminate import op3_decontaminate
from .licenses import op7_licenses
from .lines import OP1_SQL, op1_line_dedup
from .neardup import OP2_SQL, op2_ngram_join
from .quality import op5_quality
from .rules import OP8_SQL, op8_rules
from .urls import op9_urls
from .warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontaminate": op3_decontaminate,
        "op4_warc": op4_warc,
        "op5_quality": op5_quality,
        "op6_chat": op6_chat,
        "op7_licenses": op7_licenses,
        "op8_rules": op8_rules,
        "op9_urls": op9_urls,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op4_warc": OP4_SQL, "op6_chat": OP6_SQL, "op8_rules": OP8_SQL}
