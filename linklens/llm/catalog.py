"""Imports every operator, which registers its query, and hands out the registry."""

from linklens.llm import (  # noqa: F401
    op01_secrets,
    op02_warc,
    op03_quality,
    op04_bpe,
    op05_tool_calls,
    op06_minhash,
    op07_decontaminate,
    op08_line_dedup,
    op09_url_filter,
    op10_language_id,
    op11_whitening,
    op12_sharding,
    op13_merkle,
)
from linklens.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
