"""Cleaning a corpus of documents in five stages, each over all that the one before it kept.

The stages are in ``linklens.llm.pipeline``.
"""

from linklens.llm.common import materialise
from linklens.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, encode, line_dedup, near_dedup, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "encode", "line_dedup", "materialise", "near_dedup", "quality_rules", "run"]
