"""A training-corpus pipeline: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

from docflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
