"""The corpus pipeline, whose stages are in tapal.llm.pipeline."""

from tapal.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
