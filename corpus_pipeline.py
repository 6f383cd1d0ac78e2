"""The corpus pipeline: its stages, what runs them over documents, and its SQL."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
