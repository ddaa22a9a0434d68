"""Corpus preparation in five stages; they are in feedloom.llm.pipeline."""

from feedloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
