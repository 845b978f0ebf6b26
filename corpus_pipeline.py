"""The corpus pipeline of the llm subpackage; see corpusloom/llm/pipeline.py."""

from corpusloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
