"""The corpus pipeline, whose stages are in the training-data subpackage."""

from cohortspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
