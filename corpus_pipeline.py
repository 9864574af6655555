"""The corpus pipeline of faultline.llm.pipeline, at the place where the driver looks for it."""

from faultline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
