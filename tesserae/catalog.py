"""Every query of the engine by name, with the SQL that states its result independently."""

from __future__ import annotations

from tesserae.plans import content, files, history  # noqa: F401  they register themselves
from tesserae.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
