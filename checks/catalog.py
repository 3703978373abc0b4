"""All registered queries."""

from __future__ import annotations

import checks.steps  # noqa: F401  (defines the SQL steps first)
import checks.log_checks  # noqa: F401
import checks.fold_checks  # noqa: F401
import checks.candidate_checks  # noqa: F401
import checks.training_checks  # noqa: F401
import checks.evaluation_checks  # noqa: F401
import checks.quality_checks  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
