"""Local regression and regime discovery over spatial tables, on Spark."""

from .api import discover_regimes, fit_local, fit_regimes
from .config import Local, Refinement, Regimes

__all__ = ["Local", "Refinement", "Regimes", "discover_regimes", "fit_local", "fit_regimes"]
