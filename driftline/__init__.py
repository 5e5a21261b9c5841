"""Leakage-safe, time-ordered calibration of sensor fleets on Spark."""

from driftline.plans.experiment import RunResult, run_calibration, run_export
from driftline.spec import GAS_EXPORT, CalibrationSpec, Layout, LeakageError, RunConfig

__all__ = [
    "GAS_EXPORT", "CalibrationSpec", "Layout", "LeakageError", "RunConfig", "RunResult", "run_calibration", "run_export",
]
