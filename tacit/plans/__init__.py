from tacit.plans.fit import (
    FitOptions,
    als_items,
    als_users,
    fit,
    fit_uniform,
    fit_with_telemetry,
    sweep_items,
    sweep_users,
)
from tacit.plans.prepare import Prepared, prepare

__all__ = [
    "FitOptions",
    "Prepared",
    "als_items",
    "als_users",
    "fit",
    "fit_uniform",
    "fit_with_telemetry",
    "prepare",
    "sweep_items",
    "sweep_users",
]
