"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from airq.plans import (geometry, layers, model_checks, modelling, nested, observations, products,  # noqa: F401
                        readside, spatial, tables)
from airq.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
