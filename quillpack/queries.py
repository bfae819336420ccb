"""Queries of the package proper and the SQL that checks them."""

from .plans import details, images, numerics, samples, shapes, storage  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
