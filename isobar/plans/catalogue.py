"""Every registered query, by name."""

from isobar.plans import foundation, inference, learning, quality, rollups, shapes, storage  # noqa: F401
from isobar.plans.registry import QUERIES

__all__ = ["QUERIES"]
