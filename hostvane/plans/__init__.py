"""Registered queries over the driver tables, and their check SQL."""

from hostvane.plans import dataset, detection, metadata, models, stored, streams  # noqa: F401
from hostvane.plans.registry import CHECKS, QUERIES  # noqa: F401
