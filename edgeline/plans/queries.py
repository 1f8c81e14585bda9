"""All registered queries."""

from edgeline.plans import (  # noqa: F401
    borders, edge_rates, files, footprints, images, inference, predicates, transects)
from edgeline.plans.registry import QUERIES, oracle_texts, runnable  # noqa: F401
