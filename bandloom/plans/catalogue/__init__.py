"""All registered queries, by theme."""

from bandloom.plans.catalogue import fitting, learning, models, naming, places, preparing, scores, splitting  # noqa: F401
from bandloom.plans.registry import ORACLES, QUERIES  # noqa: F401
