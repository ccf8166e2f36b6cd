"""The engine's queries; importing the package registers them."""

from odresil.plans import cities, curves, figures, flows, forecast, kernels, nearest, ranking, stats, storm, tables, transfer, zones  # noqa: F401
from odresil.plans.registry import ORACLES, QUERIES  # noqa: F401
