"""All registered queries; importing a family registers it."""

from maskquery.plans import files, graphs, instances, polygons, rasters, roundtrips, scoring, tables, tiling  # noqa: F401
from maskquery.plans.registry import ORACLES, QUERIES  # noqa: F401
