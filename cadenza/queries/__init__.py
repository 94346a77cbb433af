"""Every operator on the driver's tables, and the ride reports on a made-up race."""

from cadenza.queries import aggregates, circuits, composites, joins, long_series, reports, rides, series, sql_functions, stored, streams, texts  # noqa: F401
from cadenza.queries.registry import ORACLES, QUERIES  # noqa: F401
