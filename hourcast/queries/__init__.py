"""The registered queries, each next to the SQL that must give the same rows."""

from hourcast.queries import (  # noqa: F401
    compare,
    drift_model,
    features,
    landing,
    merge,
    profiles,
    scalars,
    stored,
    windows,
)
from hourcast.queries.registry import ORACLES, QUERIES  # noqa: F401
