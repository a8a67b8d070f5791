"""All registered queries; importing the modules fills the registry."""

from . import feed_queries, job_queries, scalar_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
