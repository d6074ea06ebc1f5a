"""All named queries; importing the modules registers them."""

from detlake.plans import curation, evaluation, files, operations  # noqa: F401
from detlake.plans.registry import ORACLES, QUERIES  # noqa: F401
