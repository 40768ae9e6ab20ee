"""Named queries; importing this package registers them."""

from . import imports, listings, live, maintenance, numeric, photos, relations, scans, sequences, upkeep  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
