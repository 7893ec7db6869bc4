"""Queries over the shared tables, each with the SQL that must give the same rows."""

from docquarry.gallery.registry import QUERIES, SQL  # noqa: F401
from docquarry.gallery import (  # noqa: F401
    conversions,
    lookups,
    predicates,
    quantities,
    rollups,
    sources,
    streams,
    structure,
    validations,
)
