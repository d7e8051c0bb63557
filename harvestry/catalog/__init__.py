"""The registered queries: every operator run over the given tables, with its SQL where there is one."""

from harvestry.catalog.registry import ORACLE, QUERIES

from harvestry.catalog import (  # noqa: F401,E402  (each module registers its queries)
    search, work, history, children, quality, listing, resources, resolve, extract, scalars, streams,
)

__all__ = ["ORACLE", "QUERIES"]
