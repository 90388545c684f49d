"""Named queries over the star schema, one per operator, with their check SQL."""

from importlib import import_module

MODULES = (
    "feature_queries",
    "relational_queries",
    "source_queries",
    "planning_queries",
    "network_queries",
    "forecast_queries",
)


def load() -> None:
    """Import every query module so that it registers its queries."""
    for name in MODULES:
        import_module(f"restock.catalog.{name}")
