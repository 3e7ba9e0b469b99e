"""Query plans over the test tables, grouped by family."""
from importlib import import_module

FAMILIES = ["layout", "catalog", "jobs", "objects", "scoring", "masks", "streaming", "sources"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"adlattice.plans.{family}")
