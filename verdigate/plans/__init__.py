"""Registered queries.  Each module registers its own on import."""

from importlib import import_module

MODULES = (
    "coverage", "provenance", "tasks", "structure", "inference", "ranks", "timeseries",
    "markets", "calibration", "texts", "learning", "studies", "pipelines", "scans",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
