"""The modules that register queries."""

from importlib import import_module

MODULES = ("joining", "statistics", "timing", "editing", "ingest", "sound", "picture", "live")


def import_all() -> None:
    for name in MODULES:
        import_module(f"cutlake.plans.{name}")
