"""Queries over the derived timeline tables."""


def load():
    """The registry with every query module imported."""
    from cutlake.plans import catalogue
    from cutlake.plans.registry import REGISTRY

    catalogue.import_all()
    return REGISTRY
