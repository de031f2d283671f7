"""Vector tiles on Spark: features in, map tiles out, for one tile or a whole pyramid in a single job."""

import importlib

#: Loaded when first asked for, so that executors load only what a task needs.
_HOMES = {"Options": "tilespark.options", "Source": "tilespark.options", "Behaviour": "tilespark.options", "TileEngine": "tilespark.plans.engine"}
__all__ = list(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(importlib.import_module(_HOMES[name]), name)
    raise AttributeError(name)
