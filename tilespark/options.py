"""Options of a source, of a request, and their defaults: the first that is set counts, and 0 is set."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    extent: int | None = None
    buffer: int | None = None
    tolerance: float | None = None
    max_zoom: int | None = None
    min_zoom: int | None = None

    def over(self, other: Options) -> Options:
        """These, and the other's where these aren't set."""
        return Options(**{f.name: getattr(other, f.name) if getattr(self, f.name) is None else getattr(self, f.name) for f in fields(Options)})


#: What holds where neither source nor request says otherwise.
DEFAULTS = Options(extent=4096, buffer=64, tolerance=3, max_zoom=24, min_zoom=0)


def resolve(source: Options | None, request: Options | None = None) -> Options:
    return (source or Options()).over(request or Options()).over(DEFAULTS)


def resolved(sources: DataFrame, request: Options | None = None) -> DataFrame:
    """The same for a table of sources, with a column for each option (in the order of the fields) in place of those
    that it has; null is not set."""
    kinds = {"tolerance": "double"}
    fall = (request or Options()).over(DEFAULTS)
    own = [F.coalesce(*([F.col(f.name)] if f.name in sources.columns else []), F.lit(getattr(fall, f.name))).cast(kinds.get(f.name, "int")).alias(f.name) for f in fields(Options)]
    return sources.select(*[c for c in sources.columns if c not in {f.name for f in fields(Options)}], *own)


@dataclass(frozen=True)
class Source:
    """A layer: its name, and a DataFrame of features or the path of a file. Names are unique in a tile."""

    name: str
    data: Any
    options: Options | None = None
    #: Property columns, in order; None takes all columns that aren't of the feature schema.
    columns: tuple[str, ...] | None = field(default=None)
    #: A column that gives features their id in the tile.
    id_col: str | None = None
    #: Options of the reader of a file: connector, headers, retries and others (see sources.ranges.reader_for).
    reading: dict[str, Any] | None = None
    #: Whether features are dealt to all tasks before tiles are made: needed where a source has few files or
    #: few tasks, a shuffle to spare where it has many.
    deal: bool = True


@dataclass(frozen=True)
class Behaviour:
    """Choices where the established output differs from the tile specification or from intuition.

    winding: `reference` turns exterior rings so that the sum over (xi - xj)(yi + yj) is positive, `mvt21` the
    other way, as the tile specification asks. candidates: `tile` takes features whose box meets the tile,
    `buffered` those whose box meets the tile with its buffer, `fgb_layout` those of `tile` and all whose bytes lie
    between theirs in the file, or within 512 bytes, as a reader of byte ranges passes them on: sources need the
    columns byte_at and byte_end. drop_flat_parts: parts of multi-part
    features whose box has less area than the tolerance's square vanish, straight ones too. strict_index:
    files without an index give no features. ties: of several vertices as far from a segment, simplification splits it
    at the one that a `scan` ends at, or at the one `nearest` to the middle (kernels.importance).
    """

    winding: str = "reference"
    candidates: str = "tile"
    drop_flat_parts: bool = True
    strict_index: bool = False
    ties: str = "scan"

    def __post_init__(self) -> None:
        if self.winding not in ("reference", "mvt21") or self.candidates not in ("tile", "buffered", "fgb_layout"):
            raise ValueError("winding is reference or mvt21, candidates is tile, buffered or fgb_layout")
        if self.ties not in ("scan", "nearest"):
            raise ValueError("ties are scan or nearest")
