"""Options: region names, explicit bounds, files, and what they resolve to."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from tidemark.sources.areas import PRESETS, SEA_AREAS

AUTO = "auto"
REGION_FIELDS = ("min_lon", "max_lon", "min_lat", "max_lat", "proj_lon0", "proj_lat0")
#: Words too common among sea names to suggest a name by.
GENERIC_WORDS = frozenset(["sea", "ocean", "gulf", "bay", "strait", "channel", "the", "of"])


@dataclass(frozen=True)
class Box:
    min_lon: float = -180.0
    max_lon: float = 180.0
    min_lat: float = -90.0
    max_lat: float = 90.0

    @property
    def center(self) -> tuple[float, float]:
        return (self.min_lon + self.max_lon) / 2, (self.min_lat + self.max_lat) / 2

    def contains(self, lon: float, lat: float) -> bool:
        return self.min_lon <= lon <= self.max_lon and self.min_lat <= lat <= self.max_lat

    def grown(self, degrees: float) -> Box:
        return Box(self.min_lon - degrees, self.max_lon + degrees, self.min_lat - degrees, self.max_lat + degrees)

    def checked(self) -> Box:
        if self.min_lon > self.max_lon or self.min_lat > self.max_lat:
            raise ValueError(f"the region box is empty: longitudes {self.min_lon} to {self.max_lon}, latitudes {self.min_lat} to {self.max_lat}")
        return self


@dataclass(frozen=True)
class Overrides:
    """Region values given one by one; None where not given."""

    min_lon: float | None = None
    max_lon: float | None = None
    min_lat: float | None = None
    max_lat: float | None = None
    proj_lon0: float | None = None
    proj_lat0: float | None = None

    def over(self, other: Overrides) -> Overrides:
        """Own values where given, else those of ``other``."""
        return Overrides(**{f.name: getattr(other, f.name) if getattr(self, f.name) is None else getattr(self, f.name) for f in fields(self)})

    def box(self, box: Box) -> Box:
        given = {k: getattr(self, k) for k in ("min_lon", "max_lon", "min_lat", "max_lat") if getattr(self, k) is not None}
        return replace(box, **given).checked()

    def center(self, center: tuple[float, float]) -> tuple[float, float]:
        return (center[0] if self.proj_lon0 is None else self.proj_lon0, center[1] if self.proj_lat0 is None else self.proj_lat0)


@dataclass(frozen=True)
class Settings:
    """``auto`` holds the explicit values to put over a region that the data will give; None once the region is settled."""

    lon_col: str = "longitude"
    lat_col: str = "latitude"
    decimals: int = 3
    overwrite: bool = False
    box: Box = Box()
    proj_lon0: float = 0.0
    proj_lat0: float = 0.0
    auto: Overrides | None = None
    partition: bool = False
    null_floats: bool = False


def region_names() -> list[str]:
    return [AUTO, *(p[0] for p in PRESETS), *(a[0] for a in SEA_AREAS)]


def suggestions(name: str) -> list[str]:
    """At most five names that hold the typed name or one of its distinctive words."""
    lower = name.lower()
    words = [w for w in re.split(r"[^\w]|_", lower) if len(w) >= 3 and w not in GENERIC_WORDS]
    return [n for n in region_names()[1:] if lower in n.lower() or any(w in n.lower() for w in words)][:5]


def region_box(name: str) -> Box:
    """A preset, else a sea area, in any case. A sea area across the antimeridian can't be a box and is refused."""
    for n, *bounds in PRESETS:
        if n == name.lower():
            return Box(*bounds)
    for n, *bounds, crosses in SEA_AREAS:
        if n.lower() == name.lower():
            if crosses:
                raise ValueError(f"'{n}' crosses the antimeridian ({bounds[0]} to {bounds[1]}), which a box can't express; use '{AUTO}' or two boxes")
            return Box(*bounds)
    near = suggestions(name)
    hint = f"did you mean {', '.join(near)}?" if near else f"use one of {', '.join(p[0] for p in PRESETS)}, a sea area, or '{AUTO}'"
    raise ValueError(f"unknown region '{name}': {hint}")


def read_config(path: str | Path | None) -> dict:
    """A TOML file's region and bounds; other keys are ignored."""
    if path is None:
        return {}
    found = tomllib.loads(Path(path).read_text())
    return {k: found[k] for k in ("region", *REGION_FIELDS) if k in found}


def resolve(
    region: str | None = None,
    explicit: Overrides | None = None,
    config: str | Path | None = None,
    partition: bool = False,
    **options,
) -> Settings:
    """Defaults, then the config file, then arguments, value by value.

    Bounds of the config file lie over a region named by argument, as bounds are applied
    after the named box. With ``partition`` no region may be given by argument. Without a
    name the region comes from the data, with given bounds put over it. Commands that need
    no region resolve one all the same, so a bad name in the file is an error for them too.
    """
    given = explicit or Overrides()
    if partition and (region is not None or given != Overrides()):
        raise ValueError("partition derives its regions from the data and can't be combined with a region, bounds or a projection center")
    file = read_config(config)
    bounds = given.over(Overrides(**{k: float(file[k]) for k in REGION_FIELDS if k in file}))
    name = region if region is not None else file.get("region")
    base = Settings(partition=partition, **options)
    auto = name is None or name.lower() == AUTO
    box = bounds.box(Box() if auto else region_box(name))
    lon0, lat0 = bounds.center(box.center)
    return replace(base, box=box, proj_lon0=lon0, proj_lat0=lat0, auto=bounds if auto else None)
