"""Options of the commands, with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from bitsift.functions.scoring import ScoreType
from bitsift.functions.sizes import Interpolation, parse_interpolation, parse_size
from bitsift.operators.catalog import Duplicate, HashKind
from bitsift.operators.cluster import Init
from bitsift.operators.features import Options as FeatureOptions


def within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be within {low} and {high}, not {value}")
    return value


@dataclass(frozen=True)
class SearchOptions:
    distance: int = 64
    count: int = 10
    k: int = 3
    nprobe: int = 3
    score: ScoreType = ScoreType.WILSON

    def __post_init__(self) -> None:
        within("distance", self.distance, 0, 255)

    def overlay(self, **given) -> SearchOptions:
        """A request's values where it gives them, else these."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class AddOptions:
    suffixes: str = "jpg,png,webp"
    min_features: int = 250
    hash: HashKind = HashKind.CONTENT
    phash_distance: int = 8
    duplicate: Duplicate = Duplicate.IGNORE
    replace: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        within("phash_distance", self.phash_distance, 0, 64)


@dataclass(frozen=True)
class TrainOptions:
    centers: int
    images: int
    max_iter: int = 20
    init: Init = Init.RANDOM
    two_level: bool = True
    seed: int = 0


@dataclass(frozen=True)
class BuildOptions:
    batch_images: int = 100_000


@dataclass(frozen=True)
class Settings:
    features: FeatureOptions = field(default_factory=FeatureOptions)
    interpolation: Interpolation = Interpolation.AREA
    search: SearchOptions = field(default_factory=SearchOptions)
    add: AddOptions = field(default_factory=AddOptions)
    build: BuildOptions = field(default_factory=BuildOptions)


__all__ = ["AddOptions", "BuildOptions", "SearchOptions", "Settings", "TrainOptions", "parse_interpolation", "parse_size", "within"]
