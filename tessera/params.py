"""Thresholds of the operators, with their usual values, and their ranges."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

MOST_SLOTS, MOST_WORKERS = 8, 32


@dataclass(frozen=True)
class Params:
    block: int = 32
    template: int = 16
    region_most: int = 32
    neighbour_gap: int = 32
    neighbour_height: int = 6
    neighbour_centre: int = 16
    recognise_share: float = 0.75
    run_keep: int = 30
    run_draw: int = 50
    rect_keep: int = 30
    rect_draw: int = 50
    top_colours: int = 15
    tick_ms: int = 250
    slots: int = 8

    def __post_init__(self):
        if not 1 <= self.slots <= MOST_SLOTS:
            raise ValueError(f"slots must be 1..{MOST_SLOTS}, got {self.slots}")
        if min(self.block, self.template, self.tick_ms, self.top_colours) < 1 or not 0 <= self.recognise_share <= 1:
            raise ValueError("a size under 1 or a share outside 0 to 1")


DEFAULT = Params()


def arguments(given: list[str]) -> tuple[int | None, int | None]:
    """--slots=N and --workers=N, each None where it isn't given; anything else, or out of range, is an error."""

    def within(most: int):
        def number(text: str) -> int:
            n = int(text)
            if not 1 <= n <= most:
                raise argparse.ArgumentTypeError(f"must be 1..{most}, got {n}")
            return n

        return number

    parser = argparse.ArgumentParser(allow_abbrev=False)
    parser.add_argument("--slots", type=within(MOST_SLOTS))
    parser.add_argument("--workers", type=within(MOST_WORKERS))
    found = parser.parse_args(given)
    return found.slots, found.workers
