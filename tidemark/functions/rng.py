"""Seeded generators that the models' results depend on, in 32-bit arithmetic."""

from __future__ import annotations

_M = 0xFFFFFFFF


class Mulberry32:
    """Uniform numbers in [0, 1) from a 32-bit state."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _M

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _M
        a = self.state
        t = ((a ^ (a >> 15)) * (a | 1)) & _M
        t = (t + (((t ^ (t >> 7)) * (t | 61)) & _M)) & _M ^ t
        return ((t ^ (t >> 14)) & _M) / 4294967296.0


class Lcg:
    """The linear congruential generator with the multiplier 1664525."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _M

    def __call__(self) -> float:
        self.state = (1664525 * self.state + 1013904223) & _M
        return self.state / 4294967296.0
