"""A bounded cache of token ids by unit of text, for tokenizers whose result for a text is that of its
units, one after another."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np

#: The characters of Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Encoding makes very many lists and no cycles: looking for cycles meanwhile costs a sixth of its time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class UnitCache(dict):
    """Unit -> number; ids of all units lie in one flat array. When `most` units are held, it begins
    anew: memory stays bounded and results don't depend on what is cached."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 400_000):
        super().__init__()
        self.encode_units, self.most = encode, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.begin, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def __missing__(self, unit: str) -> int:
        k = self[unit] = len(self)
        self.new.append(unit)
        return k

    def ids(self, units: list[str], per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts that consist of so many units each, and where each text's ids begin."""
        if len(self) > self.most:
            self.reset()
        known = len(self)
        k = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        if self.new:
            got = self.encode_units(self.new)
            self.new = []
            lens = np.fromiter(map(len, got), np.int64, len(got))
            total = int(lens.sum())
            while len(self.begin) < len(self):
                self.begin, self.size = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.size, np.zeros_like(self.size)]
            while len(self.flat) < self.used + total:
                self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.begin[known : known + len(got)] = self.used + np.cumsum(lens) - lens
            self.size[known : known + len(got)] = lens
            self.used += total
        size = self.size[k]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.begin[k] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.r_[0, ends][np.r_[0, np.cumsum(per_text)]]
