"""Calls that may fail: retries with growing, jittered waits, and a limit on what runs at once."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

A = TypeVar("A")
B = TypeVar("B")


def retried(call: Callable[[A], B], attempts: int = 3, base: float = 1.0, most: float = 60.0, seed: int | None = None, sleep: Callable[[float], None] = time.sleep, errors: tuple[type[Exception], ...] = (Exception,)) -> Callable[[A], B]:
    """The call, tried `attempts` times; between tries min(base * 2**n, most) seconds, times a factor of .5 to 1.5. The last error is raised."""
    draw = random.Random(seed)

    def run(x: A) -> B:
        for n in range(attempts):
            try:
                return call(x)
            except errors:
                if n == attempts - 1:
                    raise
                sleep(min(base * 2**n, most) * draw.uniform(0.5, 1.5))
        raise ValueError("attempts must be positive")

    return run


def gathered(call: Callable[[A], B], items: Iterable[A], at_once: int = 8) -> list[B | Exception]:
    """Results in the order of the items, at most `at_once` running; an item that fails gives its exception."""

    def safe(x: A) -> B | Exception:
        try:
            return call(x)
        except Exception as e:
            return e

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(safe, items))
