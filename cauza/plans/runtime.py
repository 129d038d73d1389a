"""Concurrent Spark jobs from the driver, results in order."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any


def launch(todo: Callable[..., Any], num: int, param: Any = None, dataset: Any = None, threads: int = 4) -> list:
    """todo(id, num, param, dataset) for each id; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, num))) as pool:
        return [f.result() for f in [pool.submit(todo, i, num, param, dataset) for i in range(num)]]
