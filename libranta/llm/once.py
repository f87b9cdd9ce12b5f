"""What a Python worker builds once for a broadcast value and keeps over the tasks that it runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from uuid import uuid4

_kept: dict[str, Any] = {}


class Sent:
    """A broadcast value and the object that each worker builds from it; two are kept at a time."""

    def __init__(self, spark, value: Any, build: Callable[[Any], Any]):
        self.broadcast, self.build, self.token = spark.sparkContext.broadcast(value), build, uuid4().hex

    def get(self) -> Any:
        if self.token not in _kept:
            if len(_kept) > 1:
                _kept.clear()
            _kept[self.token] = self.build(self.broadcast.value)
        return _kept[self.token]
