"""Spans and events of driver-side work, kept as bounded lists and written as tables."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPANS = "trace_id string, span_id string, parent_id string, name string, started double, seconds double, attributes string, error string"
EVENTS = "event_id string, type string, at double, payload string"


class Tracer:
    """Nested spans; the newest `keep` are held until they are written."""

    def __init__(self, keep: int = 10_000):
        self.spans: deque[tuple] = deque(maxlen=keep)
        self._open: list[str] = []
        self.trace_id = uuid.uuid4().hex

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """Attributes may be added to what is yielded; an error is noted and raised again."""
        own, parent, began, error = uuid.uuid4().hex, self._open[-1] if self._open else None, time.time(), None
        self._open.append(own)
        try:
            yield attributes
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self._open.pop()
            self.spans.append((self.trace_id, own, parent, name, began, time.time() - began, json.dumps(attributes, default=str, sort_keys=True), error))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.spans), SPANS)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append the spans to a Parquet table and forget them."""
        n = len(self.spans)
        if n:
            self.table(spark).write.mode("append").parquet(path)
            self.spans.clear()
        return n


class EventBus:
    """Typed events go to their subscribers ('*' takes all); the newest `keep` are held. A subscriber that fails stops no other."""

    def __init__(self, keep: int = 1000):
        self.events: deque[tuple] = deque(maxlen=keep)
        self.errors: deque[str] = deque(maxlen=keep)
        self._subscribers: dict[str, list[Callable[[str, dict], None]]] = {}

    def subscribe(self, kind: str, f: Callable[[str, dict], None]) -> Callable[[], None]:
        """Calls f(type, payload) from now on; what is returned ends that."""
        self._subscribers.setdefault(kind, []).append(f)
        return lambda: self._subscribers[kind].remove(f)

    def emit(self, kind: str, **payload) -> None:
        self.events.append((uuid.uuid4().hex, kind, time.time(), json.dumps(payload, default=str, sort_keys=True)))
        for f in [*self._subscribers.get(kind, []), *self._subscribers.get("*", [])]:
            try:
                f(kind, payload)
            except Exception as e:
                self.errors.append(f"{kind}: {type(e).__name__}: {e}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.events), EVENTS)
