"""Answers as streams of events, and small batches of calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator


def in_pieces(response: str, words: int = 3) -> Iterator[str]:
    """The response, `words` words at a time; joined they are the response with single spaces."""
    parts = response.split()
    for i in range(0, len(parts), words):
        yield " ".join(parts[i : i + words]) + (" " if i + words < len(parts) else "")


def answer_events(query: str, steps: Iterable[tuple[str, Callable[[], object]]], sources: Callable[[], list], generate: Callable[[], str | Iterable[str]], words: int = 3) -> Iterator[dict]:
    """Events of one answer: step, sources, chunk (pieces of it), then done; an error ends the stream with an error event.

    `generate` gives the whole response, which is cut into pieces, or pieces as they come.
    """
    try:
        yield {"type": "query", "query": query}
        for name, run in steps:
            run()
            yield {"type": "step", "step": name}
        yield {"type": "sources", "sources": sources()}
        made = generate()
        whole = ""
        for piece in in_pieces(made, words) if isinstance(made, str) else made:
            whole += piece
            yield {"type": "chunk", "content": piece}
        yield {"type": "done", "response": whole}
    except Exception as e:
        yield {"type": "error", "error": f"{type(e).__name__}: {e}"}


def as_sse(events: Iterable[dict]) -> Iterator[str]:
    """Server-sent events."""
    import json

    for e in events:
        yield f"event: {e['type']}\ndata: {json.dumps(e)}\n\n"


class MicroBatcher:
    """Items are handed on in batches: when `size` are there, or the oldest has waited `most` seconds at the next call."""

    def __init__(self, handle: Callable[[list], list], size: int = 32, most: float = 0.05, clock: Callable[[], float] = time.monotonic):
        self.handle, self.size, self.most, self.clock = handle, size, most, clock
        self.waiting: list = []
        self.since = 0.0

    def add(self, item) -> list:
        """The results of a batch that this item completes or finds overdue, else nothing."""
        if not self.waiting:
            self.since = self.clock()
        self.waiting.append(item)
        return self.flush() if len(self.waiting) >= self.size or self.clock() - self.since >= self.most else []

    def flush(self) -> list:
        batch, self.waiting = self.waiting, []
        return self.handle(batch) if batch else []
