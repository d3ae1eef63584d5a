"""What the operators share: intermediate tables, tables that a worker holds, texts of Arrow arrays in runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from claimcheck.functions.columns import free_name as free_name
from claimcheck.sources.scratch import Scratch as Scratch
from claimcheck.sources.scratch import new_path as new_path
from claimcheck.sources.scratch import saved as saved
from claimcheck.sources.scratch import shared_folder as shared_folder

_held: dict[str, Any] = {}


def only(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, held in the worker process until something of another name is asked for.

    Workers outlive tasks: without this, the tables of one stage would stay in memory during the next.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def texts_of(batch: Any) -> Iterator[list[str]]:
    """The values of an Arrow array in short runs, so that few Python objects exist at once."""
    for at in range(0, len(batch), 256):
        yield from by_bytes(batch.slice(at, 256).to_pylist())


def by_bytes(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters each; a longer text stands alone."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text or "") > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run
