"""Cancelable events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

#: Events of a graph's mutations; each is followed by @graph/mutate and @graph/version.
MUTATIONS = tuple(
    [f"@{k}/{w}" for k in ("vertex", "edge") for w in ("add", "remove", "addLabel", "removeLabel", "setProperty", "setProperties", "removeProperty", "removeProperties")] + ["@graph/truncate", "@graph/mutate"]
)


@dataclass
class Event:
    type: str
    value: Any
    defaultPrevented: bool = False

    def preventDefault(self) -> None:
        self.defaultPrevented = True


class Emitter:
    """Listeners are called at once and in order; a disabled emitter calls none."""

    def __init__(self, enabled: bool = False):
        self.eventsEnabled = enabled
        self._listeners: dict[str, list[Callable[[Event], None]]] = {}

    def on(self, kind: str, fn: Callable[[Event], None]) -> Callable[[], None]:
        self._listeners.setdefault(kind, []).append(fn)
        return lambda: fn in self._listeners[kind] and self._listeners[kind].remove(fn)

    def once(self, kind: str, fn: Callable[[Event], None]) -> Callable[[], None]:
        def first(e: Event) -> None:
            off()
            fn(e)

        off = self.on(kind, first)
        return off

    def eventFrom(self, kind: str, value: Any) -> Event:
        return Event(kind, value)

    def emit(self, kind: str, value: Any) -> Event:
        event = self.eventFrom(kind, value)
        for fn in list(self._listeners.get(kind, [])) if self.eventsEnabled else []:
            fn(event)
        return event

    def enableEvents(self) -> None:
        self.eventsEnabled = True

    def disableEvents(self) -> None:
        self.eventsEnabled = False
