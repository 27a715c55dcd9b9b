"""A vendor session: services, requests and their answers. The wire is a backend's; this keeps sessions, errors and time-outs in order."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

#: Seconds to wait for one event; a whole request may take so many times as long.
EVENT_S, REQUEST_EVENTS = 40.0, 3


@dataclass(frozen=True)
class Event:
    """What a backend hands over: kind partial, response or other, and messages with the number of the request they answer."""

    kind: str
    messages: tuple[tuple[int | None, Mapping], ...] = ()


class Backend(Protocol):
    def start(self) -> bool: ...

    def open(self, service: str) -> bool: ...

    def operations(self, service: str) -> Iterable[str]: ...

    def send(self, service: str, operation: str, fields: Mapping, number: int) -> None: ...

    def next_event(self, seconds: float) -> Event | None: ...


@dataclass
class VendorSession:
    """Starts with its first use. Requests are numbered; an answer to another request is passed over."""

    backend: Backend
    event_s: float = EVENT_S
    clock: Callable[[], float] = time.monotonic
    _started: bool = field(default=False, init=False)
    _numbers: itertools.count = field(default_factory=itertools.count, init=False)

    def open(self, service: str) -> None:
        if not self._started:
            if not self.backend.start():
                raise RuntimeError("the vendor session cannot start: is its terminal or gateway running?")
            self._started = True
        if not self.backend.open(service):
            raise RuntimeError(f"service {service} cannot be opened: is the terminal running, or the gateway's address right?")

    def operation(self, service: str, name: str) -> str:
        """The service's own spelling of an operation: as given, or with a small first letter."""
        known = set(self.backend.operations(service))
        for spelled in (name, name[:1].lower() + name[1:]):
            if spelled in known:
                return spelled
        raise RuntimeError(f"service {service} has no operation {name}; it has {', '.join(sorted(known))}")

    def ask(self, service: str, name: str, **fields: object) -> list[Mapping]:
        """All messages that answer the request, partial ones first; TimeoutError where the last does not come."""
        self.open(service)
        number, began = next(self._numbers), self.clock()
        self.backend.send(service, self.operation(service, name), fields, number)
        out: list[Mapping] = []
        while True:
            event = self.backend.next_event(self.event_s)
            if event is not None:
                out += [m for of, m in event.messages if of == number]
                if event.kind == "response" and any(of == number for of, _ in event.messages):
                    return out
            if (took := self.clock() - began) > self.event_s * REQUEST_EVENTS:
                raise TimeoutError(f"no answer to {name} after {took:.1f} s")
