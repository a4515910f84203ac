"""Unique ids, and calls that are put off or left out."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any

_LOCK = threading.Lock()
_last = int(time.time() * 1000)


def to_base36(n: int) -> str:
    digits = ""
    while True:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not n:
            return digits


def unique_id() -> str:
    """In base 36 the next number of a counter that starts at the milliseconds of the clock."""
    global _last
    with _LOCK:
        _last += 1
        return to_base36(_last)


def debounce(f: Callable, ms: float) -> Callable[..., None]:
    """Calls f with the last arguments when no call has come for `ms`."""
    held: list[threading.Timer] = []

    def call(*args: Any) -> None:
        with _LOCK:
            for t in held:
                t.cancel()
            held[:] = [threading.Timer(ms / 1000, f, args)]
            held[0].daemon = True
            held[0].start()

    return call


def throttle(f: Callable, ms: float) -> Callable[..., None]:
    """Calls f at once, and leaves out calls that come within `ms` of one that was made."""
    last = -ms

    def call(*args: Any) -> None:
        nonlocal last
        now = time.monotonic() * 1000
        if now - last >= ms:
            last = now
            f(*args)

    return call
