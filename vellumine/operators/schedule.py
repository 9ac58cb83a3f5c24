"""When to scan, what holds work back, and what one cycle does, as plain functions of time and counters."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field, replace

SCAN_EVERY_S, WATCHED_SCAN_EVERY_S, MOST_PENDING = 300, 900, 65_536
GATES = ("idle", "battery", "embedder_down", "store_failing", "unreadable")


@dataclass(frozen=True)
class State:
    """What a scheduler remembers between cycles."""

    last_scan: int | None = None
    watched: bool = False
    pending: frozenset[str] = frozenset()
    full_scan: bool = False
    sweep: str | None = "all"  # a start arms the full sweep
    gauges: dict = field(default_factory=dict)
    totals: dict = field(default_factory=dict)


def scan_due(s: State, now: int) -> bool:
    every = WATCHED_SCAN_EVERY_S if s.watched else SCAN_EVERY_S
    return s.full_scan or s.last_scan is None or now - s.last_scan >= every


def close_window(s: State, paths: set[str], rescan: bool) -> State:
    """A debounce window's paths join the pending ones; a rescan, or more new paths than the cap holds, asks for a full scan."""
    if rescan or len(s.pending | paths) > MOST_PENDING:
        return replace(s, full_scan=True, pending=frozenset())
    return replace(s, pending=s.pending | frozenset(paths))


def after_scan(s: State, counts: dict, now: int, reconciled: bool) -> State:
    """Totals add up; unverified and ignored are gauges of the last pass that reconciled. Removals and changes arm the queue's sweep."""
    totals = {k: s.totals.get(k, 0) + v for k, v in counts.items() if k not in ("unverified", "ignored")} | {k: v for k, v in s.totals.items() if k not in counts}
    gauges = {k: counts.get(k, 0) for k in ("unverified", "ignored")} if reconciled else s.gauges
    arm = any(counts.get(k, 0) for k in ("deleted", "pruned", "changed"))
    return replace(s, last_scan=now, full_scan=False, pending=frozenset(), totals=totals, gauges=gauges, sweep=s.sweep or ("queue" if arm else None))


def gate(due: int, on_battery: bool, battery_allowed: bool, embedder_up: bool, store_ok: bool = True, readable: bool = True) -> str | None:
    """What keeps the queue from being worked off, the first that applies; None: nothing."""
    holds = (("store_failing", not store_ok), ("idle", not due), ("battery", on_battery and not battery_allowed), ("embedder_down", not embedder_up), ("unreadable", not readable))
    return next((name for name, on in holds if on), None)


def cycle(s: State, now: int, due: int, **power) -> list[str]:
    """The steps of one cycle in order."""
    steps = ["scan"] if scan_due(s, now) else ["reconcile_pending"] if s.pending else []
    steps += [f"sweep_{s.sweep}"] if s.sweep else []
    held = gate(due, **power)
    return [*steps, "drain" if held is None else f"held:{held}"]


def run_cycle(s: State, now: int, steps: dict[str, Callable], due: Callable[[], int], **power) -> tuple[State, dict]:
    """Carry out one cycle; the next state, and what each step gave.

    ``steps`` has ``scan()``, ``reconcile(paths)``, ``sweep(scope)`` and ``drain()``. A step that fails ends the cycle, and
    what it was to do stays due: pending paths, an armed sweep and a full scan are given up only when they are done.
    """
    out: dict = {}
    try:
        if scan_due(s, now):
            out["scan"] = steps["scan"]()
            s = after_scan(s, {k: v for k, v in out["scan"].items() if isinstance(v, int)}, now, not out["scan"].get("declined"))
        elif s.pending:
            out["reconcile"] = steps["reconcile"](sorted(s.pending))
            seen = after_scan(s, {k: v for k, v in out["reconcile"].items() if isinstance(v, int)}, now, False)
            s = replace(seen, last_scan=s.last_scan, full_scan=s.full_scan)
        if s.sweep:
            steps["sweep"](s.sweep)
            out["sweep"], s = s.sweep, replace(s, sweep=None)
        held = gate(due(), **power)
        if held:
            out["held"] = held
        else:
            out["drain"] = steps["drain"]()
    except Exception as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return s, out


class Searches:
    """At most ``most`` searches at once, each for ``seconds`` at most; more are refused instead of queued."""

    def __init__(self, most: int = 8, seconds: float = 30.0):
        self.seconds, self._free, self._pool = seconds, threading.BoundedSemaphore(most), ThreadPoolExecutor(most)

    def run(self, search: Callable, *args, **kwargs):
        from vellumine.operators.search import DeadlineExceeded, Overloaded

        if not self._free.acquire(blocking=False):
            raise Overloaded("too many searches at once")

        def one():
            try:
                return search(*args, **kwargs)
            finally:
                self._free.release()

        try:
            return self._pool.submit(one).result(self.seconds)
        except Late:
            raise DeadlineExceeded("the search took too long") from None
