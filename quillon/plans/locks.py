"""Table locks between sessions of one driver: shared, update and exclusive.

Two-phase: a session keeps its locks up to the end of its transaction. There is no deadlock
detection; a wait that is too long fails.
"""

from __future__ import annotations

import threading

# The modes from weak to strong, and those that another session may hold beside each.
MODES = ("PS", "PU", "PX")
BESIDE = {"PS": {"PS", "PU"}, "PU": {"PS"}, "PX": set()}
WAIT_SECONDS = 5.0


class LockTimeout(RuntimeError):
    """Another session held on to a lock for too long."""


class Locks:
    def __init__(self):
        self._changed = threading.Condition()
        self._held: dict[str, dict[object, str]] = {}

    def _free(self, session: object, table: str, mode: str) -> bool:
        return all(mode in BESIDE[other] for s, other in self._held.get(table, {}).items() if s is not session)

    def acquire(self, session: object, table: str, mode: str = "PX", seconds: float = WAIT_SECONDS) -> None:
        """Wait for a lock; one that the session holds already only ever gets stronger."""
        if mode not in MODES:
            raise ValueError(f"there is no lock mode {mode}")
        with self._changed:
            if not self._changed.wait_for(lambda: self._free(session, table, mode), seconds):
                raise LockTimeout(f"{table} stayed locked for {seconds} s")
            mine = self._held.setdefault(table, {})
            mine[session] = max(mode, mine.get(session, mode), key=MODES.index)

    def release(self, session: object) -> None:
        """Give up all locks of a session."""
        with self._changed:
            for table in [t for t, owners in self._held.items() if owners.pop(session, None) and not owners]:
                del self._held[table]
            self._changed.notify_all()

    def held(self, session: object) -> dict[str, str]:
        with self._changed:
            return {t: owners[session] for t, owners in self._held.items() if session in owners}
