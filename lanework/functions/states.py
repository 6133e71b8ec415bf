"""States of an owned feed."""

from __future__ import annotations

#: The states, and those to which each may go.
ALLOWED = {
    "LAUNCHING": ("RECORDING", "WAITING_FOR_SOURCE", "ENDED", "MANUALLY_STOPPED", "CRASHED"),
    "RECORDING": ("WAITING_FOR_SOURCE", "ENDED", "MANUALLY_STOPPED", "CRASHED"),
    "WAITING_FOR_SOURCE": ("RECORDING", "ENDED", "MANUALLY_STOPPED", "CRASHED"),
    "ENDED": (),
    "MANUALLY_STOPPED": (),
    "CRASHED": (),
}
OWNED = tuple(s for s, to in ALLOWED.items() if to)
FINAL = tuple(s for s, to in ALLOWED.items() if not to)
NEEDS_WORKER = ("RECORDING", "WAITING_FOR_SOURCE")
#: Owned feeds of a session at once.
CAPACITY = 20


def reason_against(now: tuple[str, int | None] | None, op: str, new_state: str | None, worker: int | None) -> str:
    """Why an event does not hold for a feed that stands at ``now`` (state, worker; None if nobody claimed it); '' if it does."""
    if op == "claim":
        return "claimed already" if now else ""
    if op == "bind":
        return "bad worker" if worker is None or worker <= 0 else "not claimed" if not now else "not launching" if now[0] != "LAUNCHING" else ""
    if new_state not in ALLOWED:
        return "no such state"
    if worker is not None and worker <= 0:
        return "bad worker"
    if not now:
        return "not claimed"
    if now[0] in FINAL:
        return "final"
    if new_state not in ALLOWED[now[0]]:
        return "not allowed"
    return "no worker" if new_state in NEEDS_WORKER and not (worker or now[1]) else ""


def after(now: tuple[str, int | None] | None, op: str, new_state: str | None, worker: int | None) -> tuple[str, int | None]:
    """Where a feed stands after an event that holds."""
    if op == "claim":
        return "LAUNCHING", None
    return now[0] if op == "bind" else new_state, worker or now[1]
