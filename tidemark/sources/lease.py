"""A writer's lease: who may write for a while, so that writers take turns instead of meeting in conflicts.

A lease is a numbered record that is created once; the newest counts. It is a courtesy
with a clock: what keeps commits in order is the exclusive creation of their records,
lease or not. A holder whose lease has run out by its own clock stops `skew` seconds
early, and others wait as long after it, so clocks may differ by that much.
"""

from __future__ import annotations

import json
import time
import uuid

from .store import Store


class LeaseHeld(RuntimeError):
    """Another writer has the lease."""


class LeaseLost(RuntimeError):
    """The lease ran out, or another writer has it now."""


class Lease:
    def __init__(self, store: Store, owner: str | None = None, ttl: float = 30.0, skew: float = 5.0):
        self.store, self.owner, self.ttl, self.skew = store, owner or uuid.uuid4().hex, ttl, skew
        self.number, self.until = 0, 0.0

    def _newest(self) -> tuple[int, dict | None]:
        numbers = [int(k.rpartition("/")[2].removesuffix(".json")) for k in self.store.list("leases/")]
        if not numbers:
            return 0, None
        data = self.store.get(f"leases/{max(numbers):012d}.json")
        return max(numbers), None if data is None else json.loads(data)

    def _put(self, number: int, until: float) -> None:
        record = json.dumps({"owner": self.owner, "until": until}).encode()
        if not self.store.create(f"leases/{number:012d}.json", record):
            raise LeaseHeld("another writer was first")
        self.number, self.until = number, until
        if number > 1:
            self.store.delete(f"leases/{number - 1:012d}.json")

    def claim(self) -> Lease:
        """Takes the lease if nobody has it."""
        number, there = self._newest()
        now = time.time()
        if there is not None and there["owner"] != self.owner and there["until"] + self.skew > now:
            raise LeaseHeld(f"{there['owner']} has the lease for {there['until'] - now:.0f} s")
        self._put(number + 1, now + self.ttl)
        return self

    def live(self) -> bool:
        """Whether the lease surely holds still, by this clock."""
        return self.number > 0 and time.time() < self.until - self.skew

    def renew(self) -> None:
        number, there = self._newest()
        if not self.number or number != self.number or there is None or there["owner"] != self.owner:
            self.number = 0
            raise LeaseLost("another writer has the lease")
        try:
            self._put(number + 1, time.time() + self.ttl)
        except LeaseHeld as e:
            self.number = 0
            raise LeaseLost(str(e)) from None

    def fence(self) -> None:
        """Before a commit: renews a lease that is about to run out, and raises if it is gone."""
        if not self.live():
            self.renew()

    def release(self) -> None:
        if self.number and self._newest()[0] == self.number:
            self._put(self.number + 1, 0.0)
        self.number, self.until = 0, 0.0
