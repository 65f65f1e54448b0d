"""The commit log: an immutable, hash-linked chain of records, each a change of the set of live files.

A commit is published by creating `commits/<generation>.json`, which succeeds for
one writer only. The record names its parent's hash. Checkpoints hold the whole
state at a generation, so that opening need not read the chain from its start.
"""

from __future__ import annotations

import copy
import hashlib
import json
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from .store import Store, StoreError

FORMAT = "tidemark-1"
CHECKPOINT_EVERY = 50
#: What a state holds besides tables.
KINDS = ("views", "indexes", "triggers", "settings")


#: Records that are read side by side; databases whose last resolved state a process remembers.
READERS, MOST_RESOLVED = 16, 32
_RESOLVED: dict[str, tuple[dict, dict[int, float]]] = {}


class WriteConflict(RuntimeError):
    """Another writer changed the same files or schema since this transaction's snapshot."""


class CorruptLog(RuntimeError):
    """A record that does not fit its chain."""


def empty_state() -> dict:
    return {"generation": 0, "sha": "", "id": "", "tables": {}, "views": {}, "indexes": {}, "triggers": {}, "settings": {}}


def _key(generation: int) -> str:
    return f"commits/{generation:012d}.json"


def encode(record: dict) -> bytes:
    return json.dumps(record, sort_keys=True, separators=(",", ":")).encode()


def difference(old: dict, new: dict) -> dict:
    """What turns one state into another, by table: schemas, added and removed files."""
    tables = {}
    for name in sorted({*old["tables"], *new["tables"]}):
        a, b = old["tables"].get(name), new["tables"].get(name)
        if a == b:
            continue
        before, after = (a or {}).get("files", {}), (b or {}).get("files", {})
        tables[name] = {
            "head": None if b is None else {k: v for k, v in b.items() if k != "files"},
            "add": {f: v for f, v in after.items() if f not in before},
            "remove": sorted(f for f in before if f not in after),
            "head_changed": {k: v for k, v in (a or {}).items() if k not in ("files", "next_rowid")} != {k: v for k, v in (b or {}).items() if k not in ("files", "next_rowid")},
        }
    others = {k: new.get(k, {}) for k in KINDS if old.get(k, {}) != new.get(k, {})}
    return {"tables": tables, **others}


def applied(state: dict, change: dict) -> dict:
    out = copy.deepcopy(state)
    for name, t in change["tables"].items():
        if t["head"] is None:
            out["tables"].pop(name, None)
            continue
        files = out["tables"].get(name, {}).get("files", {})
        files = {f: v for f, v in files.items() if f not in set(t["remove"])} | t["add"]
        rowid = max(t["head"].get("next_rowid", 1), out["tables"].get(name, {}).get("next_rowid", 1))
        out["tables"][name] = t["head"] | {"files": files, "next_rowid": rowid}
    for k in KINDS:
        if k in change:
            out[k] = change[k]
    return out


def overlaps(mine: dict, theirs: dict) -> str | None:
    """Why two changes cannot both be made, or None: a file both touch, or a table one alters and the other changes."""
    for name in mine["tables"].keys() & theirs["tables"].keys():
        a, b = mine["tables"][name], theirs["tables"][name]
        if a["head_changed"] or b["head_changed"]:
            return f"table {name} was altered"
        if set(a["remove"]) & set(b["remove"]):
            return f"rows of {name} were changed"
        if a.get("whole") and (b["add"] or b["remove"]) or b.get("whole") and (a["add"] or a["remove"]):
            return f"{name} has keys that both sides check"
    for k in KINDS:
        if k in mine and k in theirs:
            return f"{k} were changed"
    return None


def renumbered(change: dict, base: dict, head: dict) -> dict:
    """A change as it is made on `head` though its row ids were given on `base`.

    Whatever got its row id in this change has one from the base's `next_rowid` on. If others have given out ids since,
    the files of the change are marked: their ids from there on count as so many more when they are read.
    """
    out = None
    for name, t in change["tables"].items():
        a, b = base["tables"].get(name), head["tables"].get(name)
        if t["head"] is None or a is None or b is None:
            continue
        by = b["next_rowid"] - a["next_rowid"]
        if by and t["head"]["next_rowid"] > a["next_rowid"]:
            out = out or copy.deepcopy(change)
            mine = out["tables"][name]
            mine["head"]["next_rowid"] += by
            mine["add"] = {f: v | {"shift": [a["next_rowid"], by]} for f, v in t["add"].items()}
    return out or change


class Log:
    def __init__(self, store: Store):
        self.store = store
        told = store.get("db.json")
        if told is None:
            store.create("db.json", encode({"format": FORMAT, "database_id": uuid.uuid4().hex}))
            told = store.get("db.json")
        self.about = json.loads(told)
        if self.about.get("format") != FORMAT:
            raise CorruptLog(f"unknown format {self.about.get('format')!r}")

    def record(self, generation: int, data: bytes | None = None) -> tuple[dict, str] | None:
        data = self.store.get(_key(generation)) if data is None else data
        if data is None:
            return None
        try:
            return json.loads(data), hashlib.sha256(data).hexdigest()
        except ValueError as e:
            raise CorruptLog(f"commit {generation} cannot be read") from e

    def _listed(self) -> dict[int, float]:
        """Generations and when their records were written."""
        return {int(k.rpartition("/")[2].removesuffix(".json")): at for k, at in self.store.modified("commits/") if k.endswith(".json")}

    def _ahead(self, state: dict, until: int | None, listed: dict[int, float]) -> dict[int, bytes | None]:
        """The records after a state, read side by side; each is checked in turn when it is applied."""
        wanted = sorted(g for g in listed if g > state["generation"] and (until is None or g <= until))
        with ThreadPoolExecutor(READERS) as pool:
            return dict(zip(wanted, pool.map(lambda g: self.store.get(_key(g)), wanted), strict=True))

    def follow(self, state: dict, until: int | None = None, ahead: dict[int, bytes | None] | None = None) -> dict:
        """The state after all later commits, each checked against its parent."""
        while until is None or state["generation"] < until:
            found = self.record(state["generation"] + 1, (ahead or {}).get(state["generation"] + 1))
            if found is None:
                if until is not None:
                    raise CorruptLog(f"there is no commit {state['generation'] + 1}")
                return state
            record, sha = found
            if record["generation"] != state["generation"] + 1 or record["parent_sha"] != state["sha"]:
                raise CorruptLog(f"commit {record['generation']} does not follow its parent")
            state = applied(state, record["change"]) | {"generation": record["generation"], "sha": sha, "id": record["id"]}
        return state

    def load(self, generation: int | None = None) -> dict:
        """The state at a generation (the newest unless told): the nearest state known, then the commits after it.

        A state that this process has resolved before serves again if all records up to it are as they were then.
        """
        listed = self._listed()
        held, times = _RESOLVED.get(self.about["database_id"], (None, None))
        if held is not None and (generation is None or held["generation"] <= generation) and times == {g: at for g, at in listed.items() if g <= held["generation"]}:
            return self._resolved(self.follow(copy.deepcopy(held), generation, self._ahead(held, generation, listed)), listed)
        best = empty_state()
        keys = [int(k.rpartition("/")[2].removesuffix(".json")) for k in self.store.list("checkpoints/")]
        for g in sorted((g for g in keys if generation is None or g <= generation), reverse=True):
            data = self.store.get(f"checkpoints/{g:012d}.json")
            try:
                told = json.loads(data)
                if told["sha256"] == hashlib.sha256(encode(told["state"])).hexdigest():
                    best = told["state"]
                    break
            except (ValueError, KeyError, TypeError):
                continue  # a damaged checkpoint: an older one, or the whole chain, will do
        return self._resolved(self.follow(best, generation, self._ahead(best, generation, listed)), listed)

    def _resolved(self, state: dict, listed: dict[int, float]) -> dict:
        """Remembers the newest state of a few databases for later openings."""
        known = _RESOLVED.pop(self.about["database_id"], None)
        times = {g: at for g, at in listed.items() if g <= state["generation"]}
        if known is not None and known[0]["generation"] > state["generation"]:
            _RESOLVED[self.about["database_id"]] = known
        elif state["generation"] in times:
            _RESOLVED[self.about["database_id"]] = copy.deepcopy(state), times
        while len(_RESOLVED) > MOST_RESOLVED:
            del _RESOLVED[next(iter(_RESOLVED))]
        return state

    def checkpoint(self, state: dict) -> None:
        self.store.put(f"checkpoints/{state['generation']:012d}.json", encode({"state": state, "sha256": hashlib.sha256(encode(state)).hexdigest()}))

    def publish(self, base: dict, change: dict, tries: int = 60, patience: float = 20.0) -> dict:
        """Makes a change the next commit. Commits of others in between are followed if they do not overlap.

        A store that fails is asked again, with longer and longer waits of random length, until `patience` seconds are
        spent; before each new attempt the chain tells whether the last one took place after all.
        """
        head, own, wait, until = base, uuid.uuid4().hex, 0.02, time.monotonic() + patience
        for _ in range(tries):
            record = {"generation": head["generation"] + 1, "id": own, "parent_sha": head["sha"], "time": time.time(), "change": renumbered(change, base, head)}
            try:
                made = self.store.create(_key(record["generation"]), encode(record))
            except StoreError:
                there = self._told(record["generation"], until)
                if there is None:
                    if time.monotonic() > until:
                        raise
                    time.sleep(wait * (0.5 + random.random()))
                    wait = min(2 * wait, 2.0)
                    continue
                made = there["id"] == own
            if made:
                state = self.follow(head, record["generation"])
                if state["generation"] % CHECKPOINT_EVERY == 0:
                    self.checkpoint(state)
                return state
            newer = self.record(record["generation"])[0]
            if (why := overlaps(change, newer["change"])) is not None:
                raise WriteConflict(f"database snapshot is out of date: {why}")
            head = self.follow(head, record["generation"])
        raise WriteConflict("database is busy")

    def _told(self, generation: int, until: float) -> dict | None:
        """The record of a generation, or None if there is none, from a store that fails now and then."""
        while True:
            try:
                found = self.record(generation)
                return None if found is None else found[0]
            except StoreError:
                if time.monotonic() > until:
                    raise
                time.sleep(0.05 + 0.1 * random.random())

    def sweep(self, keep: int, older_than: float = 0.0, strays: float = 86_400.0) -> list[str]:
        """Deletes data files that neither the newest `keep` generations nor the head refer to; returns them.

        Files that no commit ever named (of failed statements, intermediate rows under `staged/`) go when they are
        `strays` seconds old: until then they may belong to a transaction that is still open.
        """
        head = self.load()
        live = set()
        state = self.load(max(0, head["generation"] - keep + 1) if keep > 1 else head["generation"])
        while True:
            live |= {f for t in state["tables"].values() for f in t["files"]}
            if state["generation"] == head["generation"]:
                break
            state = self.follow(state, state["generation"] + 1)
        known = set()
        for g in range(1, head["generation"] + 1):
            found = self.record(g)
            if found is not None and found[0]["time"] <= time.time() - older_than:
                known |= {f for t in found[0]["change"]["tables"].values() for f in t["add"]}
        named = {f for g in range(1, head["generation"] + 1) if (r := self.record(g)) is not None for t in r[0]["change"]["tables"].values() for f in t["add"]}
        old = {f for folder in ("data/", "staged/") for f, at in self.store.modified(folder) if at <= time.time() - strays}
        gone = sorted((known | (old - named)) - live)
        for f in gone:
            self.store.delete(f)
        return gone
