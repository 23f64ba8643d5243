"""Tenancy, retries, leases, state machines, capabilities, and the distribution guard."""

from __future__ import annotations

import random
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from ..plans import filters as f
from ..plans.filters import Filter
from .errors import Conflict, IllegalTransition, Invalid


@dataclass(frozen=True)
class Tenancy:
    """``field``: rows carry the tenant; ``none``: no scoping; ``custom``: ``resolve`` gives the filter."""

    strategy: str = "field"
    field: str = "organizationId"
    resolve: Callable[[dict], Filter] | None = None
    required: bool = True

    def scope(self, context: Mapping[str, Any]) -> Filter:
        if self.strategy == "none" or context.get("skip_tenant"):
            return f.TRUE
        if self.strategy == "custom":
            return self.resolve(dict(context))
        tenant = context.get("tenant")
        if tenant is None:
            if self.required:
                raise Invalid(f'a tenant is needed ("{self.field}")')
            return f.TRUE
        return f.eq(self.field, tenant)


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    base: float = 0.1
    factor: float = 2.0
    most: float = 5.0
    jitter: float = 0.5


class Aborted(Exception):
    """The caller gave up."""


def retry(call: Callable[[], Any], policy: RetryPolicy = RetryPolicy(), transient: Callable[[BaseException], bool] = lambda e: isinstance(e, Conflict), aborted: threading.Event | None = None, sleep: Callable[[float], Any] = time.sleep) -> Any:
    for attempt in range(1, policy.attempts + 1):
        if aborted is not None and aborted.is_set():
            raise Aborted
        try:
            return call()
        except Exception as e:
            if attempt == policy.attempts or not transient(e):
                raise
            pause = min(policy.most, policy.base * policy.factor ** (attempt - 1))
            sleep(pause * (1 + policy.jitter * (random.random() - 0.5)))


@dataclass
class Lease:
    name: str
    owner: str
    token: int
    expires: float


class MemoryLocks:
    """Named leases with fencing tokens that only grow."""

    def __init__(self, now: Callable[[], float] = time.monotonic):
        self.now, self._held, self._token, self._lock = now, {}, 0, threading.Lock()

    def acquire(self, name: str, ttl: float, owner: str | None = None) -> Lease | None:
        with self._lock:
            held = self._held.get(name)
            if held and held.expires > self.now() and held.owner != owner:
                return None
            self._token += 1
            lease = self._held[name] = Lease(name, owner or uuid.uuid4().hex, self._token, self.now() + ttl)
            return lease

    def renew(self, lease: Lease, ttl: float) -> bool:
        with self._lock:
            held = self._held.get(lease.name)
            if not held or held.token != lease.token or held.expires <= self.now():
                return False
            held.expires = lease.expires = self.now() + ttl
            return True

    def release(self, lease: Lease) -> bool:
        with self._lock:
            held = self._held.get(lease.name)
            if held and held.token == lease.token:
                del self._held[lease.name]
                return True
            return False

    def holder(self, name: str) -> Lease | None:
        held = self._held.get(name)
        return held if held and held.expires > self.now() else None

    def with_lock(self, name: str, ttl: float, body: Callable[[Lease], Any]) -> Any:
        lease = self.acquire(name, ttl)
        if lease is None:
            raise Conflict(f'lock "{name}" is held')
        try:
            return body(lease)
        finally:
            self.release(lease)


@dataclass(frozen=True)
class StateMachine:
    field: str
    transitions: Mapping[str, Sequence[str]]

    def check(self, before: str, to: str) -> None:
        if to not in self.transitions.get(before, ()):
            raise IllegalTransition(f'"{before}" cannot become "{to}"', {"from": before, "to": to, "allowed": list(self.transitions.get(before, ()))})

    def sources(self, to: str) -> list[str]:
        return [k for k, v in self.transitions.items() if to in v]


@dataclass(frozen=True)
class Capabilities:
    """What this engine can do."""

    aggregate: bool = True
    aggregate_keyset: bool = True
    percentile: bool = True
    stddev: bool = True
    top_n: bool = True
    date_buckets: bool = True
    timezone_buckets: bool = True
    filtered_measures: bool = True
    lookups: bool = True
    keyset: bool = True
    upsert: bool = True
    transactions: bool = True
    bulk_write: bool = True
    claim: bool = True
    purge: bool = True
    archive: bool = True
    watch: bool = True
    cursor: bool = True
    regex: bool = True
    raw: bool = True
    nested_lookups: bool = False
    update_pipelines: bool = False
    concurrent_writers: bool = False

    def supports(self, name: str) -> bool:
        return bool(asdict(self).get(name, False))


def fields_required(node: Filter) -> set[str]:
    """Fields that every match must test: those of AND, and those that all sides of an OR share."""
    if node.op == "and":
        return set().union(*map(fields_required, node.parts))
    if node.op == "or":
        return set.intersection(*map(fields_required, node.parts))
    return {node.field} if node.op in ("eq", "in") else set()


def guard_distribution(node: Filter, key: str, mode: str = "warn") -> bool:
    """Whether the filter names the partition key, at whatever depth; else warn or refuse."""
    if key in f.fields_of(node):
        return True
    text = f'the filter does not name the partition key "{key}": every partition will be read'
    if mode == "throw":
        raise Invalid(text)
    if mode == "warn":
        warnings.warn(text, stacklevel=2)
    return False
