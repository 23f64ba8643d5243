"""A cache of collected results: freshness, single flight, versions, tags."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future
from concurrent.futures import TimeoutError as Late
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, is_dataclass
from datetime import date, datetime
from typing import Any


@dataclass(frozen=True)
class CacheOptions:
    """``bypass`` skips the read and still writes; ``enabled=False`` skips both."""

    stale_time: float = 0
    gc_time: float = 60
    swr: bool = False
    tags: tuple[str, ...] = ()
    bypass: bool = False
    enabled: bool = True
    key: str | None = None


def stable(value: Any) -> str:
    """JSON with sorted keys; dates as ISO text, sets sorted, NaN and infinities as null."""

    def plain(v: Any) -> Any:
        if is_dataclass(v) and not isinstance(v, type):
            v = asdict(v)
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (set, frozenset)):
            return sorted(map(plain, v), key=repr)
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (datetime, date)):
            return v.isoformat()
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    def known(v: Any) -> Any:
        if (is_dataclass(v) and not isinstance(v, type)) or isinstance(v, (Mapping, set, frozenset, datetime, date)):
            return plain(v)
        return str(v)

    try:  # plain JSON needs no copy
        return _encode(value, known)
    except (TypeError, ValueError):  # NaN, infinities, keys of mixed types
        return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _encode(value: Any, known: Callable[[Any], Any]) -> str:
    return json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=known).encode(value)


def fnv1a64(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"


def content_hash(value: Any) -> str:
    return hashlib.sha256(stable(value).encode()).hexdigest()


def cache_key(op: str, model: str, version: int, params: Mapping[str, Any], scope: str = "", prefix: str = "rc") -> str:
    """Options of the cache and hints of the execution do not take part."""
    rest = {k: v for k, v in params.items() if k not in ("cache", "execution_hints", "hints")}
    return ":".join((prefix, op, model, str(version), scope, fnv1a64(stable(rest))))


class MemoryAdapter:
    """Least recently used entries go first; each has a time to live."""

    def __init__(self, most: int = 10_000, now: Callable[[], float] = time.monotonic):
        self.most, self.now = most, now
        self._data: OrderedDict[str, tuple[float | None, Any]] = OrderedDict()
        self._lock = threading.RLock()

    def get(self, key: str) -> Any:
        with self._lock:
            hit = self._data.get(key)
            if hit is None:
                return None
            if hit[0] is not None and hit[0] <= self.now():
                del self._data[key]
                return None
            self._data.move_to_end(key)
            return hit[1]

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        with self._lock:
            self._data[key] = (None if ttl is None else self.now() + ttl, value)
            self._data.move_to_end(key)
            while len(self._data) > self.most:
                self._data.popitem(last=False)

    def delete(self, key: str) -> None:
        with self._lock:
            self._data.pop(key, None)

    def clear(self, prefix: str = "") -> None:
        with self._lock:
            for k in [k for k in self._data if k.startswith(prefix)]:
                del self._data[k]

    def increment(self, key: str, by: int = 1) -> int:
        with self._lock:
            n = (self.get(key) or 0) + by
            self.set(key, n)
            return n

    def add_to_set(self, key: str, members: Iterable[str]) -> None:
        with self._lock:
            held = self.get(key)
            if isinstance(held, set):
                held.update(members)
            else:
                self.set(key, set(held or ()) | set(members))


class TimeoutAdapter:
    """Another adapter, with every call bounded; a late read is a miss, a late write is dropped."""

    def __init__(self, inner: Any, seconds: float = 0.25):
        self.inner, self.seconds, self._pool = inner, seconds, ThreadPoolExecutor(4)

    def __getattr__(self, name: str) -> Any:
        target = getattr(self.inner, name)

        def call(*args: Any, **kwargs: Any) -> Any:
            try:
                return self._pool.submit(target, *args, **kwargs).result(self.seconds)
            except Late:
                return None

        return call


class Cache:
    def __init__(self, adapter: Any = None, prefix: str = "rc", now: Callable[[], float] = time.monotonic):
        self.adapter, self.prefix, self.now = adapter or MemoryAdapter(now=now), prefix, now
        self._flights: dict[str, Future] = {}
        self._lock = threading.Lock()

    def version(self, model: str, scope: str = "") -> int:
        return self.adapter.get(f"{self.prefix}:v:{model}:{scope}") or 0

    def bump(self, model: str, scope: str = "") -> int:
        return self.adapter.increment(f"{self.prefix}:v:{model}:{scope}")

    def state(self, key: str, options: CacheOptions) -> tuple[str, Any]:
        """("fresh" | "stale" | "miss" | "bypass" | "disabled", value)."""
        if not options.enabled:
            return "disabled", None
        if options.bypass:
            return "bypass", None
        hit = self.adapter.get(key)
        if hit is None:
            return "miss", None
        return ("fresh" if self.now() < hit["fresh_until"] else "stale"), hit["value"]

    def put(self, key: str, value: Any, options: CacheOptions) -> None:
        now = self.now()
        self.adapter.set(key, {"value": value, "fresh_until": now + options.stale_time}, options.stale_time + options.gc_time)
        for tag in options.tags:
            self.adapter.add_to_set(f"{self.prefix}:tag:{tag}", [key])

    def invalidate_tags(self, *tags: str) -> int:
        n = 0
        for tag in tags:
            for key in list(self.adapter.get(f"{self.prefix}:tag:{tag}") or ()):
                self.adapter.delete(key)
                n += 1
            self.adapter.delete(f"{self.prefix}:tag:{tag}")
        return n

    def fetch(self, key: str, load: Callable[[], Any], options: CacheOptions = CacheOptions()) -> Any:
        """Fresh hits answer; a stale hit answers too if ``swr``, and is renewed behind; one load per key."""
        key = options.key or key
        state, value = self.state(key, options)
        if state == "fresh":
            return value
        if state == "disabled":
            return load()
        if state == "stale" and options.swr:
            threading.Thread(target=self._load, args=(key, load, options), daemon=True).start()
            return value
        return self._load(key, load, options)

    def _load(self, key: str, load: Callable[[], Any], options: CacheOptions) -> Any:
        with self._lock:
            flight, first = self._flights.get(key), False
            if flight is None:
                flight, first = self._flights.setdefault(key, Future()), True
        if not first:
            return flight.result()
        try:
            value = load()
            self.put(key, value, options)
            flight.set_result(value)
            return value
        except BaseException as e:
            flight.set_exception(e)
            raise
        finally:
            with self._lock:
                self._flights.pop(key, None)
