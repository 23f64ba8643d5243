"""Hooks around operations, the operation registry, plugin order, events, and the read-only seal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from .errors import ReadOnly

#: Fixed priorities; lower runs first.
POLICY, VALIDATION, CACHE, OBSERVABILITY, DEFAULT = 100, 150, 200, 300, 500

#: operation: (policy key, mutates, has an id)
OPERATIONS = {
    "getById": ("query", False, True), "getByIds": ("query", False, False), "cursor": ("query", False, False), "getDeleted": ("query", False, False),
    "getOrCreate": ("query", False, False), "getByQuery": ("query", False, False), "getOne": ("query", False, False),
    "getAll": ("filters", False, False), "findAll": ("query", False, False), "count": ("query", False, False),
    "exists": ("query", False, False), "distinct": ("query", False, False), "aggregate": ("query", False, False),
    "aggregatePaginate": ("filters", False, False), "lookupPopulate": ("filters", False, False),
    "create": ("data", True, False), "createMany": ("dataArray", True, False), "update": ("query", True, True),
    "updateMany": ("query", True, False), "findOneAndUpdate": ("query", True, False), "delete": ("query", True, True),
    "deleteMany": ("query", True, False), "restore": ("query", True, True), "claim": ("query", True, True),
    "claimVersion": ("query", True, True), "bulkWrite": ("operations", True, False), "purge": ("query", True, False), "archive": ("query", True, False),
}
#: getOrCreate is a read to policies, but may insert: a sealed repository has it not.
READS = frozenset(k for k, (_, mutates, _) in OPERATIONS.items() if not mutates) - {"getOrCreate"} | {"watch", "read", "schema", "key", "name", "capabilities", "changes"}


class Hooks:
    def __init__(self):
        self._by_event: dict[str, list[tuple[int, int, Callable]]] = {}
        self._n = 0

    def on(self, event: str, call: Callable[[dict], Any], priority: int = DEFAULT) -> Callable[[], None]:
        self._n += 1
        entry = (priority, self._n, call)
        self._by_event.setdefault(event, []).append(entry)
        self._by_event[event].sort(key=lambda e: e[:2])
        return lambda: self._by_event[event].remove(entry)

    def listens(self, op: str) -> bool:
        """Whether anything is called before, after or on an error of the operation."""
        return any(self._by_event.get(f"{when}:{op}") for when in ("before", "after", "error"))

    def emit(self, event: str, context: dict) -> None:
        for _, _, call in list(self._by_event.get(event, ())):
            call(context)

    def run(self, op: str, context: dict, body: Callable[[dict], Any]) -> Any:
        """before, the operation (unless a hook has answered), then after or error."""
        context |= {"operation": op}
        try:
            self.emit(f"before:{op}", context)
            result = context["cached"] if "cached" in context else body(context)
        except Exception as e:
            self.emit(f"error:{op}", context | {"error": e})
            raise
        context["result"] = result
        self.emit(f"after:{op}", context)
        return context["result"]


#: Each plugin must stand before those listed for it.
BEFORE = {"tenant": ("cache", "soft-delete"), "soft-delete": ("batch", "cache")}


def check_plugin_order(names: Sequence[str]) -> None:
    for name, later in BEFORE.items():
        for other in later:
            if name in names and other in names and names.index(name) > names.index(other):
                raise ValueError(f'plugin "{name}" must come before "{other}"')


EVENTS = {"create": "created", "createMany": "created", "update": "updated", "updateMany": "updated", "findOneAndUpdate": "updated", "delete": "deleted", "deleteMany": "deleted", "restore": "restored", "claim": "updated", "claimVersion": "updated"}


def emit_events(hooks: Hooks, resource: str, publish: Callable[[dict], Any], on_error: Callable[[Exception], Any] | None = None) -> None:
    """``<resource>.<verb>`` after each successful write; a failing publisher does not fail the write."""

    def send(verb: str) -> Callable[[dict], None]:
        def call(context: dict) -> None:
            try:
                publish({"type": f"{resource}.{verb}", "operation": context["operation"], "result": context.get("result")})
            except Exception as e:
                if on_error:
                    on_error(e)

        return call

    for op, verb in EVENTS.items():
        hooks.on(f"after:{op}", send(verb), OBSERVABILITY)


class Sealed:
    """Only the reads of a repository; everything unknown is refused."""

    def __init__(self, target: Any):
        object.__setattr__(self, "_target", target)

    def __getattr__(self, name: str) -> Any:
        if name not in READS and _snake_reads(name) is False:
            raise ReadOnly(f'"{name}" is not available on a read-only repository')
        return getattr(self._target, name)

    def __setattr__(self, name: str, value: Any) -> None:
        raise ReadOnly("a read-only repository cannot be changed")


def _snake_reads(name: str) -> bool:
    return name in {"".join("_" + c.lower() if c.isupper() else c for c in r) for r in READS}
