"""Checks before a long run: each service that its routes need answers one small question."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pairloom.operators.routes import known_route

#: What each route asks of (fixed values); routes that aren't named need no service.
NEEDS = {
    "embedding": {"vectors"},
    "hosted_rerank": {"reranker"},
    "pointwise": {"scorer"},
    "pointwise_plain": {"scorer"},
    "crossencode": {"scorer"},
    "pairwise": {"scorer"},
    "hybrid": {"vectors", "scorer"},
}


class NotReady(RuntimeError):
    """A service that the run needs doesn't answer; raised before any work is done."""


def needed(routes: Iterable[str], select: bool = False, generate: bool = False) -> set[str]:
    """The services of the named routes, and those of context selection and of answers."""
    out = set().union(*(NEEDS.get(known_route(r), set()) for r in routes)) if routes else set()
    return out | ({"scorer"} if select else set()) | ({"generator"} if generate else set())


def preflight(checks: dict[str, Callable[[], object]], wanted: Iterable[str]) -> dict[str, object]:
    """What each wanted check returned; all that fail, or are missing, are named in one error."""
    found, bad = {}, []
    for name in sorted(wanted):
        try:
            found[name] = checks[name]()
        except KeyError:
            bad.append(f"{name}: not configured")
        except Exception as e:  # noqa: BLE001  any failure means not ready
            bad.append(f"{name}: {e}")
    if bad:
        raise NotReady("; ".join(bad))
    return found
