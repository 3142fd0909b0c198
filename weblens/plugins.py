"""Operators by kind and name: what a deployment adds to the engine, and in which order use cases run."""

import importlib.util
import logging
from collections.abc import Callable, Iterable
from graphlib import TopologicalSorter
from pathlib import Path

KINDS = ("source", "sink", "feature", "model", "usecase", "state")
_known: dict[str, dict[str, object]] = {k: {} for k in KINDS}
log = logging.getLogger(__name__)


def register(kind: str, name: str) -> Callable:
    """Class or function decorator; a later one of the same name takes its place, with a warning."""

    def add(it):
        if name in _known[kind]:
            log.warning("%s %s is replaced", kind, name)
        _known[kind][name] = it
        return it

    return add


def get(kind: str, name: str):
    return _known[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_known[kind])


def discover(folder: str) -> list[str]:
    """Load all modules below a folder; a broken one is skipped with a warning. Returns what was loaded."""
    loaded = []
    for path in sorted(Path(folder).rglob("*.py")):
        spec = importlib.util.spec_from_file_location(f"weblens_plugin_{path.stem}", path)
        try:
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
            loaded.append(path.stem)
        except Exception:
            log.warning("plugin %s is skipped", path, exc_info=True)
    return loaded


def available(factories: dict[str, type]) -> dict[str, type]:
    """Models that can be used here; the others are named in a warning."""
    out = {}
    for name, factory in factories.items():
        if getattr(factory, "available", lambda: True)():
            out[name] = factory
        else:
            log.warning("model %s is not available", name)
    return out


def dependency_order(depends_on: dict[str, Iterable[str]]) -> list[str]:
    """Exporters before consumers, ties by name; a cycle is an error. Dependencies that are not deployed don't count."""
    sorter = TopologicalSorter({u: [d for d in ds if d in depends_on] for u, ds in depends_on.items()})
    sorter.prepare()
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out
