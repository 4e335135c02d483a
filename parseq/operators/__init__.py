"""Operators on sequences, by family."""

from . import compare, compose, fallible, halo, order, packed, place, prefix, reduce, search, tasks, transform


def find(name: str):
    for module in (transform, search, reduce, compose, order, compare, place, prefix, packed, fallible, tasks):
        f = vars(module).get(name)
        if callable(f) and getattr(f, "__module__", "").startswith("parseq.operators"):
            return f
    return None
