"""Operators by namespace and name, and the binding of arguments to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tessella.info import OperatorError, need

_spaces: dict[str, dict[str, Operator]] = {}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str  # int, float, data, clip, audio, func, any
    many: bool
    optional: bool


@dataclass(frozen=True)
class Operator:
    space: str
    name: str
    parameters: tuple[Parameter, ...]
    run: Callable

    def bind(self, args: tuple, kwargs: dict) -> dict:
        given = {}
        need(len(args) <= len(self.parameters), f"{self.name}: too many arguments")
        for p, a in zip(self.parameters, args, strict=False):
            given[p.name] = a
        rest = any(p.kind == "any" for p in self.parameters)
        known = {p.name for p in self.parameters}
        for k, a in kwargs.items():
            k = k[:-1] if k.endswith("_") else k
            need(k in known or rest, f"{self.name}: no parameter {k}")
            need(k not in given, f"{self.name}: {k} is given twice")
            given[k] = a
        out = {}
        for p in self.parameters:
            a = given.pop(p.name, None)
            if p.kind == "any":
                continue
            if a is None:
                need(p.optional, f"{self.name}: {p.name} is missing")
                continue
            out[p.name] = self._checked(p, a)
        return out | {k: a for k, a in given.items() if a is not None}

    def _checked(self, p: Parameter, a):
        many = isinstance(a, (list, tuple)) and not isinstance(a, str)
        items = list(a) if many else [a]
        if not p.many:
            need(len(items) == 1, f"{self.name}: {p.name} takes one value")
        for x in items:
            if p.kind == "int":
                need(isinstance(x, (int, bool)), f"{self.name}: {p.name} is an integer")
            elif p.kind == "float":
                need(isinstance(x, (int, float)), f"{self.name}: {p.name} is a number")
            elif p.kind == "data":
                need(isinstance(x, (str, bytes)), f"{self.name}: {p.name} is text")
            elif p.kind == "func":
                need(callable(x), f"{self.name}: {p.name} is a function")
            elif p.kind in ("clip", "audio"):
                from tessella.clip import Audio, Clip

                need(isinstance(x, Clip if p.kind == "clip" else Audio), f"{self.name}: {p.name} is a {p.kind}")
        return items if p.many else items[0]


def operator(space: str, name: str, signature: str) -> Callable:
    """Register a function. signature: `name:kind[]?` by spaces; [] takes several, ? may be left out."""

    def parse(part: str) -> Parameter:
        key, kind = part.split(":")
        return Parameter(key, kind.rstrip("?").removesuffix("[]"), "[]" in kind, kind.endswith("?"))

    def put(run: Callable) -> Callable:
        _spaces.setdefault(space, {})[name] = Operator(space, name, tuple(map(parse, signature.split())), run)
        return run

    return put


class Space:
    """A namespace, for calls with (`clip.std.Trim(..)`) or without a first argument."""

    def __init__(self, name: str, first=None):
        self._name, self._first = name, first

    def __getattr__(self, name: str):
        found = _spaces.get(self._name, {}).get(name)
        if found is None:
            raise AttributeError(f"{self._name}.{name}")

        def call(*args, **kwargs):
            return found.run(**found.bind(((self._first,) if self._first is not None else ()) + args, kwargs))

        return call

    def __dir__(self):
        return sorted(_spaces.get(self._name, ()))


def bound(space: str, first=None) -> Space:
    import tessella.operators.all  # noqa: F401

    if space not in _spaces:
        raise AttributeError(space)
    return Space(space, first)


def names() -> list[str]:
    import tessella.operators.all  # noqa: F401

    return sorted(f"{s}.{n}" for s, ops in _spaces.items() for n in ops)


__all__ = ["Operator", "OperatorError", "bound", "names", "operator"]
