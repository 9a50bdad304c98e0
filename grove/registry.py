"""All operators by name."""

from __future__ import annotations

from collections.abc import Callable

from grove.functions import columns
from grove.operators import checks, counts, marks, orders, pairs, representation, sampling, traits, transforms
from grove.sources import newick, spop, trees


def _public(module) -> dict[str, Callable]:
    return {
        n: f
        for n, f in vars(module).items()
        if callable(f) and not n.startswith("_") and getattr(f, "__module__", "").startswith(module.__name__) and not isinstance(f, type)
    }


OPERATORS: dict[str, Callable] = {}
for _module in (columns, marks, counts, checks, orders, pairs, transforms, sampling, traits, representation, newick, spop, trees):
    OPERATORS.update(_public(_module))
OPERATORS.update({n: getattr(sampling, n) for n in vars(sampling) if n.startswith("downsample_tips")})
