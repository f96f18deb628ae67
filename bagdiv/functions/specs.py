"""Divergence specs: names, parameters and the constants of their estimators."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

#: Names of divergences.
PLAIN = {"linear", "kl", "kl_raw", "bc", "hellinger", "l2", "js-core", "js", "jensen-shannon", "js_clamp"}
WITH_ALPHA = {"alpha", "renyi", "tsallis"}
#: Below this a power mean counts as this in a logarithm.
FLOOR = 2.0**-52


#: Divergences of the user: what they are made of, and the expression over it.
CUSTOM: dict[str, tuple[tuple[str, ...], Callable]] = {}


def register(name: str, bases: list[str], value: Callable) -> None:
    """A divergence of one's own, by name in specs from then on: value takes the columns of the bases ("linear", "kl",
    "js-core" or "alpha:<a>", each between p and q) and gives the column of the divergence."""
    if name in PLAIN | WITH_ALPHA | set(CUSTOM) or ":" in name:
        raise ValueError(f"{name!r} can't be the name of another divergence")
    own = tuple(f"alpha:{float(b[6:])}" if b.startswith("alpha:") else b for b in bases)
    if not own or any(b not in ("linear", "kl", "js-core") and not b.startswith("alpha:") for b in own):
        raise ValueError(f"no bases of a divergence: {bases}")
    CUSTOM[name] = (own, value)


@dataclass(frozen=True)
class Spec:
    name: str
    alpha: float | None = None

    def __str__(self) -> str:
        return self.name if self.alpha is None else f"{self.name}:{self.alpha}"

    @property
    def bases(self) -> frozenset[str]:
        """Base statistics that it is made of."""
        if self.name in CUSTOM:
            return frozenset(CUSTOM[self.name][0])
        if self.name in ("bc", "hellinger"):
            return frozenset({"alpha:0.5"})
        if self.name in WITH_ALPHA:
            return frozenset({f"alpha:{self.alpha}"})
        if self.name == "l2":
            return frozenset({"linear"})
        return frozenset({"kl" if self.name.startswith("kl") else "js-core" if self.name.startswith(("js", "jensen")) else self.name})

    @property
    def transposed(self) -> bool:
        return self.name in ("l2", "js", "jensen-shannon", "js_clamp")


def parse(specs: list[str]) -> list[Spec]:
    """Specs `name` or `name:alpha`; unknown names, a missing or needless alpha and repeats are errors."""
    out = []
    for text in specs:
        name, _, alpha = text.partition(":")
        if name not in PLAIN | WITH_ALPHA | set(CUSTOM):
            raise ValueError(f"unknown divergence {text!r}")
        if bool(alpha) != (name in WITH_ALPHA):
            raise ValueError(f"{name} {'needs an' if name in WITH_ALPHA else 'takes no'} alpha")
        out.append(Spec(name, float(alpha) if alpha else None))
    if len(set(out)) < len(out):
        raise ValueError("a divergence is given twice")
    return out


def min_dist(dim: int) -> float:
    return min(1e-2, 1e-100 ** (1.0 / dim))


def psi(n: int) -> float:
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))


def _gamma_ratio(over: list[float], under: list[float]) -> float:
    if any(x <= 0 and x == int(x) for x in under):
        return 0.0
    return math.exp(sum(map(math.lgamma, over)) - sum(map(math.lgamma, under)))


def density_constant(k: int, dim: int) -> float:
    """(k - 1) over the volume of the unit ball."""
    return (k - 1) * math.exp(math.lgamma(dim / 2 + 1) - dim / 2 * math.log(math.pi))


def alpha_constant(k: int, a: float) -> float:
    return _gamma_ratio([k, k], [k + 1 - a, k - 1 + a])
