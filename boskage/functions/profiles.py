"""Decay functions and weights as Column expressions; all are closed-form and compiled by the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boskage.config import CLASS_SPREAD, COMPOSITION, SOURCE_PROFILES


def gaussian(x: Column, mean: float, std: float) -> Column:
    z = (x - mean) / std
    return F.exp(-0.5 * z * z)


def step(x: Column, start: float, end: float) -> Column:
    return F.when(x.between(start, end), 1.0).otherwise(0.0)


def offset_gaussian(x: Column, offset: float, decrease: float) -> Column:
    """1 up to the offset, then a Gaussian of half the given width."""
    z = x - offset
    return F.when(x <= offset, 1.0).otherwise(F.exp(-(z * z) / (2 * (decrease / 2) ** 2)))


def sigmoid(x: Column, x0: float = 0.0, k: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - x0)))


def exponential_decay(x: Column, x0: float, k: float) -> Column:
    return F.exp(-k * (x - x0))


def half_life(x: Column, h: float) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * x / h)


def weighting_function(x: Column, x0: float, k: float) -> Column:
    """1 up to x0, then halved every k."""
    return F.when(x <= x0, 1.0).otherwise(F.exp(-F.ln(F.lit(2.0)) * (x - x0) / k))


def constant(x: Column, value: float) -> Column:
    return F.lit(float(value))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "gaussian": gaussian,
    "step": step,
    "offset_gaussian": offset_gaussian,
    "exponential_decay": exponential_decay,
    "weighting_function": weighting_function,
}


def register(name: str, function: Callable[..., Column]) -> None:
    """Makes a decay function known by name."""
    FUNCTIONS[name] = function


def weighted(parts: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(w)) * c for w, c in parts))


def profile(x: Column, dataset: str, cls: str, kind: str) -> Column:
    """Half the source's decay, half the decay of the final classes its class is composed of."""
    name, args = SOURCE_PROFILES[dataset][kind]
    spread = 0 if kind == "spatial" else 1
    classes = weighted([(share, gaussian(x, 0, CLASS_SPREAD[c][spread])) for c, share in COMPOSITION[dataset][cls].items()])
    return (FUNCTIONS[name](x, **args) + classes) / 2


_PARAMETERS = "map<string,struct<name:string,p:double,q:double,mix:array<struct<share:double,std:double>>>>"


def _table(kind: str) -> Column:
    """A constant map from source and class to the parameters of their profile, folded once by the optimizer."""
    spread = 0 if kind == "spatial" else 1
    entries = {}
    for d, classes in COMPOSITION.items():
        name, args = SOURCE_PROFILES[d][kind]
        p, q = (float(v) for v in args.values())
        for c, mix in classes.items():
            entries[f"{d}|{c}"] = {"name": name, "p": p, "q": q, "mix": [{"share": s, "std": float(CLASS_SPREAD[f][spread])} for f, s in mix.items()]}
    return F.from_json(F.lit(json.dumps(entries)), _PARAMETERS)


def profile_of(x: Column, dataset: Column, cls: Column, kind: str) -> Column:
    """The profile that a row's source and class select; 0 for combinations without one.

    The parameters come from a literal map, so the expression stays small however many
    sources and classes there are.
    """

    def value(m: Column) -> Column:
        name, p, q = m["name"], m["p"], m["q"]
        z = x - p
        own = (
            F.when(name == "step", F.when(x.between(p, q), 1.0).otherwise(0.0))
            .when(name == "gaussian", F.exp(-0.5 * (z / q) * (z / q)))
            .when(name == "offset_gaussian", F.when(x <= p, 1.0).otherwise(F.exp(-(z * z) / (q * q / 2))))
            .when(name == "weighting_function", F.when(x <= p, 1.0).otherwise(F.exp(-F.ln(F.lit(2.0)) * z / q)))
        )
        mix = F.aggregate(m["mix"], F.lit(0.0), lambda acc, s: acc + s["share"] * F.exp(-0.5 * (x / s["std"]) * (x / s["std"])))
        return (own + mix) / 2

    # one lookup per row, bound to a variable so the map appears once in the expression
    return F.coalesce(F.transform(F.array(_table(kind)[F.concat(dataset, F.lit("|"), cls)]), value)[0], F.lit(0.0))


def pair_weight(x: Column, dataset_a: Column, class_a: Column, dataset_b: Column, class_b: Column, kind: str) -> Column:
    return (profile_of(x, dataset_a, class_a, kind) + profile_of(x, dataset_b, class_b, kind)) / 2


def edge_weight(distance: Column, days: Column, r_a: Column, r_b: Column, same: Column, length_m: float, length_days: float, same_source: float, radius: float) -> Column:
    """Decay with distance and time times the mean reliability; pairs of one source count less."""
    w = F.exp(-distance / length_m) * F.exp(-days / length_days) * (r_a + r_b) / 2 * F.when(same, same_source).otherwise(1.0)
    return F.when(distance > radius, 0.0).otherwise(w)


def linear_spatial(km: Column) -> Column:
    return F.when(km <= 1, 1.0).otherwise(1 - (km - 1) / 9)


def linear_temporal(years: Column) -> Column:
    return F.when(years <= 3, 1 - years / 12).otherwise(0.75 * (1 - (years - 3) / 3))


def clipped(x: Column) -> Column:
    """NaN and null to 0, then into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def combined(parts: list[Column], weights: tuple[float, ...]) -> Column:
    """Weighted mean of similarities."""
    return weighted(list(zip(weights, parts))) / float(sum(weights))


def map_lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(pairs[key], F.lit(default)) if default is not None else pairs[key]


def composition_rows() -> list[tuple[str, str, str, float]]:
    return [(d, c, f, float(s)) for d, classes in COMPOSITION.items() for c, mix in classes.items() for f, s in mix.items()]


def class_similarity_rows() -> list[tuple[str, str, str, str, float]]:
    """Similarity of every pair of (source, class): 1 for itself, else the summed mean share of the final classes they have in common."""
    keys = [(d, c) for d, classes in COMPOSITION.items() for c in classes]
    rows = []
    for d1, c1 in keys:
        for d2, c2 in keys:
            a, b = COMPOSITION[d1][c1], COMPOSITION[d2][c2]
            s = 1.0 if (d1, c1) == (d2, c2) else sum((a[f] + b[f]) / 2 for f in sorted(a.keys() & b.keys()))
            rows.append((d1, c1, d2, c2, round(float(s), 9)))
    return rows
