"""Parameters, reliabilities, class compositions and decay profiles.

Everything here must keep its value for results to agree with published ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Reliability of each source in the pairwise graph.
RELIABILITY = {"firepolygons": 1.0, "hm": 0.9, "forms": 0.8, "senfseidl": 0.7, "cdi": 0.5}

# Overall accuracy, search buffer in metres and kind of join of each source.
ACCURACY = {"hm": 1.0, "nfi": 1.0, "senfseidl": 0.75, "bdiff": 0.25, "cdi": 0.5, "forms": 0.75, "firepolygons": 1.0}
BUFFER_M = {"hm": 5000, "nfi": 7000, "senfseidl": 100, "bdiff": None, "cdi": 100, "forms": 100, "firepolygons": 100}
JOIN_KIND = {"hm": "point", "nfi": "point", "senfseidl": "point", "bdiff": "polygon", "firepolygons": "polygon", "cdi": "polygon", "forms": "point"}
TEMPORAL_BUFFER_YEARS = 2

FINAL_CLASSES = ("fire", "storm", "biotic-dieback", "biotic-mortality", "drought-dieback", "anthropogenic")

# Share of each final class in each class of each source.
COMPOSITION = {
    "senfseidl": {
        "Storm,Biotic": {"biotic-mortality": 0.12, "storm": 0.35, "biotic-dieback": 0.35, "drought-dieback": 0.12, "fire": 0.02, "anthropogenic": 0.04},
        "Fire": {"fire": 0.87, "storm": 0.1, "biotic-dieback": 0.01, "drought-dieback": 0.01, "anthropogenic": 0.01},
        "Other": {"storm": 0.06, "fire": 0.03, "biotic-mortality": 0.13, "biotic-dieback": 0.13, "drought-dieback": 0.13, "anthropogenic": 0.52},
    },
    "dfde": {
        "Biotic": {"biotic-mortality": 0.25, "biotic-dieback": 0.75},
        "Storm": {"storm": 1.0},
        "Fire": {"fire": 1.0},
        "Drought": {"drought-dieback": 1.0},
        "Other": {"anthropogenic": 1.0},
    },
    "nfi": {
        "Mortality": {"biotic-mortality": 1.0},
        "Storm": {"storm": 1.0},
        "Fire": {"fire": 1.0},
        "Other": {"anthropogenic": 0.33, "drought-dieback": 0.33, "biotic-dieback": 0.33},
        "Anthropogenic": {"anthropogenic": 1.0},
    },
    "hm": {
        "Biotic-mortality": {"biotic-mortality": 1.0},
        "Biotic-dieback": {"biotic-dieback": 1.0},
        "Storm": {"storm": 1.0},
        "Fire": {"fire": 1.0},
        "Drought-dieback": {"drought-dieback": 1.0},
        "Other": {"anthropogenic": 1.0},
    },
    "cdi": {"drought": {"drought-dieback": 1.0}},
    "forms": {"clear-cut": {"anthropogenic": 1.0}},
    "bdiff": {"Fire": {"fire": 1.0}},
    "firepolygons": {"Fire": {"fire": 1.0}},
}

# Decay of each source with distance (metres) and time (days).
SOURCE_PROFILES = {
    "dfde": {"spatial": ("offset_gaussian", {"offset": 150, "decrease": 5000}), "temporal": ("step", {"start": 0, "end": 365})},
    "hm": {"spatial": ("offset_gaussian", {"offset": 10, "decrease": 100}), "temporal": ("step", {"start": 0, "end": 365})},
    "nfi": {"spatial": ("offset_gaussian", {"offset": 600, "decrease": 25}), "temporal": ("step", {"start": 0, "end": 1825})},
    "bdiff": {"spatial": ("weighting_function", {"x0": 500, "k": 500}), "temporal": ("gaussian", {"mean": 0, "std": 30})},
    "firepolygons": {"spatial": ("offset_gaussian", {"offset": 10, "decrease": 50}), "temporal": ("offset_gaussian", {"offset": 7, "decrease": 31})},
    "senfseidl": {"spatial": ("offset_gaussian", {"offset": 30, "decrease": 150}), "temporal": ("offset_gaussian", {"offset": 365, "decrease": 547.5})},
    "forms": {"spatial": ("offset_gaussian", {"offset": 10, "decrease": 50}), "temporal": ("step", {"start": 0, "end": 365})},
    "cdi": {"spatial": ("offset_gaussian", {"offset": 5000, "decrease": 500}), "temporal": ("offset_gaussian", {"offset": 365, "decrease": 365})},
}

# Spread of each final class in metres and days (Gaussian, mean 0).
CLASS_SPREAD = {
    "fire": (500, 1095),
    "storm": (2000, 547.5),
    "biotic-dieback": (1000, 365),
    "drought-dieback": (2500, 730),
    "biotic-mortality": (250, 1095),
    "anthropogenic": (500, 365),
}

# Weights of the similarities in the order temporal, spatial, tree, class.
SIMILARITY_WEIGHTS = {
    "equal": (0.25, 0.25, 0.25, 0.25),
    "pca": (0.23017731, 0.40759976, 0.20566699, 0.15655594),
    "eco": (2.0, 2.0, 1.0, 3.0),
}
# Weights of the edge attributes in the order ws, wt, we, wc.
EDGE_WEIGHTS = {"unit": None, "mean2": (1.0, 1.0, 0.0, 0.0), "mean4": (1.0, 1.0, 1.0, 1.0), "pca": (0.4076, 0.2302, 0.2057, 0.1566), "eco": (2.0, 1.5, 1.0, 2.0)}

# Which final classes a class of the linear method speaks for.
COMPATIBLE = {
    "Fire": ("Fire",),
    "Storm": ("Storm", "Storm,Biotic"),
    "Biotic": ("Biotic", "Storm,Biotic", "Biotic-dieback", "Biotic-mortality"),
    "Drought": ("Drought", "Drought-dieback", "drought"),
    "Anthropogenic": ("Anthropogenic", "clear-cut", "Tree-logging"),
}


def visible_classes() -> list[str]:
    """Every class whose composition holds storm or fire."""
    return sorted({c for classes in COMPOSITION.values() for c, mix in classes.items() if {"storm", "fire"} & mix.keys()})


@dataclass(frozen=True)
class Params:
    """Parameters of the pairwise graph and of the clustering inside communities."""

    length_m: float = 1000.0
    length_days: float = 180.0
    same_source: float = 0.5
    resolution: float = 1.0
    time_scale: float = 10000.0
    class_penalty: float = 500.0
    radius_m: float = 6000.0
    most_days: int = 720
    self_vote: float = 0.3
    unknown_reliability: float = 0.5
    reliability: dict = field(default_factory=lambda: dict(RELIABILITY))
    target: str = "senfseidl"
