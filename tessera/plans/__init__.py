"""End-to-end plans over the driver tables, registered by name."""

import importlib

_MODULES = [
    "decontamination",
    "retrieval",
    "reweighting",
    "mixing",
    "training_groups",
    "qa",
    "losses",
    "logging",
    "ann",
    "corpus",
    "formats",
    "library",
]


def load_all() -> None:
    for mod in _MODULES:
        importlib.import_module(f"{__name__}.{mod}")
