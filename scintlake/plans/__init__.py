"""Registered queries and the equivalent SQL."""

import importlib

MODULES = ["correlation", "calibration", "waveforms", "densities", "physics", "records", "streams"]


def load():
    """Import every query module and return the registry."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
