"""The registered queries scan what the operators and the reference scan."""

import inspect

import pytest

from scintlake.operators import locate as L
from scintlake.operators import track_scan as S
from scintlake.plans import load

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def arguments(spark, monkeypatch, module, operator, name):
    """What the query ``name`` calls ``operator`` with."""
    signature = inspect.signature(getattr(module, operator))

    def spy(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        raise Seen(bound.arguments)
    monkeypatch.setattr(module, operator, spy)
    with pytest.raises(Seen) as seen:
        load().QUERIES[name](spark, SF)
    return seen.value.args[0]


def test_track_scan_has_all_points(spark, monkeypatch):
    assert arguments(spark, monkeypatch, S, "track_scan", "track_scan")["n_points"] == 150


def test_grid_likelihood_holds_the_default_grid(spark, monkeypatch):
    p = {k: v.default for k, v in inspect.signature(L.grid_likelihood).parameters.items()}
    got = arguments(spark, monkeypatch, L, "grid_likelihood", "grid_likelihood")
    assert (got["spacing"], got["t_spacing"]) == (p["spacing"], p["t_spacing"]) == (20.0, 1.0)
    # the default's points, and the reach of 50 cm and 10 ns
    assert got["half"] >= p["half"] and got["t_steps"] >= p["t_steps"]
    assert got["half"] * got["spacing"] >= 50 and got["t_steps"] * got["t_spacing"] >= 10


def test_tune_speed_has_half_steps(spark, monkeypatch):
    assert arguments(spark, monkeypatch, L, "tune_speed", "tune_speed")["speeds"] == [16, 16.5, 17, 17.5, 18, 18.5, 19, 19.5, 20]
