"""The registered layout runs all steps."""

import inspect

from strandex import queries
from strandex.operators import network


class Atoms:
    def persist(self):
        return self


def test_layout_query_runs_the_default_steps(monkeypatch):
    steps, whole = [], inspect.signature(network.layouts)

    def record(*args, **named):
        bound = whole.bind(*args, **named)
        bound.apply_defaults()
        steps.append(list(bound.arguments.values())[1])

    monkeypatch.setattr(network, "layouts", record)
    monkeypatch.setattr(network, "edges", lambda found, a: a)
    monkeypatch.setattr(queries.interactions, "detect", lambda a, *rest: a)
    monkeypatch.setattr(queries.pseudo, "atoms", lambda spark, sf_dir: Atoms())
    queries.QUERIES["rin_layout"](None, "")
    assert steps == [300]
