"""Every registered query of the response-modelling library, with its SQL."""

from __future__ import annotations


def _modules():
    from .plans import experiments, masks, metrics, models, rows, sources, stats, timeseries

    return [sources, masks, timeseries, rows, metrics, stats, models, experiments]


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLE_SQL)
    return out


def entry(spark, sf_dir):
    """A held-out subject from end to end: shared items, connectivity, shared space, encoder,
    zero-shot alignment, predicted channels and their scores."""
    return queries()["EXP1_zero_shot"](spark, sf_dir)
