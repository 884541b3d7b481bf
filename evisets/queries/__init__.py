"""Registered queries: every operator on the given tables, with the equivalent SQL where one can be written."""

from __future__ import annotations

from evisets.queries import assoc, factors, locus, reports, sets, shrink, sources, traits

MODULES = (sources, sets, assoc, shrink, traits, locus, factors, reports)


def queries():
    out = {}
    for m in MODULES:
        for name, fn in m.QUERIES.items():
            assert name not in out, name
            out[name] = fn
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(m.SQL)
    return out
