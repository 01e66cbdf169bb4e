"""Three logics of the assertion language over nullable booleans, and its quantifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def implies(a: Column, b: Column) -> Column:
    """Local rules: false premise passes; an unknown premise leaves all unknown, whatever the conclusion."""
    return F.when(a, b).when(~a, F.lit(True))


def implies_kleene(a: Column, b: Column) -> Column:
    """Linkage rules: not a or b."""
    return ~a | b


def disjoint(*terms: Column) -> Column:
    """No two of the terms hold together."""
    out = F.lit(True)
    for i, a in enumerate(terms):
        for b in terms[i + 1 :]:
            out = out & ~(a & b)
    return out


def fails(p: Column) -> Column:
    """A violation is an explicit failure; unknown is none."""
    return p.eqNullSafe(F.lit(False))


def closed(p: Column) -> Column:
    """Group rules: what stays unavailable fails."""
    return F.coalesce(p, F.lit(False))


def any_of(p: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(p, F.lit(False))), F.lit(False))


def none_of(p: Column) -> Column:
    return ~any_of(p)


def all_defs(p: Column) -> Column:
    """All, over definitions: every item has to pass; an unknown one doesn't. Nothing passes."""
    return F.count_if(F.coalesce(p, F.lit(False))) == F.count(F.lit(1))


def all_refs(p: Column) -> Column:
    """All, over references: no item fails; unknown ones are passed over."""
    return F.count_if(p.eqNullSafe(F.lit(False))) == 0
