"""Names of the interval columns."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple


class IntervalCols(NamedTuple):
    chrom: str = "chrom"
    start: str = "start"
    end: str = "end"


_default: ContextVar[IntervalCols] = ContextVar("interval_cols", default=IntervalCols())


def interval_cols(cols=None) -> IntervalCols:
    """The given triple, or the default one."""
    return _default.get() if cols is None else IntervalCols(*cols)


class update_default_colnames:
    """Set the default names, for good or (as a context manager) for a block; takes three names or a dict with any of chrom, start, end."""

    def __init__(self, names):
        new = _default.get()._replace(**names) if isinstance(names, dict) else IntervalCols(*names)
        self._token = _default.set(new)

    def __enter__(self):
        return _default.get()

    def __exit__(self, *exc):
        _default.reset(self._token)


@contextmanager
def colnames(names):
    with update_default_colnames(names) as c:
        yield c
