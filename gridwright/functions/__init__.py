"""Column-level functions: cell semantics, row formulas and value standardisation."""

from . import cells, formulas, standardize

fx = formulas

__all__ = ["cells", "formulas", "fx", "standardize"]
