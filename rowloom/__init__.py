"""Ordered, typed columns and tables on Spark: lazy plans over DataFrames, with row order as a declared property."""

from .errors import RowloomError
from .plans.frame import Frame, Ref

__all__ = ["Frame", "Ref", "RowloomError"]
