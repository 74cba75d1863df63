"""Errors that are raised before a plan runs, named by what is wrong."""


class RowloomError(ValueError):
    """Any error of this library."""


class TypeMismatch(RowloomError):
    """Operands of types that an operation can't combine."""


class BadIndex(RowloomError):
    """A position outside the frame, or one that would leave a gap."""


class BadName(RowloomError):
    """A column that isn't there, is there twice, or is named badly."""


class BadValue(RowloomError):
    """A value outside its type's domain, or an argument outside its range."""


class ShapeMismatch(RowloomError):
    """Columns of different lengths, rows of different widths."""
