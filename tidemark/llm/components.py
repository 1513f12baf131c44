"""Connected components of links between rows: the library's general helper."""

from ..operators.components import connected

__all__ = ["connected"]
