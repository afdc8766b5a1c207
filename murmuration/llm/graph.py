"""Connected components of an undirected link table."""

from murmuration.operators.components import star_components as components

__all__ = ["components"]
