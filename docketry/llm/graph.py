"""Connected components, by the library's alternating large-star and small-star steps."""

from ..operators.graph import components

__all__ = ["components"]
