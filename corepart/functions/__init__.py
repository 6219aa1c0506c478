"""Column functions: keyed draws and vector arithmetic."""

from corepart.functions.draw import draw, draw_int, fast_normal
from corepart.functions.vectors import dot, rounded

__all__ = ["draw", "draw_int", "fast_normal", "dot", "rounded"]
