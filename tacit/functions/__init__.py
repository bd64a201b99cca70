from tacit.functions.draws import draw, draw_below, normal, uniform
from tacit.functions.vectors import dot

__all__ = ["dot", "draw", "draw_below", "normal", "uniform"]
