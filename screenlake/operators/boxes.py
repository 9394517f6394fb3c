"""Algebra of pixel rectangles x0, y0, x1, y1, as Column expressions; ``a`` and ``b`` are prefixes of their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(p: str, k: str) -> Column:
    return F.col(f"{p}{k}")


def area(p: str = "") -> Column:
    return (_c(p, "x1") - _c(p, "x0")) * (_c(p, "y1") - _c(p, "y0"))


def shared(a: str, b: str) -> Column:
    """The area that two rectangles share."""
    w = F.least(_c(a, "x1"), _c(b, "x1")) - F.greatest(_c(a, "x0"), _c(b, "x0"))
    h = F.least(_c(a, "y1"), _c(b, "y1")) - F.greatest(_c(a, "y0"), _c(b, "y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str, b: str) -> Column:
    both = area(a) + area(b) - shared(a, b)
    return F.when(both > 0, shared(a, b) / both).otherwise(0.0)


def of_smaller(a: str, b: str) -> Column:
    return shared(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def covered(b: str, a: str) -> Column:
    """The share of ``b`` that ``a`` covers."""
    return shared(a, b) / F.greatest(F.lit(1), area(b))


def same(a: str, b: str, slack: int = 4) -> Column:
    out = F.lit(True)
    for k in ("x0", "y0", "x1", "y1"):
        out = out & (F.abs(_c(a, k) - _c(b, k)) <= slack)
    return out


def near(a: str, b: str, share: float = 0.15) -> Column:
    """Equal within a share of the smaller side."""
    side = F.least(*(_c(p, f"{v}1") - _c(p, f"{v}0") for p in (a, b) for v in "xy"))
    out = F.lit(True)
    for k in ("x0", "y0", "x1", "y1"):
        out = out & (F.abs(_c(a, k) - _c(b, k)) <= share * side)
    return out


def holds(a: str, x: Column, y: Column) -> Column:
    """Whether ``a`` holds the point, half open."""
    return (x >= _c(a, "x0")) & (x < _c(a, "x1")) & (y >= _c(a, "y0")) & (y < _c(a, "y1"))


def middle(p: str, v: str) -> Column:
    return (_c(p, f"{v}0") + _c(p, f"{v}1")) / 2


def _third(at: Column, words: tuple[str, str, str]) -> Column:
    return F.when(at < 1, words[0]).when(at < 2, words[1]).otherwise(words[2])


def place_on_screen(w: int, h: int, p: str = "") -> Column:
    """Where a person would say a rectangle is; 85 % of a side spans it."""
    wide, tall = (_c(p, "x1") - _c(p, "x0")) >= 0.85 * w, (_c(p, "y1") - _c(p, "y0")) >= 0.85 * h
    hw = _third(F.floor(3 * middle(p, "x") / w), ("left", "middle", "right"))
    vw = _third(F.floor(3 * middle(p, "y") / h), ("top", "middle", "bottom"))
    return (
        F.when(wide & tall, "filling the screen")
        .when(wide, F.concat(F.lit("across the "), vw))
        .when(tall, F.when(hw == "middle", "down the middle").otherwise(F.concat(F.lit("down the "), hw, F.lit(" side"))))
        .when((hw == "middle") & (vw == "middle"), "the middle of the screen")
        .when(vw == "middle", F.concat(F.lit("the "), hw, F.lit(", midway down")))
        .otherwise(F.concat_ws(" ", vw, hw))
    )


def place_in_window(p: str, win: str) -> Column:
    """Where a pane is in its window; half of the area is its main body."""
    ww, wh = F.greatest(F.lit(1), _c(win, "x1") - _c(win, "x0")), F.greatest(F.lit(1), _c(win, "y1") - _c(win, "y0"))
    hw = _third(F.floor(3 * (middle(p, "x") - _c(win, "x0")) / ww), ("left", "middle", "right"))
    vw = _third(F.floor(3 * (middle(p, "y") - _c(win, "y0")) / wh), ("top", "middle", "bottom"))
    return (
        F.when(area(p) >= 0.5 * ww * wh, "its main body")
        .when((_c(p, "x1") - _c(p, "x0")) >= 0.85 * ww, F.concat(F.lit("across its "), vw))
        .when((_c(p, "y1") - _c(p, "y0")) >= 0.85 * wh, F.when(hw == "middle", "its middle band").otherwise(F.concat(F.lit("its "), hw, F.lit(" side"))))
        .when((hw == "middle") & (vw == "middle"), "its middle")
        .when(vw == "middle", F.concat(F.lit("its "), hw, F.lit(", midway")))
        .otherwise(F.concat(F.lit("its "), vw, F.lit(" "), hw))
    )
