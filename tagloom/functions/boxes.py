"""Box arithmetic on struct columns with fields x0, y0, x1, y1."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
MARGIN = 0.06
HEAD_LIMIT = 0.15
BODY_LIMIT = 0.5
MAX_RATIO = 3.0
MIN_SIDE = 384
NMS_IOU = 0.5
# ---- end of fixed values ----


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def of(prefix: str = "") -> Column:
    return box(*[F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")])


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - b["x0"]) * F.greatest(zero, b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    return area(box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])))


def inside(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``."""
    return overlap(a, b) / F.greatest(area(a), F.lit(1e-9))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return both / (area(a) + area(b) - both + F.lit(1e-9))


def short_side(b: Column) -> Column:
    return F.bround(F.least(b["x1"] - b["x0"], b["y1"] - b["y0"])).cast("long")


def expand(b: Column, width: Column, height: Column) -> Column:
    """A margin on every side, aspect brought into 1:2 .. 2:1 by padding the short side, clipped to the frame."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    wide, tall = w * (1 + 2 * MARGIN), h * (1 + 2 * MARGIN)
    pad_x = F.when(tall > 2 * wide, (tall / 2 - wide) / 2).otherwise(0.0)
    pad_y = F.when((tall <= 2 * wide) & (wide > 2 * tall), (wide / 2 - tall) / 2).otherwise(0.0)
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x0"] - w * MARGIN - pad_x), F.greatest(zero, b["y0"] - h * MARGIN - pad_y),
               F.least(width, b["x1"] + w * MARGIN + pad_x), F.least(height, b["y1"] + h * MARGIN + pad_y))


def side(keep: Column, other: Column) -> Column:
    """Which edge of a crop must move so that ``other`` stays out, seen from ``keep``: right, left, bottom or top."""
    mid = lambda b, a, c: (b[a] + b[c]) / 2
    one = F.lit(1.0)
    gap_x, gap_y = mid(other, "x0", "x1") - mid(keep, "x0", "x1"), mid(other, "y0", "y1") - mid(keep, "y0", "y1")
    dx = F.abs(gap_x) / F.greatest(one, (keep["x1"] - keep["x0"] + other["x1"] - other["x0"]) / 2)
    dy = F.abs(gap_y) / F.greatest(one, (keep["y1"] - keep["y0"] + other["y1"] - other["y0"]) / 2)
    return F.when(dx >= dy, F.when(gap_x > 0, "right").otherwise("left")).otherwise(F.when(gap_y > 0, "bottom").otherwise("top"))
