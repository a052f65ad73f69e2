"""Record filters and planning columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import glob_regex, split_text

LOSSY = ["jpg", "jpeg"]
TOO_SMALL = 384  # fixed value


def _hit(pattern: str, text: Column) -> Column:
    if "*" in pattern:
        return text.rlike(glob_regex(pattern))
    return F.contains(text, F.lit(pattern))


def search(query: str, tags: Column, nl: Column, name: Column) -> Column:
    """Every comma-separated pattern must hit a tag, the description or the file name."""
    test = F.lit(True)
    for p in (x.lower() for x in split_text(query)):
        test &= (F.exists(tags, lambda t: _hit(p, F.lower(t))) | _hit(p, F.lower(F.coalesce(nl, F.lit(""))))
                 | _hit(p, F.lower(name)))
    return test


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def short_side(width: Column, height: Column, orig_w: Column | None = None, orig_h: Column | None = None) -> Column:
    w = width if orig_w is None else F.coalesce(orig_w, width)
    h = height if orig_h is None else F.coalesce(orig_h, height)
    return F.least(F.coalesce(w, F.lit(0)), F.coalesce(h, F.lit(0)))


def upscale_plan(short: Column, lossy: Column, min_side: int, noise: str = "auto", scale: str = "auto") -> tuple[Column, Column]:
    """(noise level, factor); -1 means no denoising."""
    level = F.when(lossy, 1).otherwise(-1) if noise == "auto" else F.lit(-1 if noise == "none" else int(noise))
    factor = F.when(short * 2 >= min_side, 2).otherwise(4) if scale == "auto" else F.lit(int(scale))
    return level, factor


def restored_status(status: Column, tags: Column, nl: Column) -> Column:
    """Interrupted records go back to done if they hold anything, else to pending."""
    idle = F.when((F.size(tags) > 0) | (nl != ""), "done").otherwise("pending")
    return F.when(status.isin("queued", "processing"), idle).otherwise(status)


def compare_and_set(status: Column, allowed: list[str], new: str) -> Column:
    return F.when(status.isin(allowed), F.lit(new)).otherwise(status)
