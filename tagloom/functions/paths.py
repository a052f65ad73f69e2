"""Paths, file names and slugs."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values ----
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".tif", ".tiff", ".avif", ".jfif"]
CAPTION_EXTENSIONS = [".txt", ".caption"]
# ---- end of fixed values ----


def unify(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    return F.filter(F.split(unify(path), "/"), lambda p: (p != "") & (p != "."))


def base_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def suffix(path: Column) -> Column:
    """Last extension in lower case, empty for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def stem_key(path: Column) -> Column:
    """Full path without its last extension, lower case: what an image and its caption share."""
    return F.lower(stem(F.array_join(F.filter(F.split(unify(path), "/"), lambda p: p != "."), "/")))


def parent(path: Column) -> Column:
    p = parts(path)
    return F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")


def hidden(path: Column) -> Column:
    return F.exists(parts(path), lambda p: (F.startswith(p, F.lit(".")) & (p != "..")) | (p == "__MACOSX"))


def is_image(path: Column) -> Column:
    return suffix(path).isin(IMAGE_EXTENSIONS) & ~hidden(path)


def is_wanted(path: Column) -> Column:
    return suffix(path).isin(IMAGE_EXTENSIONS + CAPTION_EXTENSIONS) & ~hidden(path)


def normalise(path: Column) -> tuple[Column, Column]:
    """(path inside a share, error): slashes unified, empty and dot parts dropped, parent steps refused."""
    p = parts(F.coalesce(path, F.lit("")))
    bad = F.exists(p, lambda x: x == "..")
    return F.when(~bad, F.array_join(p, "/")), F.when(bad, "bad path")


def host_and_share(text: Column, share: Column) -> tuple[Column, Column]:
    """Split a pasted UNC path or smb:// address; a share given separately wins."""
    t = F.trim(text)
    pasted = F.startswith(t, F.lit("\\\\")) | F.startswith(t, F.lit("//")) | t.rlike("(?i)^smb://")
    p = F.filter(F.split(unify(F.replace(t, F.lit("smb://"), F.lit(""))), "/"), lambda x: x != "")
    host = F.when(pasted, F.coalesce(F.get(p, F.lit(0)), F.lit(""))).otherwise(t)
    found = F.when(F.coalesce(share, F.lit("")) != "", share).when(pasted, F.get(p, F.lit(1)))
    return host, F.regexp_replace(found, r"^[/\\]+|[/\\]+$", "")


def _folded(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.arrow_udf(StringType())
def ascii_fold(s: pa.Array) -> pa.Array:
    """Compatibility decomposition without its non-ASCII rest; Spark has no built-in for it. One text at a time is a Python string."""
    return pa.array((_folded(t.as_py()) for t in s), pa.string())


def slugify(text: Column, fallback: Column | str = "") -> Column:
    bare = F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 80), F.lit("")), F.lit(fallback) if isinstance(fallback, str) else fallback)


def slug_unicode(text: Column, fallback: str = "lora") -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(bare, "_+", "_"), 1, 60), F.lit("")), F.lit(fallback))


def folder_part(text: Column) -> Column:
    return F.regexp_replace(text, r"[/\\]+", "_")
