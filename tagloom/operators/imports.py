"""From a file listing to records."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.tags import canon_text, collapse_sql, each, only, quoted, strip_sql, tidy
from .scans import Machine, scan


def parse_sidecar(text: Column, trigger: str = "") -> tuple[Column, Column]:
    """(tags, sentences) of a caption file: pieces of more than five words, or ending in a full stop, are sentences."""
    pieces = only(each(F.split(text, "[,\n]"), "x -> " + strip_sql("x")), "x -> x <> ''")
    sentence = f"(size(split({collapse_sql('x')}, ' ')) > 5 OR endswith(x, '.'))"
    tags = only(tidy(only(pieces, f"x -> NOT {sentence}")), f"x -> lower(x) <> {quoted(canon_text(trigger).lower())}")
    return tags, F.array_join(only(pieces, f"x -> {sentence}"), ", ")


def pair_sidecars(files: DataFrame, by: list[str]) -> DataFrame:
    """Every image with the caption file of the same path stem; the last listed caption wins."""
    f = files.where(P.is_wanted(F.col("path"))).withColumn("stem_key", P.stem_key(F.col("path")))
    text = f.where(P.suffix(F.col("path")).isin(P.CAPTION_EXTENSIONS)).groupBy(*by, "stem_key").agg(
        F.max_by(F.struct("path", "content"), "ord").alias("s"))
    images = f.where(P.suffix(F.col("path")).isin(P.IMAGE_EXTENSIONS))
    return images.join(text, [*by, "stem_key"], "left").select(
        *by, "ord", "path", "content", F.col("s.path").alias("caption_path"), F.col("s.content").alias("caption"))


def import_batch(files: DataFrame, present: DataFrame, by: list[str], trigger: str = "", allow_duplicates: bool = False) -> DataFrame:
    """Paired files with their fate: added, or skipped with a reason. ``present``: content hashes already stored."""
    p = pair_sidecars(files, by).withColumn("sha1", F.sha1("content"))
    tags, nl = parse_sidecar(F.coalesce("caption", F.lit("")), trigger)
    out = p.select(*by, "ord", P.base_name(F.col("path")).alias("name"), "sha1", tags.alias("tags"), nl.alias("nl"))
    if allow_duplicates:
        return out.withColumn("reason", F.lit(None).cast("string"))
    first = out.groupBy(*by, "sha1").agg(F.min("ord").alias("first"))
    known = present.select("sha1", F.lit(True).alias("known")).distinct()
    marked = out.join(first, [*by, "sha1"]).join(known, "sha1", "left")
    dup = F.col("known").isNotNull() | (F.col("ord") != F.col("first"))
    return marked.withColumn("reason", F.when(dup, "duplicate")).drop("first", "known")


def collect_sources(items: list[DataFrame]) -> DataFrame:
    """Union of sources, each (root, path, ord); the first listing of a file wins: the earlier source, then the smaller ord."""
    u = items[0].withColumn("source", F.lit(0))
    for k, i in enumerate(items[1:], 1):
        u = u.unionByName(i.withColumn("source", F.lit(k)))
    return u.groupBy("root", "path").agg(F.min(F.struct("source", "ord")).alias("at")).select("root", "path", "at.source", "at.ord")


def url_entries(urls: DataFrame, url: str = "url") -> DataFrame:
    """File name per address (``.png`` if it has no extension); other schemes are rejected with a reason."""
    u = F.col(url)
    ok = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1).rlike("(?i)^https?$")
    path = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    name = F.coalesce(F.nullif(P.base_name(path), F.lit("")), F.lit("image"))
    named = F.when(P.suffix(name) == "", F.concat(name, F.lit(".png"))).otherwise(name)
    return urls.withColumn("name", F.when(ok, named)).withColumn("reason", F.when(~ok, "http only"))


def packing(files: int, size: float) -> Machine:
    """Greedy batches; the state is the files, bytes and number of the open batch. Where a batch starts decides all that follows, and the open batch
    of an earlier row closes within ``files`` rows, so a stretch of rows is told by what becomes of those few possible starts."""

    def step(state, f: int, s: int):
        n, total, batch = state or (0, 0, 0)
        if state and (n >= files or total > size):
            n, total, batch = 0, 0, batch + 1
        return (n + f, total + s, batch), (batch,)

    def summary(rows: list[tuple]):
        count, nbytes = (np.concatenate([[0], np.cumsum([r[k] for r in rows], dtype=np.int64)]) for k in (0, 1))
        onward = np.minimum(np.searchsorted(count, count + files, "left"), np.searchsorted(nbytes, nbytes + size, "right"))  # next start after a start
        last, closed = np.arange(len(rows) + 1), np.zeros(len(rows) + 1, np.int64)
        for p in range(len(rows) - 1, -1, -1):
            if onward[p] < len(rows):
                last[p], closed[p] = last[onward[p]], closed[onward[p]] + 1
        k = min(files, len(rows)) + 1
        return count[:k], nbytes[:k], count[-1] - count[last[:k]], nbytes[-1] - nbytes[last[:k]], closed[:k], (len(rows), count[-1], nbytes[-1])

    def advance(told, state):
        count, nbytes, n_out, size_out, closed, (rows, n_all, size_all) = told
        n, total, batch = state or (0, 0, 0)
        start, more = 0, 0
        if state:
            shut = np.flatnonzero((n + count >= files) | (total + nbytes > size))
            if not len(shut) or shut[0] >= rows:
                return n + int(n_all), total + int(size_all), batch
            start, more = shut[0], 1
        return int(n_out[start]), int(size_out[start]), batch + more + int(closed[start])

    return Machine(step, summary, advance)


def pack_batches(files: DataFrame, count: int = 40, size: float = 80e6) -> DataFrame:
    """Upload batches per root in stem order: a batch with 40 files or over 80 MB closes at the next stem.

    Files are first reduced to one row per stem. Greedy packing is a scan, and a root may lie over any number of tasks.
    """
    stems = files.withColumn("stem_key", P.stem(F.col("path"))).groupBy("root", "stem_key").agg(
        F.count("*").alias("files"), F.sum("size").alias("size"))
    return scan(stems, ["root"], ["stem_key"], ["files", "size"], packing(count, size), {"batch": ("long", pa.int64())})
