"""Language identification by compression.

Every language gets a zstandard raw-content dictionary of labelled text. A text belongs to the language whose dictionary
compresses it to the fewest bytes; where the margin to the next language is narrow the text is rejected.

Defined cases: null text or text without a letter: ``und``, score 0, rejected. Equal sizes: the language with more labelled
documents, then the smaller name; rejected as any margin of at most NARROW. No labelled row at all: every text is ``und``. Long texts are compressed whole,
in pieces of PIECE bytes, as a dictionary only helps near its end; sizes of pieces add up. Repeated rows get equal answers.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches

SAMPLES = 128  # labelled texts behind one dictionary, at most: the documented bound of what is learned from
SAMPLE_CHARS = 1000  # code points of each of them
LEVEL = 5
TIE_LEVEL = 12  # ties are compressed again, harder, and behind CARRIER
CARRIER = bytes(64)  # zstandard stores what is very short as it is; behind a few equal bytes it is compressed, too
PIECE = 2048
NARROW = 0.03  # relative margin up to which a text is rejected: right answers rarely have so little, wrong ones and texts of languages not learned mostly no more
_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def normal(text: str | None) -> bytes:
    """Lower-case words, whatever stands between them as one space."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def dictionaries(labelled: DataFrame) -> list[tuple[str, int, bytes]]:
    """(language, labelled rows, dictionary text) of a frame with ``text`` and ``lang``, most frequent language first.

    A dictionary is made of the SAMPLES texts with the smallest hash; copies count once. Only SAMPLES keys a language, then
    SAMPLES slices of SAMPLE_CHARS code points a language, reach the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}{2}")).select("lang", "text", F.xxhash64("text").alias("h"))
    keys = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    first = Window.partitionBy("lang").orderBy("h")
    picked = keys.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLES).select("lang", "h")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    slices = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("t")) \
        .groupBy("lang", "h").agg(F.min("t").alias("t"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in slices.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["t"]))
    order = sorted(found, key=lambda name: (-sizes[name], name))
    return [(name, sizes[name], b" ".join(normal(t) for _, t in sorted(found[name]))) for name in order]


class Classifier:
    """Built once in each task from the dictionaries."""

    def __init__(self, learned: list[tuple[str, int, bytes]]):
        self.names = [name for name, _, _ in learned]
        self.levels = []
        for level in (LEVEL, TIE_LEVEL):
            made = []
            for _, _, data in learned:
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.levels.append(made)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, relative margin)"""
        data = normal(text)
        if not data or not self.names or not _LETTER.search(text):
            return "und", 0.0, 0.0
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        for made, before in zip(self.levels, (b"", CARRIER)):
            sizes = [sum(len(c.compress(before + p)) for p in pieces) for c in made]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            others = sorted(sizes[:best] + sizes[best + 1:])
            if not others:
                return self.names[best], 1.0, 1.0
            if others[0] > sizes[best]:
                break
        score = 1 / (1 + sum(math.exp(-min(50.0, (s - sizes[best]) / 2)) for s in others))
        return self.names[best], score, (others[0] - sizes[best]) / others[0]


def identify(docs: DataFrame, learned: list[tuple[str, int, bytes]], text: str = "text", narrow: float = NARROW) -> DataFrame:
    """All rows of ``docs`` with struct ``language``: name, score, margin, accepted. Any other columns pass untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(learned)
        for batch in batches:
            got = [classify(t) for t in batch.column("_row").field(text).to_pylist()]
            found = pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()),
                 pa.array([g[0] != "und" and g[2] > narrow for g in got], pa.bool_())], ["name", "score", "margin", "accepted"])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), found], ["row", "language"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    schema = f"row {packed.schema['_row'].dataType.simpleString()}, language struct<name:string,score:double,margin:double,accepted:boolean>"
    return in_batches(packed, run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found by more than a narrow margin; learned from their own labels."""
    found = identify(docs, dictionaries(docs))
    return found.where("language.accepted").select(*[F.col(f"row.`{c}`") for c in docs.columns])
