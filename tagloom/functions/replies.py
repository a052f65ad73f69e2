"""Cleaning and parsing free-text model replies."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .tags import canon_sql, collapse, each, let, only, quoted, strip, strip_sql

# ---- fixed values: patterns ----
PREAMBLE = (
    r"(?i)^(caption\s*:\s*|here(?:'s| is) (?:a |the )?(?:caption|description)[^:]*:\s*|"
    r"(?:the|this) (?:image|picture|illustration|photo(?:graph)?) (?:shows|depicts|features|is of|presents)\s+|"
    r"in (?:the|this) (?:image|picture|illustration|photo),?\s+)"
)
REFUSAL = (
    r"(?i)^(i'?m sorry|i am sorry|sorry,|i can(?:not|'t)|i am unable|i'?m unable|i won'?t|as an ai|unfortunately,? i)"
)
NAMESPACE = r"(?is)^(artist|copyright|character|meta|general|species|lore|rating)\s*:\s*(.+)$"
THINKING = r"(?s)<think>.*?</think>"
TAG_CHARS, TAG_WORDS, MIN_TAGS = 60, 6, 3
# ---- end of fixed values ----


def clean(text: Column) -> Column:
    """Description without thinking, markup, quotes and preamble; first letter in upper case."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), THINKING, "")
    bare = F.replace(F.replace(bare, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    bare = strip(F.regexp_replace(F.regexp_replace(strip(bare), '^"+|"+$', ""), "^[“”]+|[“”]+$", ""))
    for _ in range(2):
        bare = strip(F.regexp_replace(bare, PREAMBLE, ""))
    return let(collapse(bare), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def refused(text: Column) -> Column:
    return strip(text).rlike(REFUSAL)


def parse_tags(text: Column) -> Column:
    """array<struct<part, tag>> in first-seen order: namespaced, canonical, lower case, sane lengths, distinct."""
    bare = F.btrim(strip(F.regexp_replace(F.coalesce(text, F.lit("")), THINKING, "")), F.lit("`"))
    trimmed = each(F.split(bare, "[,\n]"), f"x -> {strip_sql('regexp_replace(' + strip_sql('x') + ', r' + chr(39) + '[.]+$' + chr(39) + ', ' + chr(39) * 2 + ')')}")
    ns = f"lower(regexp_extract(x, {quoted(NAMESPACE)}, 1))"
    name = f"CASE WHEN x RLIKE {quoted(NAMESPACE)} THEN regexp_extract(x, {quoted(NAMESPACE)}, 2) ELSE x END"
    split = each(trimmed, f"x -> struct({ns} AS ns, {name} AS name)")
    tagged = each(split, "x -> struct(CASE WHEN x.ns IN ('artist', 'copyright', 'character') THEN x.ns ELSE 'general' END AS part, "
                         f"lower({canon_sql('x.name')}) AS tag, x.ns = 'rating' AS drop)")
    sane = only(tagged, f"x -> NOT x.drop AND x.tag <> '' AND length(x.tag) <= {TAG_CHARS} AND size(split(x.tag, ' ')) <= {TAG_WORDS}")
    keyed = F.sort_array(each(sane, "(x, i) -> struct(x.tag AS tag, i AS i, x.part AS part)"))
    once = let(keyed, "a -> sort_array(transform(filter(a, (x, i) -> i = 0 OR x.tag <> get(a, i - 1).tag), x -> struct(x.i AS i, x.part AS part, x.tag AS tag)))")
    return each(once, "x -> struct(x.part AS part, x.tag AS tag)")


def part(tags: Column, name: str) -> Column:
    return each(only(tags, f"x -> x.part = '{name}'"), "x -> x.tag")


@F.pandas_udf(StringType())
def first_object(replies: pd.Series) -> pd.Series:
    """Text of the first JSON object holding ``tags`` or ``caption``. Balanced braces are beyond a regex."""
    decoder = json.JSONDecoder()

    def find(text: str | None) -> str | None:
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                if "tags" in value or "caption" in value:
                    return json.dumps(value, ensure_ascii=False)
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    return replies.map(find)


def parse_object(text: Column) -> Column:
    """struct<tags, caption, changes>, null if the reply holds no usable object."""
    found = first_object(strip(F.regexp_replace(F.coalesce(text, F.lit("")), THINKING, "")))
    return F.from_json(found, "tags array<string>, caption string, changes string")


def answer(df: DataFrame, prompt: str, reply_fn, out: str = "reply") -> DataFrame:
    """Run a pluggable ``reply_fn(list of prompts) -> list of replies`` in batches; a failure becomes the row's error."""
    schema = df.schema.simpleString()[7:-1] + f", {out} string, error string"

    def run(batches):
        for b in batches:
            if len(b):
                try:
                    yield b.assign(**{out: list(reply_fn(list(b[prompt]))), "error": None})
                except Exception:  # one bad prompt must not fail its batch: fall back to one by one
                    rows = []
                    for p in b[prompt]:
                        try:
                            rows.append((reply_fn([p])[0], None))
                        except Exception as e:  # noqa: BLE001
                            rows.append((None, str(e)))
                    yield b.assign(**{out: [r for r, _ in rows], "error": [e for _, e in rows]})

    return df.mapInPandas(run, schema)
