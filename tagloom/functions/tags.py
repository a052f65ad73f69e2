"""Tag text: canonical form, splitting, formatting, pattern groups. Everything here is a Column expression."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the published behaviour) ----
KAOMOJI = [
    "0_0", "(o)_(o)", "+_+", "+_-", "._.", "<o>_<o>", "<|>_<|>", "=_=", ">_<",
    "3_3", "6_9", ">_o", "@_@", "^_^", "o_o", "u_u", "x_x", "|_|", "||_||",
]
PROTECTED = r"^(score_\d+(_up)?|source_[a-z0-9]+|rating_[a-z]+)$"
COUNT_TAG = (
    r"^((\d|6\+)(girl|boy|other)s?|solo|solo focus|multiple girls|multiple boys|multiple others|no humans)$"
)
TOKEN = r"(?U)\w+|[^\w\s]"
# ---- end of fixed values ----


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body`` (a callable or SQL lambda text)."""
    if isinstance(body, str):
        return F.call_function("transform", F.array(value), F.expr(body))[0]
    return F.transform(F.array(value), body)[0]


def each(items: Column, body: str) -> Column:
    """``transform`` with a SQL lambda, e.g. ``x -> lower(x)``. SQL text keeps large expressions cheap to build."""
    return F.call_function("transform", items, F.expr(body))


def only(items: Column, body: str) -> Column:
    return F.call_function("filter", items, F.expr(body))


def quoted(text: str) -> str:
    """A raw SQL string literal."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"  # characters that count as whitespace
_PLAIN = r"\A(?:[!-\[\]^`-~]++(?: [!-\[\]^`-~]++)*+)?\z"  # surely canonical: ASCII words without underscore or backslash, single spaces
_LOOSE = r"(?U)_|\\|\s\s|^\s|\s$|[^\S ]"  # what can make a tag non-canonical


def strip_sql(x: str) -> str:
    return f"btrim({x}, '{WHITE}')"


def collapse_sql(x: str) -> str:
    return rf"regexp_replace({strip_sql(x)}, r'(?U)\s+', ' ')"


def canon_sql(x: str) -> str:
    """Trimmed, parentheses unescaped, underscores to spaces unless the tag is an emoticon or a reserved word.

    One look decides whether a tag needs any work; most do not.
    """
    bare = rf"replace(replace({strip_sql(x)}, r'\(', '('), r'\)', ')')"
    faces = ", ".join(quoted(k) for k in KAOMOJI)
    loose = collapse_sql(f"translate({bare}, '_', ' ')")
    return (f"CASE WHEN {x} RLIKE {quoted(_PLAIN)} THEN {x} WHEN {x} RLIKE {quoted(_LOOSE)} THEN CASE WHEN {bare} IN ({faces}) OR {bare} RLIKE "
            f"{quoted('(?i)' + PROTECTED)} THEN {bare} ELSE {loose} END ELSE {x} END")


def format_sql(x: str, underscore_to_space: bool, escape_parentheses: bool) -> str:
    """``x`` is canonical; a canonical tag still holding an underscore is one that must keep its spelling."""
    out = x if underscore_to_space else f"CASE WHEN contains({x}, '_') THEN {x} ELSE translate({x}, ' ', '_') END"
    return rf"replace(replace({out}, '(', r'\('), ')', r'\)')" if escape_parentheses else out


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def canon(c: Column) -> Column:
    return let(c, "t -> " + canon_sql("t"))


def canon_all(items: Column) -> Column:
    return each(items, "t -> " + canon_sql("t"))


def format_all(items: Column, underscore_to_space: bool, escape_parentheses: bool) -> Column:
    return each(canon_all(items), "t -> " + format_sql("t", underscore_to_space, escape_parentheses))


def format_tag(c: Column, underscore_to_space: bool = True, escape_parentheses: bool = False) -> Column:
    return let(canon(c), "t -> " + format_sql("t", underscore_to_space, escape_parentheses))


_FIRSTS = ("s -> transform(sort_array(transform(filter(s, (a, i) -> i = 0 OR a.k <> get(s, i - 1).k), "
           "a -> struct(a.i AS i, a.x AS x))), a -> a.x)")


def dedupe_ci(items: Column) -> Column:
    """Case-insensitive distinct that keeps the first spelling and the order; O(n log n) inside the row."""
    keyed = each(items, "(x, i) -> struct(lower(x) AS k, i AS i, x AS x)")
    return let(F.sort_array(keyed), _FIRSTS)


def tidy(items: Column) -> Column:
    """Canonical, non-empty, first-wins distinct."""
    return dedupe_ci(only(canon_all(items), "x -> x <> ''"))


def split_tags(text: Column) -> Column:
    return tidy(F.split(text, "[,\n]"))


def norm_tag(c: Column) -> Column:
    """Filter spelling: lower case, whitespace runs to one underscore."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", "_")


def glob_regex(glob: str) -> str:
    """Anchored regex for a shell-style pattern with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^(?:{out})$"


def globs_regex(patterns: Iterable[str]) -> str | None:
    return "(?s)" + "|".join(glob_regex(p.lower())[4:] for p in patterns) if patterns else None


def groups_regex(groups: Iterable[str], table: dict[str, list[str]]) -> str | None:
    patterns = [p for g in groups if g in table for p in table[g]]
    return "^(?:" + "|".join(patterns) + ")$" if patterns else None


def matches_globs(c: Column, patterns: Iterable[str]) -> Column:
    regex = globs_regex(list(patterns))
    return F.lower(canon(c)).rlike(regex) if regex else F.lit(False)


def matches_groups(c: Column, groups: Iterable[str], table: dict[str, list[str]]) -> Column:
    """Full match of the canonical lower-case tag against the named pattern groups."""
    regex = groups_regex(groups, table)
    return F.lower(canon(c)).rlike(regex) if regex else F.lit(False)


def is_count_sql(x: str) -> str:
    return f"lower({x}) RLIKE {quoted(COUNT_TAG)}"


def token_estimate(caption: Column) -> Column:
    return F.size(F.regexp_extract_all(caption, F.lit(TOKEN), F.lit(0)))


# ---- plan-time twins for settings text (a handful of words per project, never data) ----
def canon_text(tag: str) -> str:
    bare = tag.strip().replace("\\(", "(").replace("\\)", ")")
    keep = bare in KAOMOJI or re.match(PROTECTED, bare, re.I)
    return bare if keep else " ".join(bare.replace("_", " ").split())


def split_text(text: str | None) -> list[str]:
    found: dict[str, str] = {}
    for piece in re.split("[,\n]", text or ""):
        name = canon_text(piece)
        if name:
            found.setdefault(name.lower(), name)
    return list(found.values())


def format_text(tag: str, underscore_to_space: bool, escape_parentheses: bool) -> str:
    name = canon_text(tag)
    if not underscore_to_space and name not in KAOMOJI and not re.match(PROTECTED, name, re.I):
        name = name.replace(" ", "_")
    return re.sub(r"([()])", r"\\\1", name) if escape_parentheses else name
