"""Model replies and prompts."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as C
from ..functions import prompts as PR
from ..functions import replies as R
from ..functions.tags import canon_text, only, quoted, tidy
from ..operators import select as S
from .registry import query
from .tags import GROUPS, PROJECT
from .views import ITEMS, items, table, texts

# Replies: conversation turns as they are, wrapped the way models wrap their answers.
REPLIES = """replies AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<think>' || text || '</think>' || E'\\n' || 'This image shows ' || text
    WHEN turn % 4 = 1 THEN '"**' || text || '**"' WHEN turn % 4 = 3 THEN 'I''m sorry, ' || text ELSE 'Caption: in the picture, ' || text END AS reply FROM conversations)"""


def replies(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(
        F.col("role") == "user", F.concat(F.lit("<think>"), t, F.lit("</think>\nThis image shows "), t))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit('"**'), t, F.lit('**"'))).when(F.col("turn") % 4 == 3, F.concat(F.lit("I'm sorry, "), t))
        .otherwise(F.concat(F.lit("Caption: in the picture, "), t)).alias("reply"))


_C0 = "trim(replace(replace(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '**', ''), '__', ''), E' \\n\\t\\r')"
_C1 = f"trim(trim(trim({_C0}, '\"'), '“”'), E' \\n\\t\\r')"
_PRE = R.PREAMBLE.replace("'", "''")
_C2 = f"trim(regexp_replace(trim(regexp_replace({_C1}, '{_PRE}', ''), E' \\n\\t\\r'), '{_PRE}', ''), E' \\n\\t\\r')"
_C3 = f"trim(regexp_replace({_C2}, '\\s+', ' ', 'g'))"


@query("clean_reply", f"WITH {REPLIES} SELECT conv_id, turn, upper(substr(c, 1, 1)) || substr(c, 2) AS text FROM (SELECT conv_id, turn, {_C3} AS c FROM replies)")
def clean_reply(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", R.clean(F.col("reply")).alias("text"))


@query("refusals", f"WITH {REPLIES} SELECT conv_id, turn, starts_with(reply, 'I''m sorry, ') AS refused FROM replies")
def refusals(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", R.refused(F.col("reply")).alias("refused"))


_BOORU = """tagged AS (SELECT doc_id, '`artist: Ab_c, copyright: X y, character: Z_(q), rating: general, meta: Lines,' || text || '`' AS reply FROM documents)"""
_TRIM = "trim(rtrim(trim(p, E' \\n\\t\\r'), '.'), E' \\n\\t\\r')"
BOORU_SQL = f"""{_BOORU}, p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split_regex(trim(trim(reply, E' \\n\\t\\r'), '`'), '[,\\n]') AS l FROM tagged)),
    n AS (SELECT doc_id, pos, lower(regexp_extract(t, '(?is)^(artist|copyright|character|meta|general|species|lore|rating)\\s*:\\s*(.+)$', 1)) AS ns, t,
      coalesce(nullif(regexp_extract(t, '(?is)^(artist|copyright|character|meta|general|species|lore|rating)\\s*:\\s*(.+)$', 2), ''), t) AS name FROM (SELECT doc_id, pos, {_TRIM} AS t FROM p)),
    c AS (SELECT doc_id, pos, CASE WHEN ns IN ('artist', 'copyright', 'character') THEN ns ELSE 'general' END AS part, lower(trim(regexp_replace(replace(name, '_', ' '), '\\s+', ' ', 'g'))) AS tag FROM n WHERE ns <> 'rating'),
    f AS (SELECT doc_id, tag, min(pos) AS pos, arg_min(part, pos) AS part FROM c WHERE tag <> '' AND length(tag) <= 60 AND len(string_split(tag, ' ')) <= 6 GROUP BY 1, 2)"""


@query("parse_tag_reply", f"WITH {BOORU_SQL} SELECT doc_id, string_agg(part || ':' || tag, '|' ORDER BY pos) AS tags, count(*) < 3 AS malformed FROM f GROUP BY 1")
def parse_tag_reply(spark, sf):
    """Whole texts behind a namespaced head, read as a tag reply."""
    reply = F.concat(F.lit("`artist: Ab_c, copyright: X y, character: Z_(q), rating: general, meta: Lines,"), F.col("text"), F.lit("`"))
    t = texts(spark, sf).select("doc_id", R.parse_tags(reply).alias("t"))
    return t.where(F.size("t") > 0).select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(x["part"], F.lit(":"), x["tag"])), "|").alias("tags"),
                                           (F.size("t") < R.MIN_TAGS).alias("malformed"))


# JSON replies: a decoy object, then the real one, then chatter.
JSON_REPLY = """'Sure {"note": {"a": 1}} ```json' || chr(10) || to_json({'tags': [p_name, replace(p_name, ' ', '_'), p_type, 'hot gear'], 'caption': 'in this photo, ' || p_brand, 'changes': p_type}) || chr(10) || '``` {bad'"""


def json_replies(spark, sf):
    body = F.to_json(F.struct(F.array("p_name", F.translate("p_name", " ", "_"), "p_type", F.lit("hot gear")).alias("tags"),
                              F.concat(F.lit("in this photo, "), "p_brand").alias("caption"), F.col("p_type").alias("changes")))
    reply = F.concat(F.lit('Sure {"note": {"a": 1}} ```json\n'), body, F.lit("\n``` {bad"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 45, F.lit("no json {here}")).otherwise(reply).alias("reply"))


@query("parse_json_reply", """SELECT p_partkey AS id, CASE WHEN p_size <= 45 THEN p_name || '|' || replace(p_name, ' ', '_') || '|' || p_type || '|hot gear' END AS tags,
    CASE WHEN p_size <= 45 THEN 'in this photo, ' || p_brand END AS caption, CASE WHEN p_size <= 45 THEN p_type END AS changes FROM part""")
def parse_json_reply(spark, sf):
    j = json_replies(spark, sf).select("id", R.parse_object(F.col("reply")).alias("j"))
    return j.select("id", F.array_join("j.tags", "|").alias("tags"), "j.caption", "j.changes")


_T = "list_filter([p_name, p_type], lambda t: NOT regexp_matches(lower(t), '^(?:(red|blue|green) (plate|ring|bolt))$') AND NOT regexp_matches(lower(t), '^(?:small w.*)$|^(?:large [ap].*)$') AND lower(t) <> 'hot gear')"


@query("refine_apply", f"""SELECT p_partkey AS id, CASE WHEN p_size <= 45 THEN array_to_string({_T}, '|') END AS tags,
    CASE WHEN p_size <= 45 THEN p_brand END AS caption, CASE WHEN p_size > 45 THEN 'bad reply' END AS error FROM part""")
def refine_apply(spark, sf):
    """A correction is filtered like any tag list; an unusable or emptied reply is an error."""
    j = json_replies(spark, sf).select("id", R.parse_object(F.col("reply")).alias("j"))
    trigger = canon_text(PROJECT["trigger"]).lower()
    tags = only(S.apply_filters(tidy(F.col("j.tags")), PROJECT, GROUPS), f"x -> lower(x) <> {quoted(trigger)}")
    tags = F.slice(tags, 1, PROJECT["max_tags"]) if PROJECT["max_tags"] else tags
    caption = R.clean(F.col("j.caption"))
    error = F.when(F.col("j").isNull() | F.col("j.tags").isNull(), "bad reply").when(F.size(tags) == 0, "empty").when(caption == "", "bad reply")
    return j.select("id", F.when(F.col("j").isNotNull(), F.array_join(tags, "|")).alias("tags"), F.when(F.col("j").isNotNull(), caption).alias("caption"), error.alias("error"))


REFINE = C.defaults_for("illustrious", trigger="hot gear")


@query("prompt_column", f"""WITH {ITEMS} SELECT id, 'Describe the picture in two or three sentences.' || chr(10) || 'Call the main character hot gear.' || CASE WHEN len(tags) > 0 THEN chr(10) || 'Reference tags: ' || array_to_string(tags[1:60], ', ') ELSE '' END AS caption_prompt,
    'Dataset: ' || project_id || ' (character).' || chr(10) || 'Trigger word, never a tag: hot gear' || chr(10) || 'Current tags: ' || CASE WHEN len(tags) = 0 THEN '(none)' ELSE array_to_string(tags, ', ') END
    || CASE WHEN trim(nl) <> '' THEN chr(10) || 'Current caption: ' || trim(nl) ELSE '' END || chr(10) || 'Remove wrong tags, add clearly visible ones, people count first.' || chr(10) || 'At most 40 tags.' || chr(10) || 'Leave out: hair color, eye color.'
    || CASE WHEN trim(nl) <> '' THEN chr(10) || 'Correct only what is wrong in the caption.' ELSE '' END || chr(10) || 'Answer with one JSON object: "tags"' || CASE WHEN trim(nl) <> '' THEN ', "caption"' ELSE '' END || ', "changes".' AS refine_prompt FROM items""")
def prompt_column(spark, sf):
    return items(spark, sf).select("id", PR.caption_prompt(REFINE, F.col("tags")).alias("caption_prompt"),
                                   PR.refine_prompt(REFINE, F.col("project_id"), F.col("tags"), F.col("nl")).alias("refine_prompt"))
