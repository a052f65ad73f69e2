"""Prompt columns. The wording is ours; which facts appear, and when, follows the settings."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

HINTS = 60  # fixed value: hint tags quoted in a caption prompt
LENGTH = {"short": "one sentence", "medium": "two or three sentences", "detailed": "four to six sentences"}


def caption_prompt(s: dict[str, Any], tags: Column) -> Column:
    """Ask for a description of one record, with its first hint tags."""
    hints = F.array_join(F.slice(tags, 1, HINTS), ", ")
    trigger = s["trigger"].strip()
    lines = [F.lit(f"Describe the picture in {LENGTH[s['vlm_detail']]}.")]
    if trigger and s["lora_type"] == "character":
        lines.append(F.lit(f"Call the main character {trigger}."))
    if s["vlm_extra_prompt"].strip():
        lines.append(F.lit(s["vlm_extra_prompt"].strip()))
    lines.append(F.when(hints != "", F.concat(F.lit("Reference tags: "), hints)))
    return F.concat_ws("\n", *lines)


def refine_prompt(s: dict[str, Any], project: Column, tags: Column, nl: Column, target: str = "both") -> Column:
    """Ask for a correction of tags, description or both; a description is only corrected if there is one."""
    trigger, told = s["trigger"].strip(), F.trim(F.coalesce(nl, F.lit("")))
    wants_tags, wants_text = target in ("both", "tags"), (told != "") if target in ("both", "caption") else F.lit(False)
    listed = F.array_join(tags, ", ")
    lines = [
        F.concat(F.lit("Dataset: "), project, F.lit(f" ({s['lora_type']}).")),
        F.lit(f"Trigger word, never a tag: {trigger}") if trigger else F.lit(None).cast("string"),
        F.concat(F.lit("Current tags: "), F.when(listed == "", "(none)").otherwise(listed)),
        F.when(told != "", F.concat(F.lit("Current caption: "), told)),
    ]
    if wants_tags:
        rules = ["Remove wrong tags, add clearly visible ones, people count first."]
        rules += [f"At most {s['max_tags']} tags."] if s["max_tags"] else []
        rules += ["Leave out: " + ", ".join(g.replace("_", " ") for g in s["prune_groups"]) + "."] if s["prune_groups"] else []
        lines.append(F.lit("\n".join(rules)))
    lines.append(F.when(wants_text, "Correct only what is wrong in the caption."))
    keys = F.concat_ws(", ", F.lit('"tags"') if wants_tags else F.lit(None).cast("string"), F.when(wants_text, '"caption"'))
    lines.append(F.concat(F.lit("Answer with one JSON object: "), keys, F.lit(', "changes".')))
    return F.concat_ws("\n", *lines)
