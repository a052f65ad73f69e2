"""Project settings: base defaults, model profiles, vocabularies, and their resolution as columns."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: defaults, profiles and vocabularies that decide results ----
BASE: dict[str, Any] = {
    "profile": "illustrious", "lora_type": "character", "trigger": "", "class_word": "", "caption_mode": "tags",
    "use_wd14": True, "use_vlm": False, "wd14_model": "", "general_threshold": 0.35, "character_threshold": 0.85,
    "max_tags": 40, "include_character_tags": True, "include_rating": False, "prefix_tags": "", "append_tags": "",
    "block_tag": "white rectangle", "block_tag_auto": False, "add_quality_tags": False, "quality_tags": "",
    "underscore_to_space": True, "escape_parentheses": False, "prune_groups": [], "blacklist": "",
    "vlm_detail": "medium", "vlm_extra_prompt": "", "vlm_nsfw": False, "nl_position": "before_tags",
    "vlm_tags": "off", "vlm_artist_tags": False, "vlm_engine": "server", "vlm_cli_model": "",
}
PRUNE_BY_LORA_TYPE = {"character": ["hair_color", "eye_color"], "style": ["style_medium"], "concept": []}
CAPTION_MODES = ["tags", "natural", "hybrid", "trigger_only"]
VLM_TAG_MODES = ["off", "extra", "merge", "only"]
VLM_ENGINES = ["server", "claude", "codex"]
TOKEN_LIMITS = {"sd15": 75, "sdxl": 75, "anima": 512, "flux": 512}
ONE_OF = {"vlm_engine": VLM_ENGINES, "nl_position": ["before_tags", "after_tags"]}
KEPT_ON_PROFILE_SWITCH = ["trigger", "class_word", "blacklist", "vlm_engine", "vlm_cli_model"]

_SIMPLE = {"questionable": "nsfw", "explicit": "nsfw"}
_BOORU = {"general": "general", "sensitive": "sensitive", "questionable": "nsfw", "explicit": "explicit"}
_SAFE = {"general": "safe", "sensitive": "sensitive", "questionable": "nsfw", "explicit": "explicit"}
_PONY = {"general": "rating_safe", "sensitive": "rating_questionable", "questionable": "rating_questionable",
         "explicit": "rating_explicit"}
PROFILES: dict[str, dict[str, Any]] = {
    "sd15_anime": {"family": "sd15", "rating_map": _SIMPLE,
                   "defaults": {"max_tags": 30, "include_rating": True}},
    "sd15_realistic": {"family": "sd15", "rating_map": _SIMPLE,
                       "defaults": {"caption_mode": "hybrid", "use_vlm": True, "vlm_detail": "short", "max_tags": 20,
                                    "general_threshold": 0.4, "include_character_tags": False}},
    "sdxl_base": {"family": "sdxl", "rating_map": _SIMPLE,
                  "defaults": {"caption_mode": "hybrid", "use_vlm": True, "max_tags": 20, "general_threshold": 0.4,
                               "include_character_tags": False}},
    "pony_v6": {"family": "sdxl", "rating_map": _PONY, "rating_position": "prefix",
                "defaults": {"include_rating": True, "prefix_tags": "source_anime",
                             "quality_tags": "score_9, score_8_up, score_7_up"}},
    "illustrious": {"family": "sdxl", "rating_map": _BOORU, "defaults": {"quality_tags": "masterpiece, best quality"}},
    "noobai_xl": {"family": "sdxl", "rating_map": _BOORU,
                  "defaults": {"include_rating": True,
                               "quality_tags": "masterpiece, best quality, newest, absurdres, highres"}},
    "animagine_xl": {"family": "sdxl", "rating_map": _SAFE,
                     "defaults": {"include_rating": True,
                                  "quality_tags": "masterpiece, high score, great score, absurdres"}},
    "anima": {"family": "anima", "rating_map": _SAFE, "rating_position": "prefix", "shuffle_caption": False,
              "artist_prefix": "@",
              "defaults": {"include_rating": True, "quality_tags": "masterpiece, best quality, score_7"}},
    "flux1_dev": {"family": "flux", "rating_map": None,
                  "defaults": {"caption_mode": "natural", "use_vlm": True, "vlm_detail": "detailed", "max_tags": 30,
                               "general_threshold": 0.4, "include_character_tags": False}},
}

_COLOURS = (
    "aqua|black|blonde|blue|brown|green|grey|gray|orange|pink|purple|red|silver|white|yellow|"
    "light brown|light blue|light purple|light green|light pink|dark blue|dark green|dark red|dark brown|dark purple|"
    "multicolored|two-tone|gradient|streaked|split-color|colored inner|rainbow"
)
PRUNE_GROUPS: dict[str, list[str]] = {
    "hair_color": [f"({_COLOURS}) hair", "colored tips", "streaked hair", "colored inner hair"],
    "hair_length": ["(very short|short|medium|long|very long|absurdly long) hair"],
    "hair_style": [
        "(low |short |high )?twintails", "(side |high |low )?ponytail", "(single |twin |french |crown |side )?braids?",
        "(single |double )?hair bun", "drill hair", "twin drills", "ahoge", "antenna hair",
        "((blunt|swept|parted|crossed|asymmetrical) )?bangs", "sidelocks", "hair between eyes", "hair intakes",
        "bob cut", "hime cut", "(wavy|curly|straight|messy|spiked) hair", "hair over (one eye|eyes)",
        "one side up", "two side up",
    ],
    "eye_color": [
        f"({_COLOURS}) eyes", "heterochromia", "slit pupils", "symbol-shaped pupils",
        "(star|heart)-shaped pupils", "ringed eyes", "tareme", "tsurime",
    ],
    "body": [
        "flat chest", "(small|medium|large|huge|gigantic) breasts", "animal ears",
        "(cat|dog|fox|wolf|rabbit|horse|bear|mouse|tiger|lion) ears", "animal ear fluff", "extra ears",
        "pointy ears", "(single |demon |dragon )?horns?", "(cat |fox |dog |wolf |demon |dragon )?tail",
        "(angel |demon |dragon |bat |feathered )?wings", "halo", "fangs?", "skin fang",
        "mole( under (eye|mouth))?", "freckles", "dark skin", "dark-skinned (female|male)", "tan",
        "muscular( female| male)?",
    ],
    "style_medium": [
        "anime coloring", "realistic", "photorealistic", r"photo \(medium\)", "sketch", "lineart", "monochrome",
        "greyscale", "limited palette", "flat color", "cel shading", r".+ \(medium\)", "traditional media",
        "faux traditional media", "pixel art", "3d", "official art", "game cg", "official style", "oekaki",
        "retro artstyle", r"\d{4}s \(style\)", "impressionism", "ukiyo-e", "parody", "style parody", "blending",
        "chromatic aberration", "film grain",
    ],
    "nsfw": [
        "nude", "completely nude", "nipples?", "areolae", "pussy", "penis", "testicles", "anus", "clitoris",
        "sex", "vaginal", "anal", "oral", "fellatio", "cunnilingus", "paizuri", "handjob", "footjob",
        "masturbation", "cum( .+)?", "ejaculation", "pubic hair", "erection", "spread legs", "spread pussy",
        "pussy juice", "after sex", "group sex", "threesome", "nsfw", "explicit", "rating[ _].+",
    ],
    "censorship": [
        "censored", "uncensored", "mosaic censoring", "bar censor", "convenient censoring", "novelty censor",
        "heart censor", "blank censor", "light censor", "steam censor",
    ],
    "meta": [
        "signature", "watermark", "artist name", "dated", "(twitter|patreon|pixiv) username", "web address",
        "copyright name", "character name", "logo", "(english |japanese |chinese )?text", "speech bubble",
        "jpeg artifacts", "commentary( request)?", "translated", "lowres", "highres", "absurdres",
    ],
}

# Safety exclusion: a record carrying a term of both lists never reaches an export or a training run.
PROTECTED_AGE_TERMS = [
    "loli", "shota", "child", "children", "female child", "male child", "toddler", "baby",
    "kindergarten uniform", "elementary school student", "randoseru", "aged down",
]
SEXUAL_TERMS = [
    "nsfw", "explicit", "rating_explicit", "rating_questionable", "nude", "completely nude", "sex", "vaginal",
    "anal", "oral", "fellatio", "pussy", "penis", "nipples", "cum", "masturbation", "paizuri", "handjob",
    "cunnilingus", "erection", "spread pussy", "after sex", "group sex",
]
SEXUAL_TEXT = r"(?i)\b(nude|naked|sex|sexual|genital|penis|vagina|pussy|nipples?)\b"
SEXUAL_RATINGS = ["questionable", "explicit"]
# ---- end of fixed values ----


def defaults_for(profile: str, lora_type: str = "character", **overrides: Any) -> dict[str, Any]:
    """Base, then profile, then training kind, then explicit overrides."""
    kind = lora_type if lora_type in PRUNE_BY_LORA_TYPE else "character"
    chain = {**BASE, **PROFILES[profile]["defaults"], "profile": profile, "lora_type": kind,
             "prune_groups": list(PRUNE_BY_LORA_TYPE[kind])}
    if kind == "style":
        chain["include_character_tags"] = False
    return chain | {k: v for k, v in overrides.items() if k in BASE and v is not None}


def profile_table(spark: SparkSession) -> DataFrame:
    """The resolved defaults of the nine profiles, one row each."""
    rows = []
    for key, p in PROFILES.items():
        d = BASE | p["defaults"]
        rows.append((key, p["family"], TOKEN_LIMITS[p["family"]], d["caption_mode"], d["general_threshold"],
                     d["character_threshold"], d["max_tags"], d["include_rating"], d["include_character_tags"],
                     d["use_vlm"], d["quality_tags"], d["prefix_tags"], p.get("rating_position", "after_character"),
                     p.get("shuffle_caption", True), p["rating_map"]))
    return spark.createDataFrame(rows, (
        "profile string, family string, token_limit int, p_caption_mode string, p_general_threshold double, "
        "character_threshold double, p_max_tags int, include_rating boolean, p_character_tags boolean, "
        "use_vlm boolean, quality_tags string, prefix_tags string, rating_position string, shuffle_caption boolean, "
        "rating_map map<string,string>"))


def _default(key: str) -> Column:
    """The default of a key by the column ``profile``: that of the base where the profile says nothing."""
    own = [x for name, p in PROFILES.items() if key in p["defaults"] for x in (F.lit(name), F.lit(p["defaults"][key]))]
    return F.coalesce(F.create_map(*own)[F.col("profile")], F.lit(BASE[key])) if own else F.lit(BASE[key])


def _setting(key: str, columns: list[str]) -> Column:
    """A key that is not repaired in a way of its own: the override, where there is one of the key's type, else the default."""
    default, override = _default(key), f"o_{key}"
    if override not in columns:
        return default.alias(key)
    kind = {bool: "boolean", float: "double", int: "int"}.get(type(BASE[key]), "string")
    value = F.col(override).cast("string")
    value = F.nullif(F.trim(value), F.lit("")) if key == "nl_position" else value.try_cast(kind)
    if key in ONE_OF:
        value = F.when(value.isin(ONE_OF[key]), value)
    return F.coalesce(value, default).alias(key)


def one_of(value: Column, allowed: list[str], fallback: Any) -> Column:
    return F.when(value.isin(list(allowed)), value).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


# Keys that resolve_settings derives in a way of their own.
RESOLVED_KEYS = {"profile", "lora_type", "caption_mode", "general_threshold", "max_tags", "trigger", "block_tag", "vlm_tags", "use_wd14", "include_character_tags", "prune_groups"}


def resolve_settings(projects: DataFrame) -> DataFrame:
    """Cascade override -> training kind -> profile -> base, with type repair, for a table of project overrides.

    ``projects`` has project_id, profile, lora_type and the nullable text overrides o_general_threshold, o_max_tags,
    o_caption_mode, o_trigger, o_block_tag, o_vlm_tags and o_use_wd14; of any other key an override o_<key> may be given. All keys are in the
    result. The profile side has nine rows by construction.
    """
    p = projects.withColumn("profile", one_of(F.col("profile"), list(PROFILES), BASE["profile"])) \
                .withColumn("lora_type", one_of(F.col("lora_type"), list(PRUNE_BY_LORA_TYPE), "character"))
    dims = profile_table(projects.sparkSession).drop("include_rating", "use_vlm", "quality_tags", "prefix_tags", "character_threshold")
    joined = p.join(F.broadcast(dims), "profile")
    kinds = F.create_map(*[x for k, v in PRUNE_BY_LORA_TYPE.items() for x in (F.lit(k), F.lit(",".join(v)))])
    pieces = F.filter(F.transform(F.split("o_block_tag", ","), lambda x: F.trim(x)), lambda x: x != "")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return joined.select(
        *[c for c in projects.columns if not c.startswith("o_") and c not in ("profile", "lora_type")],
        "profile", "lora_type", "family", "token_limit", "rating_position", "shuffle_caption", "rating_map",
        F.when(F.col("o_caption_mode").isNull(), F.col("p_caption_mode"))
        .otherwise(one_of(F.col("o_caption_mode"), CAPTION_MODES, "tags")).alias("caption_mode"),
        unit(F.coalesce(F.col("o_general_threshold").try_cast("double"), "p_general_threshold")).alias("general_threshold"),
        F.greatest(F.lit(0), F.coalesce(F.col("o_max_tags").try_cast("int"), "p_max_tags")).alias("max_tags"),
        F.trim(F.coalesce("o_trigger", F.lit(BASE["trigger"]))).alias("trigger"),
        F.coalesce(F.nullif(F.array_join(pieces, ", "), F.lit("")), F.lit(BASE["block_tag"])).alias("block_tag"),
        one_of(F.coalesce("o_vlm_tags", F.lit("off")), VLM_TAG_MODES, "off").alias("vlm_tags"),
        F.coalesce("o_use_wd14", F.lit(BASE["use_wd14"])).alias("use_wd14"),
        (F.col("p_character_tags") & (F.col("lora_type") != "style")).alias("include_character_tags"),
        kinds[F.col("lora_type")].alias("prune_groups"),
        *[_setting(k, projects.columns) for k in BASE if k not in RESOLVED_KEYS and k not in projects.columns])


def switch_profile(resolved: DataFrame, new_profile: Column, kept: list[str] = KEPT_ON_PROFILE_SWITCH) -> DataFrame:
    """Defaults of another profile for every project; only the kept columns and the training kind survive."""
    carried = [c for c in resolved.columns if c in (*kept, "project_id", "lora_type")]
    moved = resolved.select(*carried, new_profile.alias("profile"))
    return moved.join(F.broadcast(profile_table(resolved.sparkSession)), "profile").select(
        *carried, "profile", "family", F.col("p_caption_mode").alias("caption_mode"),
        F.col("p_general_threshold").alias("general_threshold"), F.col("p_max_tags").alias("max_tags"),
        (F.col("p_character_tags") & (F.col("lora_type") != "style")).alias("include_character_tags"))


def needs_text(s: DataFrame) -> Column:
    return F.col("use_vlm") & F.col("caption_mode").isin("natural", "hybrid")


def nothing_to_generate(s: DataFrame) -> Column:
    """True where tagging would change nothing: no tagger, no text, no language-model tags, and tags are wanted."""
    return ~((F.col("caption_mode") == "trigger_only") | F.col("use_wd14") | needs_text(s) | (F.col("vlm_tags") != "off"))


def bad_overrides(projects: DataFrame) -> DataFrame:
    """Projects whose numbers do not parse or whose profile is unknown, one row per offending key."""
    number = lambda c, t: F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c[2:]))
    keys = F.array(number("o_general_threshold", "double"), number("o_max_tags", "int"),
                   F.when(~F.col("profile").isin(list(PROFILES)), F.lit("profile")))
    return projects.select("project_id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("setting"))


def hint_columns(resolved: DataFrame) -> DataFrame:
    """Shuffle advice and fixed leading pieces per project."""
    from .functions.tags import split_tags

    off = F.col("caption_mode").isin("natural", "trigger_only") | ~F.col("shuffle_caption")
    rated = F.col("include_rating") & F.col("rating_map").isNotNull() & (F.col("rating_position") == "prefix")
    keep = ((F.col("trigger") != "").cast("int") + F.size(split_tags(F.col("prefix_tags"))) + rated.cast("int")
            + F.when(F.col("add_quality_tags"), F.size(split_tags(F.col("quality_tags")))).otherwise(0)
            + ((F.col("caption_mode") == "hybrid") & (F.col("nl_position") == "before_tags")).cast("int"))
    return resolved.select("project_id", (~off).alias("shuffle_caption"), F.when(off, 0).otherwise(keep).alias("keep_tokens"))
