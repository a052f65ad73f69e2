"""Training requests: a form becomes the input of a run, and the document of a run becomes columns and the form again.

All of it is row expressions on structs, so documents are parsed, mapped and written without a shuffle. A key that a document lacks is a null
field; ``to_json`` leaves nulls out, so structs and documents carry the same. Null rows and fields of the wrong kind count as lacking.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---- fixed values: names of the form and of the input, with their types ----
PARAMETERS = {
    "steps": ("steps", "int"), "epochs": ("epochs", "int"), "batch_size": ("batchSize", "int"), "lr": ("lr", "double"),
    "lr_scheduler": ("lrScheduler", "string"), "optimizer": ("optimizerType", "string"), "network_dim": ("networkDim", "int"),
    "network_alpha": ("networkAlpha", "int"), "noise_offset": ("noiseOffset", "double"), "flip_augmentation": ("flipAugmentation", "boolean"),
    "min_snr_gamma": ("minSnrGamma", "double"), "train_text_encoder": ("trainTextEncoder", "boolean"), "text_encoder_lr": ("textEncoderLr", "double"),
}
SPECIAL = ["base_model", "trigger_word", "min_snr_gamma", "train_text_encoder", "text_encoder_lr"]
SHOWN = ["steps", "epochs", "batchSize", "lr", "lrScheduler", "optimizerType", "networkDim", "networkAlpha"]
MOST_KEPT = 10
ENGINE, TRACE = "ai-toolkit", "events"
# ---- end of fixed values ----

FORM = (", ".join(f"{name} {kind}" for name, (_, kind) in PARAMETERS.items()) + ", base_model string, trigger_word string, shuffle_tokens boolean, "
        "keep_tokens int, continue_from string, sample_prompts array<string>, sample_negative string, sample_cfg double, sample_strength double")
INPUT = ("engine string, ecosystem string, modelVariant string, version string, model string, "
         + ", ".join(f"{name} {kind}" for name, kind in PARAMETERS.values())
         + ", shuffleTokens boolean, keepTokens int, triggerWord string, continueFrom string, trace string, "
         "trainingData struct<type:string,items:array<struct<url:string,caption:string>>>, "
         "samples struct<prompts:array<string>,negativePrompt:string,cfgScale:double,strength:double>")
WORKFLOW = (
    "id string, status string, createdAt string, startedAt string, completedAt string, allowMatureContent boolean, "
    "metadata struct<max_side:int,only_done:boolean>, cost struct<total:double,factors:struct<base:double>>, "
    "transactions struct<list:array<struct<type:string,amount:long>>,insufficientBuzz:boolean>, "
    "steps array<struct<`$type`:string,status:string,priority:string,startedAt:string,estimatedProgressRate:double,"
    "queuePosition:struct<precedingJobs:long,estimatedStartAt:string,estimatedCompleteAt:string>,"
    f"input:struct<{INPUT}>,output:struct<moderationStatus:string,epochs:array<struct<epochNumber:int,"
    "model:struct<url:string,available:boolean>,samples:array<struct<url:string>>,traceUrl:string>>>>>")


@dataclass(frozen=True)
class Kind:
    """A training type: its ecosystem, what tells it from others of that ecosystem, the special fields that it has, and its largest batch."""
    ecosystem: str
    extra: dict[str, str] = field(default_factory=dict)
    special: tuple[str, ...] = ()
    max_batch: int = 1


def _given(text: Column) -> Column:
    """The text, null where it is empty."""
    return F.nullif(text, F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _of_kind(name: Column, kinds: dict[str, Kind], value: Callable[[Kind], Column]) -> Column:
    out = F.lit(None)
    for key, kind in kinds.items():
        out = F.when(name == key, value(kind)).otherwise(out)
    return out


def _has(name: Column, kinds: dict[str, Kind], special: str) -> Column:
    return name.isin([k for k, kind in kinds.items() if special in kind.special])


def unsupported(name: Column, form: Column, kinds: dict[str, Kind]) -> Column:
    """The special fields that the form gives, neither null nor empty, though its training type has no such field."""
    wrong = [F.when((F.coalesce(form[f].cast("string"), F.lit("")) != "") & ~_has(name, kinds, f), F.lit(f)) for f in SPECIAL]
    return F.array_compact(F.array(*wrong))


def default_negative(negative: Column, block_tag: Column, block_auto: Column) -> Column:
    """The base model's negative prompt, with the tag of masked areas where that is added to captions."""
    return F.concat_ws(", ", _given(negative), F.when(block_auto, _given(block_tag)))


def build_input(name: Column, form: Column, kinds: dict[str, Kind], *, model: Column, items: Column, trigger: Column, negative: Column,
                shuffle: Column, keep: Column) -> Column:
    """The input of a run, a struct like INPUT; null for an unknown training type.

    What the form leaves out comes from the project: trigger word, negative prompt, shuffling and the number of leading pieces that stay. Fields
    that the training type lacks are left out; the batch lies between 1 and the type's largest; a text encoder that is not trained has no rate;
    leading pieces are at most MOST_KEPT and none without shuffling.
    """
    fields = {api: F.when(_has(name, kinds, key), form[key]) if key in SPECIAL else form[key] for key, (api, _) in PARAMETERS.items()}
    fields["batchSize"] = F.when(fields["batchSize"].isNotNull(), F.greatest(F.lit(1), F.least(fields["batchSize"], _of_kind(name, kinds, lambda k: F.lit(k.max_batch)))))
    fields["textEncoderLr"] = F.when(F.coalesce(fields["trainTextEncoder"], F.lit(True)), fields["textEncoderLr"])
    shuffled = F.coalesce(form["shuffle_tokens"], shuffle)
    word = _strip(F.coalesce(form["trigger_word"], trigger))
    values = {
        "engine": F.lit(ENGINE), "ecosystem": _of_kind(name, kinds, lambda k: F.lit(k.ecosystem)), "model": _given(model),
        **{x: _of_kind(name, kinds, lambda k, x=x: F.lit(k.extra.get(x)).cast("string")) for x in ("modelVariant", "version")}, **fields,
        "shuffleTokens": shuffled, "keepTokens": F.when(shuffled, F.least(F.lit(MOST_KEPT), F.coalesce(form["keep_tokens"], keep))).otherwise(0),
        "triggerWord": F.when(_has(name, kinds, "trigger_word"), _given(word)), "continueFrom": _given(form["continue_from"]), "trace": F.lit(TRACE),
        "trainingData": F.struct(F.lit("blobs").alias("type"), items.alias("items")),
        "samples": F.struct(form["sample_prompts"].alias("prompts"), _given(F.coalesce(_strip(form["sample_negative"]), negative)).alias("negativePrompt"),
                            form["sample_cfg"].alias("cfgScale"), form["sample_strength"].alias("strength")),
    }
    return F.when(name.isin(list(kinds)), F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(INPUT)]))


def kind_of(given: Column, kinds: dict[str, Kind]) -> Column:
    """The first training type whose ecosystem and marks an input has, or null."""
    out = []
    for name, kind in kinds.items():
        test = given["ecosystem"] == kind.ecosystem
        for mark, value in kind.extra.items():
            test = test & (given[mark] == value)
        out.append(F.when(test, F.lit(name)))
    return F.coalesce(*out)


def request(workflow: Column, given: Column, kinds: dict[str, Kind]) -> Column:
    """The form that would give this input again, with the settings of its upload; null for an unknown training type."""
    name = kind_of(given, kinds)
    shuffled = given["shuffleTokens"].isNotNull()
    text = lambda c: F.coalesce(c, F.lit(""))
    values = {
        "training_type": name,
        **{key: F.when(_has(name, kinds, key), given[api]) if key in SPECIAL else given[api] for key, (api, _) in PARAMETERS.items()},
        "base_model": F.when(_has(name, kinds, "base_model"), _given(given["model"])),
        "trigger_word": F.when(_has(name, kinds, "trigger_word"), text(given["triggerWord"])),
        "shuffle_tokens": given["shuffleTokens"], "keep_tokens": F.when(shuffled, F.coalesce(given["keepTokens"], F.lit(0))),
        "continue_from": text(given["continueFrom"]),
        "sample_prompts": F.coalesce(given["samples"]["prompts"], F.array().cast("array<string>")),
        "sample_negative": text(given["samples"]["negativePrompt"]),
        "sample_cfg": given["samples"]["cfgScale"], "sample_strength": given["samples"]["strength"],
        "allow_mature": workflow["allowMatureContent"], "max_side": F.nullif(workflow["metadata"]["max_side"], F.lit(0)),
        "only_done": workflow["metadata"]["only_done"],
    }
    return F.when(name.isNotNull(), F.struct(*[v.alias(k) for k, v in values.items()]))


def epochs(output: Column) -> Column:
    """(epoch, available, url, samples, trace_url) of each epoch. One that doesn't say whether it is available is so if it has a url."""
    def one(e: Column) -> Column:
        url = e["model"]["url"]
        urls = F.filter(F.transform(F.coalesce(e["samples"], F.array().cast("array<struct<url:string>>")), lambda s: s["url"]), lambda u: F.coalesce(u != "", F.lit(False)))
        return F.struct(e["epochNumber"].alias("epoch"), F.coalesce(e["model"]["available"], url != "", F.lit(False)).alias("available"),
                        url.alias("url"), urls.alias("samples"), e["traceUrl"].alias("trace_url"))

    none = F.array().cast("array<struct<epoch:int,available:boolean,url:string,samples:array<string>,trace_url:string>>")
    return F.coalesce(F.transform(output["epochs"], one), none)


def summary(workflow: Column, kinds: dict[str, Kind]) -> dict[str, Column]:
    """Name -> column of what a list of runs shows of a run's document (a struct like WORKFLOW). Its first training step counts.

    charged is null without transactions, else debits less credits; refunded null without credits; cost_full is the price before discounts, rounded
    half to even, where it is above the price.
    """
    w = workflow
    step = F.get(F.filter(w["steps"], lambda s: s["$type"] == "training"), F.lit(0))
    given, out, queue = step["input"], step["output"], step["queuePosition"]
    listed = w["transactions"]["list"]
    total = lambda kind: F.aggregate(F.filter(listed, lambda t: t["type"] == kind), F.lit(0).cast("long"),
                                     lambda acc, t: acc + F.coalesce(t["amount"], F.lit(0)))
    cost, full = w["cost"]["total"], w["cost"]["factors"]["base"]
    shown = F.struct(*[given[k].alias(k) for k in SHOWN])
    return {
        "id": w["id"], "status": F.coalesce(_given(w["status"]), step["status"]), "step_status": step["status"], "moderation": out["moderationStatus"],
        "cost": cost, "cost_full": F.when((full != 0) & (full > cost), F.bround(full).cast("long")),
        "charged": F.when(F.size(listed) > 0, total("debit") - total("credit")), "refunded": F.nullif(total("credit"), F.lit(0).cast("long")),
        "priority": step["priority"], "insufficient_funds": F.coalesce(w["transactions"]["insufficientBuzz"], F.lit(False)),
        "created_at": w["createdAt"], "started_at": F.coalesce(_given(step["startedAt"]), w["startedAt"]), "completed_at": w["completedAt"],
        "progress_rate": step["estimatedProgressRate"],
        "queue": F.struct(queue["precedingJobs"].alias("ahead"), queue["estimatedStartAt"].alias("start_at"), queue["estimatedCompleteAt"].alias("complete_at")),
        "input_plan": F.struct(given["steps"].alias("steps"), given["epochs"].alias("epochs")),
        "params": F.when(F.coalesce(*[given[k].cast("string") for k in SHOWN]).isNotNull(), shown),
        "request": F.when(given.isNotNull(), request(w, given, kinds)), "epochs": epochs(out),
    }
