"""Titles of stories: seeds, variants, the best candidate, and a rebuilt title where it isn't good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, looks_misread, squeeze
from .packaging import HOOK_PHRASES, PAYOFF_PHRASES, hook_seed, normal_title, phrase, title_mood, title_quality, trimmed_title

# What a title must not hold, stand-ins, and phrases of hook and payoff types in Russian.
FORBIDDEN = ("dialogue_cluster", "dialogue_linear", "fallback_window", "balanced_hook", "story_chain", "context_clean", "fallback window", "dialogue cluster", "balanced hook opening")
STAND_IN = {True: "Момент из серии", False: "Series moment"}
RUSSIAN_HOOKS = {
    "confrontation": "Ссора начинается с первого слова", "accusation_denial": "Один вопрос загоняет его в угол", "threat_tension": "Угроза сразу меняет сцену", "reveal_discovery": "Правда выходит наружу слишком рано",
    "investigation_clue": "Одна улика переворачивает разговор", "rescue_urgency": "Каждая секунда уже на счету", "danger_escape": "Ещё шаг, и пути назад не будет", "impossible_choice": "Выбора почти не осталось",
    "emotional_confession": "Признание меняет всё", "dialogue_conflict": "Разговор быстро становится опасным", "stakes_first": "Ставки понятны сразу", "first_frame_clarity": "Сцена ясна с первого кадра",
    "sound_off_premise": "Даже без звука всё понятно", "balanced_hook": "Разговор цепляет сразу", "weak_hook": "Напряжение растет с первых секунд",
}
RUSSIAN_PAYOFFS = {
    "reveal": "и правда выходит наружу", "conflict": "и всё идет к взрыву", "emotional": "и разговор меняет тон", "resolution": "и сцена получает развязку",
    "hook_setup_escalation_payoff": "и история получает финал", "unfinished": "но развязки не хватает",
}
LEAST_QUALITY = 0.58


def forbidden(text: Column) -> Column:
    """Whether a text is empty or a technical label instead of words of a story."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (low == "") | F.exists(F.array(*map(F.lit, FORBIDDEN)), lambda x: F.contains(low, x))


def unfit(text: Column) -> Column:
    return forbidden(text) | looks_misread(text)


def framed_title(hook_type: Column, payoff_type: Column, arc: Column, hint: Column, seed: Column, most: int, russian: bool = True) -> Column:
    """A title of the hook's phrase and a hint, with the payoff's phrase where the arc is full or there is no hint, and
    the seed where that is short."""
    hook = phrase(hook_type, RUSSIAN_HOOKS if russian else HOOK_PHRASES, "Сильный момент из сцены" if russian else "Strong story moment")
    payoff = phrase(payoff_type, RUSSIAN_PAYOFFS if russian else PAYOFF_PHRASES, "")
    short = max(18, min(42, most))
    hint, seed = trimmed_title(hint, short), trimmed_title(seed, short)
    opening = F.when(hint == "", hook).when(hook_type.isin("reveal_discovery", "investigation_clue"), F.concat(hint, F.lit(" — "), hook)).otherwise(F.concat(hook, F.lit(": "), hint))
    closes = (payoff != "") & ((arc == "hook_setup_escalation_payoff") | (hint == ""))
    told = bound(opening, lambda t: F.when(closes & ~F.contains(t, payoff), F.concat(t, F.lit(" "), payoff)).otherwise(t))
    return bound(told, lambda t: trimmed_title(F.when((seed != "") & (F.length(t) < 24), F.concat(t, F.lit(": "), seed)).otherwise(t), most))


def selected(candidates: Column) -> Column:
    """struct<title, score, changed> of the best of an array of candidates: normalized, once each whatever the case; sound
    ones first, then by quality, length and order. changed: others were there, or the first one isn't it as it is."""
    normal = F.filter(F.transform(candidates, normal_title), lambda t: t != "")
    once = lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, F.lower), F.lower(t)) == i + 1)
    rated = lambda ts: F.transform(ts, lambda t, i: F.struct(F.when(looks_misread(t), 0).otherwise(1).alias("sound"), F.round(title_quality(t) - F.when(looks_misread(t), 0.42).otherwise(0.0), 4).alias("score"), F.length(t).alias("n"), (-i).alias("o"), t.alias("title")))

    def best(ts: Column) -> Column:
        top = F.array_max(rated(ts))
        changed = lambda x: (F.size(ts) > 1) | (x["title"] != normal_title(F.get(candidates, F.lit(0)))) | (x["sound"] == 0)
        return bound(top, lambda x: F.struct(F.coalesce(x["title"], F.lit("")).alias("title"), F.greatest(F.lit(0.0), F.coalesce(x["score"], F.lit(0.0))).alias("score"), F.coalesce(changed(x), F.lit(False)).alias("changed")))

    return bound(normal, lambda ts: bound(once(ts), best))


def story_titles(stories: DataFrame, russian: bool = False, most: int = 72, serial: bool = False) -> DataFrame:
    """stories(title_seed, hook, setup, escalation, payoff, arc_shape, hook_type, payoff_type, topic_phrase; scores
    hook_strength, payoff_strength, story_clarity_score, recommendation_readiness_score, subtitle_quality_score) with
    title, hook_line, title_variant_a, title_variant_b, description_seed, mood, soft scores and confidence.

    The seed is the first of title seed, hook, opening of the escalation and payoff that isn't a technical label. Where
    titles are Russian (russian or serial), one that isn't Cyrillic, sound, allowed and of LEAST_QUALITY is rebuilt from
    the types' phrases. Each step is a column of its own, so that no text is cleaned twice."""
    given = lambda n: F.coalesce(F.col(n), F.lit("")) if n in stories.columns else F.lit("")
    number = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in stories.columns else F.lit(0.0)
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    stand_in = F.lit(STAND_IN[russian])
    x = stories.withColumns({f"_{n}": squeeze(given(n)) for n in ("title_seed", "hook", "setup", "escalation", "payoff")})
    c = lambda n: F.col(f"_{n}")
    opening = F.regexp_extract(c("escalation"), r"^(.*?)(?:[.!?]\s|$)", 1)
    seed = (
        F.when(~forbidden(c("title_seed")), hook_seed(c("title_seed"))).when(~forbidden(c("hook")), hook_seed(trimmed_title(c("hook"), 72))).when(~forbidden(c("escalation")), hook_seed(opening))
        .when(~forbidden(c("payoff")), hook_seed(c("payoff"))).otherwise("")
    )
    x = x.withColumns({"_text": squeeze(F.concat_ws(" ", c("hook"), c("setup"), c("escalation"), c("payoff"))), "_seed": seed})
    x = x.withColumn("_seed", F.when(unfit(c("seed")), stand_in).otherwise(c("seed")))
    x = x.withColumns({"_a": hook_seed(first(c("hook"), c("title_seed"), c("seed"))), "_b": hook_seed(first(c("payoff"), c("escalation"), c("seed")))})
    x = x.withColumns({n: trimmed_title(F.when(unfit(c(k)), c("seed")).otherwise(c(k)), most) for n, k in (("title_variant_a", "a"), ("title_variant_b", "b"))})
    x = x.withColumn("hook_line", trimmed_title(F.col("title_variant_a"), min(42, most)))
    x = x.withColumn("_best", selected(F.array(c("seed"), "title_variant_a", "title_variant_b", "hook_line")))
    x = x.withColumns({"title": trimmed_title(F.when(forbidden(F.col("_best.title")), c("seed")).otherwise(F.col("_best.title")), most), "title_quality_score": F.col("_best.score"), "title_cleanup_applied": F.col("_best.changed")})
    if russian or serial:
        weak = ~F.col("title").rlike(r"[\x{0400}-\x{04FF}]") | unfit(F.col("title")) | (F.col("title_quality_score") < LEAST_QUALITY)
        kind = F.coalesce(F.nullif(given("payoff_type"), F.lit("")), F.when(number("payoff_strength") >= 0.52, "reveal"), F.lit(""))
        built = framed_title(F.coalesce(F.nullif(given("hook_type"), F.lit("")), F.lit("balanced_hook")), kind, given("arc_shape"), first(c("title_seed"), c("hook"), c("setup"), c("text"), F.col("hook_line")), first(c("seed"), F.col("hook_line")), most)
        x = x.withColumn("_weak", weak).withColumn("_built", F.when(F.col("_weak"), built))
        x = x.withColumns({n: F.coalesce("_built", n) for n in ("title", "hook_line", "title_variant_a", "title_variant_b")} | {"title_cleanup_applied": F.col("_weak") | F.col("title_cleanup_applied")})
    hook, payoff, ready, clear = (number(n) for n in ("hook_strength", "payoff_strength", "recommendation_readiness_score", "story_clarity_score"))
    one = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4)
    terms = F.size(F.filter(F.split(given("topic_phrase"), " "), lambda w: w != ""))
    sure = 0.34 + F.when(c("text") != "", 0.18).otherwise(0.0) + F.least(F.lit(0.16), terms * 0.04) + F.least(F.lit(0.12), hook * 0.16) + F.least(F.lit(0.10), payoff * 0.14) + F.when(clear >= 0.6, 0.10).otherwise(0.0)
    x = x.withColumns(
        {
            "description_seed": trimmed_title(first(c("text"), F.col("hook_line"), F.col("title")), 110), "mood": title_mood(first(c("text"), c("hook"), c("escalation")), clear),
            "retention_soft_score": one(hook * 0.36 + payoff * 0.24 + ready * 0.26 + (0.14 if serial else 0.06)),
            "packaging_quality_score": one(hook * 0.34 + payoff * 0.26 + clear * 0.22 + ready * 0.14 + number("subtitle_quality_score") * 0.05 + F.col("title_quality_score") * 0.07),
            "title_confidence": F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.35), sure)), 4),
        }
    )
    return x.drop(*(n for n in x.columns if n.startswith("_")))
