"""Titles, hook phrases, hashtags and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import ENGLISH_STOP_WORDS
from ..functions.text import bound, capitalise, collapse_marks, drop_repeats, file_name, first_type, scene_mood, slug, squeeze, tidy, tokens

# Words that open a title without saying anything, and the phrases of hook and payoff types.
FILLERS = ("ну", "так", "ладно", "в общем", "к слову", "смотри", "слушай", "послушай", "well", "okay", "ok", "so", "then", "look", "listen")
HOOK_PHRASES = {
    "confrontation": "The argument starts immediately", "accusation_denial": "One question corners him", "threat_tension": "A threat changes the whole scene", "reveal_discovery": "The truth comes out too soon",
    "investigation_clue": "One clue flips the conversation", "rescue_urgency": "Every second already matters", "danger_escape": "One more step, and there is no way back", "impossible_choice": "There is almost no safe choice left",
    "emotional_confession": "The confession changes everything", "dialogue_conflict": "The conversation turns dangerous fast", "stakes_first": "The stakes are clear right away",
    "first_frame_clarity": "The scene is clear in the first frame", "sound_off_premise": "You understand it even without sound", "balanced_hook": "The conversation grabs you immediately", "weak_hook": "The tension builds from the first seconds",
}
PAYOFF_PHRASES = {
    "reveal": "and the truth comes out", "conflict": "and everything heads toward a blow-up", "emotional": "and the tone changes completely", "resolution": "and the scene finally lands",
    "hook_setup_escalation_payoff": "and the story lands cleanly", "unfinished": "but it never quite resolves",
}
CONFLICT_TAGS = {
    "en": {"accusation": "#accusation", "denial": "#denial", "betrayal": "#betrayal", "revelation": "#revelation", "argument": "#conflict", "threat": "#threat"},
    "ru": {"accusation": "#обвинение", "denial": "#отрицание", "betrayal": "#предательство", "revelation": "#развязка", "argument": "#конфликт", "threat": "#угроза"},
}
RUSSIAN_STOP_WORDS = (
    "это", "как", "так", "что", "чтобы", "только", "потом", "когда", "если", "или", "она", "они", "оно", "его", "ему", "тебя", "тебе", "меня", "мне", "тут", "там", "где", "для", "ещё", "уже", "просто", "ладно", "всё", "все",
    "ну", "да", "нет", "ага", "вот", "ты", "мы", "вы", "я", "он",
)
GENERIC_TOPICS = ("none", "момент", "сцена", "scene", "moment", "dialogue", "диалог", "разговор", "conversation", "история", "story", "episode", "эпизод")
GENERIC_NAMES = ("", "unknown", "neutral", "speaker", "user", "assistant", "system", "голос", "voice")
GENERIC_SPEAKER = r"^(speaker|spkr|s|person|voice|голос|нарратор)_?\d+$"


#: Names that say nothing of who speaks, for the plan of cuts.
GENERIC_SPEAKERS = (
    "", "unknown", "unkn", "speaker", "speaker_0", "speaker_1", "speaker0", "speaker1", "s0", "s1", "spkr", "narrator", "голос", "voice", "voice_0", "voice_1", "person_0", "person_1", "безымянный", "мужчина", "женщина",
    "человек",
)


def is_generic_speaker(name: Column, names: tuple[str, ...] = GENERIC_NAMES) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return low.isin(*names) | low.rlike(GENERIC_SPEAKER)


def without_fillers(text: Column) -> Column:
    """Without opening fillers, however many follow one another."""
    opening = r"(?iu)^(?:(?:" + "|".join(FILLERS) + r") [ ,:;\-—]*)+"
    return F.regexp_replace(F.regexp_replace(text, opening, ""), r"^[ ,:;\-—]+|[ ,:;\-—]+$", "")


def normal_title(text: Column) -> Column:
    """A clean title candidate: tidy, no repeated marks or words, no fillers, a capital first."""
    words = F.array_join(drop_repeats(F.split(collapse_marks(tidy(text)), " ")), " ")
    return capitalise(without_fillers(words))


def title_quality(text: Column) -> Column:
    """Score in 0..1: length near 34, letters, about six words; punctuation, repetition and single words cost."""
    near = lambda x, ideal: F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.abs(x - ideal) / ideal))

    def rated(bare: Column, words: Column) -> Column:
        n, letters = F.length(bare), F.length(F.regexp_replace(bare, r"[^\p{L}]+", ""))
        marks = F.length(F.regexp_replace(bare, "[^,;:—-]+", "")) + F.regexp_count(bare, F.lit(r"\.\.\."))
        again = F.when(F.size(drop_repeats(words)) < F.size(words), 1.0).otherwise(0.0)
        score = near(n, 34.0) * 0.34 + letters / F.greatest(F.lit(1), n) * 0.38 + near(F.size(words), 6.0) * 0.22
        score = score - F.least(F.lit(1.0), marks / 4.0) * 0.18 - again * 0.12 - F.when(F.size(words) < 2, 0.18).otherwise(0.0)
        return F.when(bare == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

    return bound(tidy(text), lambda bare: bound(F.split(bare, " "), lambda words: rated(bare, words)))


def trimmed_title(text: Column, most: int) -> Column:
    """At most `most` characters and '...', cut at a word boundary, without punctuation before the dots."""

    def short(whole: Column) -> Column:
        cut = bound(F.substring(whole, 1, most - 1), lambda head: F.coalesce(F.nullif(F.rtrim(F.regexp_extract(head, "^(.*) ", 1)), F.lit("")), head))
        return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(cut, "[,.:;!?]+$", ""), F.lit("...")))

    return bound(capitalise(tidy(text)), short)


def best_titles(candidates: DataFrame, by: str) -> DataFrame:
    """(by, title, score) of the best of candidates(by, nth, text): normalized, once each whatever the case, by score,
    then length, then order."""
    made = candidates.select(by, "nth", F.explode(F.array(normal_title(F.col("text")))).alias("title")).where("title <> ''")
    once = made.groupBy(by, F.lower("title").alias("key")).agg(F.min_by("title", "nth").alias("title"), F.min("nth").alias("nth"))
    scored = once.withColumn("score", F.round(title_quality(F.col("title")), 4))
    best = F.max_by(F.struct("title", "score"), F.struct("score", F.length("title").alias("n"), (-F.col("nth")).alias("o")))
    return scored.groupBy(by).agg(best.alias("b")).select(by, "b.title", "b.score")


def phrase(kind: Column, phrases: dict[str, str], default: str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in phrases.items() for x in pair))
    return F.coalesce(F.element_at(known, kind), F.lit(default))


def hook_phrase(kind: Column) -> Column:
    return phrase(kind, HOOK_PHRASES, "Strong story moment")


def payoff_phrase(kind: Column) -> Column:
    return phrase(kind, PAYOFF_PHRASES, "")


# Keyword parts of emotions and their tags, first match wins.
EMOTION_TAGS = {
    "en": (
        ("#tears", ("cry", "crying", "tears", "sobbing")), ("#laugh", ("laugh", "laughter", "funny")), ("#anger", ("angry", "anger", "rage", "furious")), ("#fear", ("scared", "fear", "afraid", "panic")),
        ("#shock", ("shock", "shocked", "stunned")), ("#sadness", ("sad", "grief", "sorrow")), ("#love", ("love", "tender", "affection")), ("#betrayal", ("betray", "betrayed")),
    ),
    "ru": (
        ("#слёзы", ("cry", "crying", "плач", "рыдает", "слёзы", "tear")), ("#смех", ("laugh", "смеётся", "хохот", "смех", "хохочет")), ("#злость", ("angry", "anger", "злится", "злость", "ярость", "rage")),
        ("#страх", ("scared", "fear", "боюсь", "страх", "испуг", "ужас")), ("#шок", ("shock", "shocked", "шок", "шокирован", "stunned")), ("#грусть", ("sad", "grief", "горе", "печаль", "грустн", "sorrow")),
        ("#любовь", ("love", "любовь", "влюблён", "нежность", "tender")), ("#предательство", ("betrayed", "предал", "предала", "изменил", "изменила")),
    ),
}


def tag_pack(speakers: Column, conflict: Column, emotions: Column, topic: Column, series: Column, full_arc: Column, language: str, most: int) -> Column:
    """story_hashtags() of one language."""
    named = F.filter(F.slice(speakers, 1, 4), lambda s: (F.length(F.trim(s)) > 2) & ~is_generic_speaker(s) & s.rlike(r"^[A-Za-zА-Яа-яЁё\s\-'.]{3,}$"))
    names = F.slice(F.array_distinct(F.transform(named, slug)), 1, 2)
    known = F.create_map(*(F.lit(x) for pair in CONFLICT_TAGS[language].items() for x in pair))
    felt = first_type(F.get(emotions, F.lit(0)), EMOTION_TAGS[language], F.lit(None).cast("string"))
    about = F.when((F.length(topic) >= 4) & ~F.lower(topic).isin(*GENERIC_TOPICS), slug(topic))
    of_series = F.when(F.length(F.trim(series)) > 2, slug(series))
    story = F.when(full_arc, "#story" if language == "en" else "#история")
    closing = F.lit("#shorts" if language == "ru" else None).cast("string")
    every = F.concat(names, F.array_compact(F.array(F.try_element_at(known, F.lower(F.trim(conflict))), felt, about, of_series, story, closing)))
    return F.slice(F.array_distinct(every), 1, most)


def story_hashtags(
    speakers: Column, conflict: Column, topic: Column, complete: Column, emotions: Column | None = None, series: Column | None = None, arc: Column | None = None, text: Column | None = None, language: str = "en", most: int = 3
) -> Column:
    """Up to two named speakers, the conflict, the first emotion, the topic, the series, a story tag where the arc is
    complete, and #shorts in Russian; each once, `most` in all. language: en, ru, or auto, by whether `text` is Cyrillic."""
    none = F.lit(None).cast("string")
    emotions, series, arc = F.array().cast("array<string>") if emotions is None else emotions, none if series is None else series, none if arc is None else arc
    full = complete | F.coalesce(F.lower(arc) == "hook_setup_escalation_payoff", F.lit(False))
    pack = lambda lang: tag_pack(speakers, conflict, emotions, topic, series, full, lang, max(1, most))
    if language != "auto":
        return pack("ru" if language == "ru" else "en")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\x{0400}-\x{04FF}]"), pack("ru")).otherwise(pack("en"))


def output_names(titles: DataFrame, order_by: str) -> DataFrame:
    """Adds file_name: the title as a file name, with ' [2]', ' [3]' for later rows of one name."""
    named = titles.withColumn("base", file_name(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(order_by))
    shown = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ["), F.col("nth").cast("string"), F.lit("]")))
    return named.withColumn("nth", nth).withColumn("file_name", shown).drop("base", "nth")


def context_summary(text: Column) -> Column:
    """Up to 96 characters of a text, cut at a word boundary."""
    bare = squeeze(text)
    head = F.substring(bare, 1, 96)
    cut = F.rtrim(F.regexp_extract(head, "^(.*) ", 1))
    return F.when(F.length(bare) <= 96, bare).when(cut != "", cut).otherwise(head)


def subtitle_context(segments: DataFrame, by: str, order: str, english: bool = False, most: int = 4) -> DataFrame:
    """(by, summary_text, keywords, mood, line_count) of segments(by, order, text): up to 96 characters of all text, its
    `most` frequent tokens of four characters or more, alphabetical among equals, the scene's mood, how many lines."""
    whole = tidy(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " "))
    found = segments.groupBy(by).agg(whole.alias("full"), F.count("*").alias("line_count"))
    stops = RUSSIAN_STOP_WORDS + (ENGLISH_STOP_WORDS if english else ())
    top = keywords(found, [by], tokens(F.col("full")), stops, most)
    words = top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    joined = found.join(words, by, "left")
    return joined.select(by, context_summary(F.col("full")).alias("summary_text"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.when(F.col("full") == "", "neutral").otherwise(scene_mood(F.col("full"))).alias("mood"), "line_count")


def keywords(rows: DataFrame, by: list[str], words: Column, stop_words: tuple[str, ...], most: int = 4) -> DataFrame:
    """The `most` frequent words of four characters or more per group, alphabetical among equals."""
    kept = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop_words))
    counts = rows.select(*by, F.explode(kept).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Tags of moods.
MOOD_TAGS = {"tension": "#tension", "reveal": "#reveal", "humor": "#humor", "drama": "#drama", "conversation": "#dialogue"}


#: Stems of moods, the first that a text holds wins.
MOOD_STEMS = (
    ("tension", ("убью", "стой", "ужас", "страш", "труп", "кров")), ("reveal", ("почему", "зачем", "смотри", "слушай", "послушай", "правда")), ("humor", ("ха", "смеш", "шут", "улыб", "прикол")),
)


def title_mood(text: Column, score: Column) -> Column:
    """tension, reveal or humor by stems, else drama from a score of 0.75 on, else conversation."""
    return first_type(text, MOOD_STEMS, F.when(score >= 0.75, "drama").otherwise("conversation"))


def hook_seed(text: Column) -> Column:
    """A hook without opening fillers; of more than 84 characters, only up to the first mark within 18 to 72."""
    bare = without_fillers(tidy(text))
    cut = F.regexp_extract(bare, r"^(.{18,71}?[.!?—,;:-])", 1)
    return capitalise(F.when((F.length(bare) > 84) & (cut != ""), cut).otherwise(bare))


def keyword_hashtags(words: Column, mood: Column, most: int = 3) -> Column:
    """Tags of keywords, then of the mood, each once, `most` in all."""
    known = F.create_map(*(F.lit(x) for pair in MOOD_TAGS.items() for x in pair))
    every = F.concat(F.transform(words, slug), F.array(F.element_at(known, mood)))
    return F.slice(F.array_distinct(F.array_compact(every)), 1, most)
