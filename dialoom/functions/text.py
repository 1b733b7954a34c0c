"""Column functions over text: cleaning, tokens, lexicon scores, rule cascades, titles and captions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicons

WORD = r"[\p{L}\p{N}_']+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once, however often it is used: it is the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space as single spaces, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_tags(text: Column) -> Column:
    """Without <tags> and {tags}."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    return squeeze(F.regexp_replace(bare, r"\{[^}]+\}", " "))


def tidy(text: Column) -> Column:
    """Squeezed, without space before punctuation; a spaced dash becomes a space."""
    return F.replace(F.regexp_replace(squeeze(text), r" +([,.:;!?])", "$1"), F.lit(" - "), F.lit(" "))


def word_count(text: Column) -> Column:
    bare = squeeze(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin and Cyrillic letters, ASCII digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-z\x{0400}-\x{04FF}0-9']+"), F.lit(0))


def topic_words(text: Column, stop_words: Sequence[str] = lexicons.STOP_WORDS, least: int = 4) -> Column:
    """Lower-case words between non-word characters, of `least` characters or more, that aren't stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))


def plain_words(text: Column, stop_words: Sequence[str] = lexicons.STOP_WORDS, least: int = 4) -> Column:
    """As topic_words(), with apostrophes inside words."""
    words = F.regexp_extract_all(F.lower(squeeze(text)), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def possible(text: Column, parts: Sequence[str]) -> Column:
    """Those of some strings that a text can hold: of a text without Cyrillic, the ones without it. Read once for all."""
    cyrillic = re.compile("[\u0400-\u04ff]")
    plain = [s for s in parts if not cyrillic.search(s)]
    every, some = strings(parts), strings(plain) if plain else F.array().cast("array<string>")
    return every if len(plain) == len(parts) else F.when(text.rlike(r"[\x{0400}-\x{04FF}]"), every).otherwise(some)


def hits(text: Column, lexicon: Sequence[str]) -> Column:
    """The entries that occur in the text as substrings, in lexicon order."""
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(possible(low, lexicon), lambda s: F.contains(low, s)))


def lexicon_score(text: Column, lexicon: Sequence[str]) -> Column:
    """Share of the entries that occur in the text."""
    return F.size(hits(text, lexicon)) / F.lit(float(len(lexicon)))


def first_type(text: Column, types: Sequence[tuple[str, Sequence[str]]], default: Column | str) -> Column:
    """The first type one of whose stems the text holds."""
    default = default if isinstance(default, Column) else F.lit(default)

    def cascade(low: Column) -> Column:
        holds = lambda stems: F.exists(possible(low, stems), lambda s: F.contains(low, s))
        return F.coalesce(*(F.when(holds(stems), F.lit(name)) for name, stems in types), default)

    return bound(F.lower(squeeze(text)), cascade)


def turn_type(text: Column) -> Column:
    """empty, question, exclamation, short_reply (three words or fewer) or statement."""
    bare = F.trim(text)
    return (
        F.when(bare == "", "empty").when(bare.rlike(r"\?\s*[\"'»]?\s*$"), "question").when(bare.rlike(r"!\s*[\"'»]?\s*$"), "exclamation")
        .when(word_count(bare) <= 3, "short_reply").otherwise("statement")
    )


def hook_type(text: Column) -> Column:
    return first_type(text, lexicons.HOOK_TYPES, "balanced_hook")


def payoff_type(text: Column) -> Column:
    return F.when(squeeze(text) == "", "unfinished").otherwise(first_type(text, lexicons.PAYOFF_TYPES, "resolution"))


def conflict_type(signals: Column, escalation: Column) -> Column:
    """From conflict signals and the escalation text; 'argument' if there are signals of no known type."""
    text = F.concat_ws(" ", signals, escalation)
    return first_type(text, lexicons.CONFLICT_TYPES, F.when(F.size(signals) > 0, "argument").otherwise("none"))


def scene_mood(text: Column) -> Column:
    return first_type(text, lexicons.SCENE_MOODS, "neutral")


def language_consistency(text: Column, lang: Column) -> Column:
    """Share of Cyrillic (ru) or Latin (en) letters among both; of the commoner for other languages."""

    def share(bare: Column) -> Column:
        letters = F.array(F.length(F.regexp_replace(bare, "[^А-Яа-яЁё]+", "")), F.length(F.regexp_replace(bare, "[^A-Za-z]+", "")))
        low = F.lower(F.coalesce(lang, F.lit("auto")))
        of = lambda n: F.when(low.startswith("ru"), n[0]).when(low.startswith("en"), n[1]).otherwise(F.greatest(n[0], n[1]))
        return bound(letters, lambda n: F.round(of(n) / F.greatest(F.lit(1), n[0] + n[1]), 4))

    return bound(squeeze(text), share)


def unique_share(words: Column) -> Column:
    return bound(words, lambda w: F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w)))


def occurrences(text: Column, parts: Sequence[str]) -> Column:
    """How often any of some strings occurs in a text. Most texts hold no first letter of any, and are read once."""
    # no lambda: so it can be in an argument of a Python function
    each = [((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / F.lit(len(m))).cast("int") for m in parts]
    return F.when(text.rlike("[" + "".join(sorted({re.escape(m[0]) for m in parts})) + "]"), reduce(add, each)).otherwise(0)


def misread(bare: Column, words: Column) -> Column:
    """looks_misread() of a squeezed text with its tokens."""
    length = F.greatest(F.lit(1), F.length(bare))
    strange = ~F.arrays_overlap(words, strings(lexicons.COMMON_RUSSIAN + lexicons.COMMON_ENGLISH))
    cyrillic = F.length(F.regexp_replace(bare, r"[^\x{0400}-\x{04FF}]+", "")) / length
    leading = occurrences(bare, ("Р", "С")) >= F.greatest(F.lit(4), F.floor(length / 6))
    hits = occurrences(bare, lexicons.MISREAD_MARKERS)
    return (bare != "") & ((hits >= 2) | (strange & (leading | ((F.size(words) >= 2) & (cyrillic > 0.32)))) | ((F.size(words) <= 2) & (hits >= 1) & (cyrillic > 0.25)))


def looks_misread(text: Column) -> Column:
    """Whether a text is mis-encoded: two marker hits; no common word, and many leading bytes or a third Cyrillic; or one
    hit in a text of two words or fewer that is Cyrillic by a quarter. White space is squeezed; texts are taken as they
    are composed."""
    return bound(squeeze(text), lambda bare: bound(tokens(bare), lambda words: misread(bare, words)))


def cyrillic_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x{0400}-\x{04FF}]+", "")) / F.greatest(F.lit(1), F.length(text))


def word_runs(text: Column) -> Column:
    """Lower-case runs of Latin and Russian letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-zА-Яа-яЁё0-9']+"), F.lit(0))


def misread_title(text: Column) -> Column:
    """How titles are judged: as looks_misread(), but white space stays, a letter before a dash and a stray accented one is a
    sign too, and a third Cyrillic is one only beside a marker. A null text isn't misread."""

    def judged(words: Column) -> Column:
        strange = ~F.arrays_overlap(words, strings(lexicons.COMMON_RUSSIAN + lexicons.COMMON_ENGLISH))
        leading = occurrences(text, ("Р", "С")) >= F.greatest(F.lit(4), F.floor(F.length(text) / 6))
        share = lambda least: cyrillic_share(text) > least
        marked = lambda hits: (hits >= 2) | text.rlike("[A-Za-z] — [è÷òàü]") | (strange & (leading | ((hits >= 1) & (F.size(words) >= 2) & share(0.32)))) | ((F.size(words) <= 2) & (hits >= 1) & share(0.25))
        return bound(occurrences(text, lexicons.MISREAD_MARKERS), marked)

    return F.coalesce((text != "") & bound(word_runs(text), judged), F.lit(False))


def misread_report(text: Column) -> Column:
    """How reports judge what they show: two marker hits, or two words or more without a common one that are Cyrillic by
    more than 0.38. A null text isn't misread."""

    def judged(bare: Column) -> Column:
        words = word_runs(bare)
        strange = ~F.arrays_overlap(words, strings(lexicons.REPORT_COMMON))
        return (bare != "") & ((occurrences(bare, lexicons.MISREAD_MARKERS) >= 2) | (strange & (F.size(words) >= 2) & (cyrillic_share(bare) > 0.38)))

    return F.coalesce(bound(squeeze(text), judged), F.lit(False))


def odd(bare: Column, words: Column, share: Column) -> Column:
    """suspicious() of a squeezed text with its tokens, of which so large a share is distinct."""
    return (bare == "") | (F.size(words) == 0) | (share < 0.35) | bare.rlike(r"(.)\1{4,}") | misread(bare, words)


def suspicious(text: Column) -> Column:
    """Empty, mis-encoded, one character five times in a row, no token, or mostly repeated tokens."""
    words = lambda bare: bound(tokens(bare), lambda w: odd(bare, w, F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))))
    return bound(squeeze(text), words)


def text_sanity(text: Column, lang: Column) -> Column:
    """Score in 0..1 from language, variety, punctuation, repetition and very short tokens."""

    def rated(bare: Column, words: Column, share: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(words))
        short = F.least(F.lit(0.20), F.size(F.filter(words, lambda w: F.length(w) <= 2)) / n * 0.22)
        repeated = F.least(F.lit(0.22), F.greatest(F.lit(0.0), 0.58 - share) * 0.65)
        bonus = F.when(bare.rlike("[.!?]$"), 0.10).otherwise(0.0) + F.when(F.size(words) >= 6, 0.06).otherwise(0.0)
        score = 0.50 + language_consistency(bare, lang) * 0.22 + share * 0.18 + bonus
        score = score - F.when(odd(bare, words, share), 0.28).otherwise(0.0) - short - repeated
        return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))

    return bound(squeeze(text), lambda bare: bound(tokens(bare), lambda words: bound(unique_share(words), lambda share: rated(bare, words, share))))


def topic_phrase(text: Column) -> Column:
    """The first five distinct plain words; words of three characters or more where there are none."""
    loose = F.filter(F.regexp_extract_all(F.lower(squeeze(text)), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 2)
    chosen = bound(plain_words(text), lambda plain: F.when(F.size(plain) > 0, plain).otherwise(loose))
    return F.array_join(F.slice(F.array_distinct(chosen), 1, 5), " ")


def shorten(text: Column, most: int, ending: str = "") -> Column:
    """At most `most` characters, cut back to a word boundary where there is one."""
    bare = squeeze(text)
    head = F.substring(bare, 1, most)
    cut = F.rtrim(F.regexp_extract(head, r"^(.*) ", 1))
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit(ending)))


#: Letters whose capital upper() gives as two letters, and the one letter that is their capital, where there is one.
CAPITALS = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1}


def capitalise(text: Column) -> Column:
    """With a capital first, one letter for one: a letter that has none stays."""

    def shown(whole: Column) -> Column:
        first = F.translate(F.substring(whole, 1, 1), "".join(CAPITALS), "".join(CAPITALS.values()))
        capital = F.upper(first)
        return F.concat(F.when(F.length(capital) == F.length(first), capital).otherwise(first), F.substring(whole, F.lit(2), F.length(whole)))

    return bound(text, shown)


def collapse_marks(text: Column) -> Column:
    """Repeated punctuation marks once."""
    return F.regexp_replace(text, r"([!?.,;:])\1+", "$1")


def drop_repeats(words: Column) -> Column:
    """Words without those equal to the word before, whatever their case."""
    return bound(words, lambda every: F.filter(every, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(every, i - 1)))))


def slug(text: Column) -> Column:
    """'#' and a text with '_' for spaces, without other characters than letters and digits; null where none is left."""
    bare = F.regexp_replace(F.replace(squeeze(text), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]+", "")
    bare = F.regexp_replace(bare, "^_+|_+$", "")
    return F.when(bare != "", F.concat(F.lit("#"), bare))


def nfc(text: Column) -> Column:
    """A text in Unicode's composed form, which no built-in function makes; of texts, only those beyond ASCII are sent."""

    @F.pandas_udf(StringType())
    def composed(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    wide = text.rlike(r"[^\x00-\x7f]")
    return F.when(wide, composed(F.when(wide, text))).otherwise(text)


def file_name(title: Column, most: int = 110) -> Column:
    """A title as a file name: tidy and composed, without reserved characters or a closing full stop, at most `most`
    characters up to a word's end, 'clip' where nothing is left."""
    sound = squeeze(F.regexp_replace(F.regexp_replace(nfc(tidy(title)), r'[<>:"/\\|?*\x00-\x1f]', ""), r"[ .]+$", ""))
    head = F.substring(sound, 1, most)
    cut = F.trim(F.regexp_extract(head, "^(.*) ", 1))
    short = F.when(F.length(sound) <= most, sound).otherwise(F.when(cut != "", cut).otherwise(head))
    return F.when(short == "", "clip").otherwise(short)


def timestamp(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    ms = ms.cast("long")
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    shown = F.when(hours < 10, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), part(F.pmod(F.floor(ms / 60_000), F.lit(60)), 2), F.lit(":"), part(F.pmod(F.floor(ms / 1000), F.lit(60)), 2), F.lit(","), part(F.pmod(ms, F.lit(1000)), 3))


def caption_lines(text: Column, most: int = 34) -> Column:
    """One or two lines: words go on the first line until one would pass `most` characters; the rest follows."""
    words = F.split(squeeze(text), " ")
    start = F.struct(F.lit("").alias("a"), F.lit("").alias("b"))
    glue = lambda left, w: F.when(left == "", w).otherwise(F.concat(left, F.lit(" "), w))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["b"] == "") & ((acc["a"] == "") | (F.length(glue(acc["a"], w)) <= most))
        return F.struct(F.when(fits, glue(acc["a"], w)).otherwise(acc["a"]).alias("a"), F.when(fits, acc["b"]).otherwise(glue(acc["b"], w)).alias("b"))

    def join(acc: Column) -> Column:
        return F.when(acc["b"] == "", acc["a"]).otherwise(F.concat(acc["a"], F.lit("\n"), acc["b"]))

    return F.when(F.size(words) <= 2, squeeze(text)).otherwise(F.aggregate(words, start, step, join))


def line_split(lengths: Column, most: int = 34) -> Column:
    """How many words the first of two caption lines takes: the cheapest split by overflow (20 a character), uneven
    lines and a word alone (3); the first of equals. lengths: of the words, three or more."""


    def cost(sums: Column, n: Column, k: Column) -> Column:
        a = F.element_at(sums, k + 1) + k - 1
        b = F.element_at(sums, n + 1) - F.element_at(sums, k + 1) + n - k - 1
        over = F.greatest(F.lit(0), a - most) + F.greatest(F.lit(0), b - most)
        alone = F.when(F.least(k, n - k) == 1, 3).otherwise(0)
        return F.struct((over * 20 + F.abs(a - b) + alone).alias("cost"), k.alias("k"))

    def best(sums: Column) -> Column:
        n = F.size(sums) - 1
        return F.when(n > 2, F.array_min(F.transform(F.sequence(F.lit(1), n - 1), lambda k: cost(sums, n, k)))["k"])

    # running sums, bound once as the only element of an array
    sums = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.get(F.transform(F.array(sums), best), F.lit(0))
