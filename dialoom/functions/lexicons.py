"""The word lists and names that the text operators look for. Matching is by substring, lower-case."""

# Fixed values that results depend on, in their natural order.
HOOK = (
    "wait", "stop", "listen", "look", "what", "why", "seriously", "really", "don't", "no way", "you're kidding", "impossible",
    "unbelievable", "i can't believe", "tell me", "how could", "what happened", "what did", "who did", "did you", "are you",
    "is that", "you mean",
    "стой", "подожди", "слушай", "послушай", "смотри", "что", "почему", "зачем", "серьёзно", "серьезно", "не может быть",
    "чёрт", "черт", "ты шутишь", "ты серьёзно", "скажи мне", "как ты мог", "что случилось", "что произошло", "кто это",
    "ты знаешь", "ты сказал", "ты имеешь в виду", "невероятно", "не верю", "расскажи", "объясни",
)
CONFLICT = (
    "no", "never", "lied", "lie", "blame", "wrong", "angry", "anger", "fight", "accuse", "accused", "betrayed", "betray",
    "hate", "hated", "shut up", "leave me", "go away", "how dare", "fault", "your fault", "you always", "you never",
    "you don't", "you can't", "you won't", "it's over", "done with", "get out", "leave", "stop it",
    "нет", "никогда", "ложь", "лжёшь", "врёшь", "обвиняю", "обвинять", "виноват", "виновата", "злой", "злая", "злится",
    "предал", "предала", "предательство", "ненавижу", "замолчи", "уходи", "оставь меня", "как ты смеешь", "как ты смеёшь",
    "твоя вина", "ты всегда", "ты никогда", "ты не можешь", "всё кончено", "убирайся", "не смей", "хватит", "не верю тебе",
    "ты лжёшь", "это твоя вина",
)
ESCALATION = (
    "you always", "you never", "every time", "every single", "again", "still", "enough", "that's it", "that's enough",
    "i'm done", "i give up", "once and for all", "for the last time", "over and over", "constantly", "all the time",
    "you never listen", "you never care", "stop this",
    "ты всегда", "ты никогда", "каждый раз", "снова", "опять", "хватит", "всё", "достаточно", "я устал", "я устала",
    "я сдаюсь", "раз и навсегда", "в последний раз", "постоянно", "всё время", "ты не слушаешь", "ты не слышишь",
    "прекрати это", "до чего дошло", "так нельзя", "сколько можно",
)
EMOTION = (
    "cry", "crying", "tears", "laugh", "laughing", "smile", "smiling", "angry", "anger", "scared", "fear", "afraid", "hurt",
    "hurts", "pain", "love", "loved", "hate", "hated", "miss", "missed", "lonely", "alone", "happy", "happiness", "sad",
    "sadness", "broken", "shaking", "trembling", "sobbing", "screaming", "yelling", "whisper",
    "плачет", "плачу", "слёзы", "смеётся", "смеюсь", "улыбается", "злится", "злюсь", "боюсь", "страх", "испугался",
    "испугалась", "больно", "боль", "люблю", "любишь", "ненавижу", "скучаю", "одиноко", "одинок", "один", "одна", "счастлив",
    "счастлива", "грустно", "грусть", "разбит", "разбита", "дрожит", "дрожу", "кричит", "кричу", "шепчет", "шепчу",
)
PAYOFF = (
    "finally", "that's why", "because", "the truth", "i understand", "i see now", "i see", "resolution", "sorry", "i'm sorry",
    "forgive", "forgive me", "you're right", "you were right", "i was wrong", "it makes sense", "now i know", "i realise",
    "i realize", "i admit", "i was afraid", "i couldn't", "thank you", "i love you", "i needed", "it's okay", "we're okay",
    "everything will", "it will be",
    "наконец", "наконец-то", "вот почему", "потому что", "правда", "я понял", "я поняла", "я понимаю", "теперь понимаю",
    "извини", "извините", "прости", "простите", "ты прав", "ты права", "ты был прав", "ты была права", "я был неправ",
    "я была неправа", "теперь я знаю", "я осознал", "я осознала", "признаю", "я боялся", "я боялась", "не мог", "не могла",
    "спасибо", "я люблю тебя", "всё будет", "всё хорошо", "мне нужно было",
)
CAUSAL = (
    "because", "therefore", "so", "thus", "as a result", "that's why", "due to", "which means", "which led", "which caused",
    "consequently", "hence", "for that reason", "as a consequence", "that is why",
    "потому что", "поэтому", "из-за", "в результате", "вот почему", "следовательно", "значит", "отсюда", "это означает",
    "по этой причине", "в связи с", "вследствие", "тем самым", "что привело",
)
STOP_WORDS = (
    "that", "this", "these", "those", "with", "from", "have", "just", "been", "were", "they", "them", "their", "what", "which", "when", "where", "will", "would", "could", "should", "does", "didn", "don", "isn", "aren", "wasn",
    "weren", "hasn", "haven", "hadn", "about", "into", "than", "then", "there", "here", "also", "only", "very", "more", "some", "your", "mine", "ours", "yours", "theirs", "such", "each", "both", "same", "other", "back", "even",
    "still", "well", "said", "like", "know", "think", "want", "come", "going", "make", "take", "look", "good", "right", "over", "after", "before",
    "это", "этот", "этой", "эти", "тебя", "тебе", "меня", "мной", "тобой", "него", "неё", "нему", "ней", "нами", "вами", "ними", "себя", "себе", "собой", "свой", "своя", "своё", "свои", "которые", "который", "которая",
    "которое", "когда", "куда", "откуда", "потом", "затем", "здесь", "туда", "сюда", "тоже", "также", "очень", "более", "менее", "самый", "такой", "такая", "такие", "такое", "уже", "ещё", "даже", "если", "чтобы", "хотя",
    "пока", "после", "перед", "между", "через", "около", "против", "будет", "будут", "есть", "была", "было", "были", "быть", "иметь", "надо", "нужно", "можно", "нельзя", "хочу", "хочет", "хотят", "знаю", "знает", "знают",
    "идти", "иди", "идём", "говорить", "скажи", "скажет", "сказал", "сказала", "тогда", "всегда", "никогда", "иногда", "сейчас", "теперь", "просто", "только", "всего", "всём", "много", "мало", "вообще",
)

# What UTF-8 read as another encoding leaves, and common words that mark a sound text.
MISREAD_MARKERS = ("Ð", "Ñ", "Гђ", "Г‘", "Гѓ", "Г‚", "Гўв‚¬", "Гўв‚¬вЂќ", "Гўв‚¬вЂњ", "РЎ", "Рћ", "СЌ", "Сѓ", "Рє")
COMMON_RUSSIAN = ("это", "ведь", "правда", "кстати", "теперь", "все", "не", "да", "нет", "что", "как", "с", "на", "я", "ты", "мы", "вы", "он", "она", "они", "словом", "послушай", "смотри")
COMMON_ENGLISH = ("this", "that", "what", "why", "look", "listen", "now", "okay", "right", "yes", "no", "we", "you", "they", "it")

# Common words that the reports' detector knows.
REPORT_COMMON = ("это", "ведь", "правда", "теперь", "все", "не", "да", "нет", "что", "как")

# Type names and the stems that decide them, first match wins.
CONFLICT_TYPES = (
    ("accusation", ("accus", "обвин", "blame", "вина")),
    ("denial", ("deny", "отрица", "не правда", "неправда")),
    ("betrayal", ("betray", "предал", "предател", "изменил")),
    ("revelation", ("reveal", "правд", "узнал", "понял", "truth")),
    ("threat", ("threat", "угроз", "danger", "опас")),
    ("argument", ("fight", "спор", "ссора", "argument")),
)
HOOK_TYPES = (
    ("question", ("?", "why", "what", "who", "how", "where", "почему", "что", "кто", "зачем", "когда")),
    ("accusation_denial", ("accus", "обвин", "blame", "вина", "you did", "ты сделал")),
    ("threat_tension", ("threat", "угроз", "danger", "опас", "or else", "или иначе")),
    ("reveal_discovery", ("reveal", "truth", "правд", "узнал", "понял", "found out", "discover")),
    ("funny_setup", ("laugh", "шут", "смеш", "comedy", "шутк", "funny", "joke")),
    ("social_awkwardness", ("embarr", "стыд", "awkward", "нелов", "uncomfortable")),
)
PAYOFF_TYPES = (
    ("reveal", ("reveal", "truth", "правд", "раскр", "узнал", "понял", "found out")),
    ("punchline", ("laugh", "смеш", "шут", "comedy", "punchline", "funny", "joke")),
    ("resolution", ("sorry", "извин", "forgive", "мир", "peace", "прости")),
    ("resolution", ("agree", "соглас", "окей", "ладно", "fine", "okay")),
    ("conflict", ("fight", "argument", "спор", "ссора", "blow")),
)
SCENE_MOODS = (
    ("tension", ("убью", "стой", "нет", "нельзя", "труп", "кров", "страш", "ужас")),
    ("humor", ("смешно", "ха", "шут", "улыб", "весело")),
    ("conversation", ("почему", "зачем", "правда", "знаешь", "послушай")),
)
ARC_SHAPES = ("incomplete_story_chain", "hook_only", "hook_setup", "hook_setup_escalation", "hook_setup_escalation_payoff")
REVIEW_LABELS = ("excellent", "good", "publishable", "bad", "boring", "confusing", "wrong_focus", "subtitle_bad", "late_hook", "unclear_context")
ROOT_CAUSES = (
    "late_hook", "late_entry", "weak_hook", "speaker_unclear", "wrong_face_focus", "subtitle_overload", "bad_pacing",
    "missing_context", "weak_payoff", "crop_jitter", "too_slow", "too_fast", "confusing_dialogue", "bad_title",
)
ENGLISH_STOP_WORDS = ("this", "that", "with", "have", "what", "when", "where", "your", "from", "they", "them")
