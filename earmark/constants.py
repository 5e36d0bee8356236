"""Fixed values. They decide results, so they are stated here once and plainly."""

# The nine label columns of a judged item, in column order.
LABEL_COLUMNS = (
    "inst_piano",
    "inst_orchestral",
    "inst_vocal",
    "mood_sad_melancholic",
    "mood_relaxing",
    "mood_dark_tense",
    "mood_exciting",
    "mood_elegant",
    "mood_epic",
)
MOOD_COLUMNS = tuple(c for c in LABEL_COLUMNS if c.startswith("mood_"))

# The three primary tags with the word that stands for each in a prompt.
PRIMARY_TAGS = (
    ("inst_piano", "piano"),
    ("inst_vocal", "vocal"),
    ("mood_relaxing", "relaxing"),
)

# Label column of a public data set for each primary tag.
PUBLIC_LABELS = {
    "inst_piano": "gold_pub_piano",
    "inst_vocal": "gold_pub_vocal",
    "mood_relaxing": "gold_pub_relaxing",
}

# Annotation columns of the wide table that count as vocal or relaxing.
WIDE_VOCAL_COLUMNS = ("vocals", "male vocal", "female voice", "singer", "voice")
WIDE_RELAXING_COLUMNS = ("calm", "mellow")

# The default query set (query_id, query_type, label, query_text).
DEFAULT_QUERIES = (
    ("inst_piano", "instrumentation", "piano", "piano music"),
    ("inst_orchestral", "instrumentation", "orchestral", "orchestral music"),
    ("inst_vocal", "instrumentation", "vocal", "vocal music"),
    ("mood_sad_melancholic", "mood", "sad/melancholic", "sad melancholic music"),
    ("mood_relaxing", "mood", "relaxing", "relaxing music"),
    ("mood_dark_tense", "mood", "dark/tense", "dark tense music"),
    ("mood_exciting", "mood", "exciting", "exciting music"),
    ("mood_elegant", "style", "elegant", "elegant refined sophisticated music"),
    ("mood_epic", "style", "epic", "epic cinematic grand orchestral music"),
)

# Tempo classes; below the first bound, up to the second bound, above it (beats per minute).
TEMPO_LABELS = ("slow", "mid-tempo", "fast")
TEMPO_BOUNDS = (80.0, 120.0)
TEMPO_PROMPTS = (
    "a slow tempo music track",
    "a mid-tempo music track",
    "a fast tempo music track",
)
TEMPO_QUERY_TEXTS = (
    "slow gentle ballad soft pacing low BPM relaxed understated",
    "moderate steady mid-tempo walking groove even rhythm mid pacing",
    "fast driving upbeat energetic high BPM quick rhythm danceable",
)

# Labels of the domain trade-off rules.
TRADEOFF_FORGETTING = "Forgetting-dominated (mixed recovers OOD)"
TRADEOFF_SPECIALISATION = "Specialization (anime-only wins in-domain)"
TRADEOFF_HURTS_BOTH = "Mixed hurts both — check ratio / leakage"
TRADEOFF_NONE = "No clear tradeoff — arms similar"

# Key prefixes of the audio store and the clip store.
SOURCE_PREFIX = "data/music_db/"
CLIP_MARKER = "music_db_15s/"

# The white space that keys and texts are stripped of at both ends (as Unicode defines it).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Tags with their label column and prompt, for each public data set. OpenMIC has no labels for relaxing.
_PIANO, _VOCAL, _RELAXING = (
    ("inst_piano", "gold_pub_piano", "piano"), ("inst_vocal", "gold_pub_vocal", "vocal"), ("mood_relaxing", "gold_pub_relaxing", "relaxing"))
PUBLIC_TAGS = {"jamendo": (_PIANO, _VOCAL, _RELAXING), "mtat": (_PIANO, _VOCAL, _RELAXING), "openmic": (_PIANO, _VOCAL)}
