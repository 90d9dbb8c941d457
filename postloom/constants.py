"""Fixed values that results depend on."""

# The labels a dataset row may carry.
FLAIRS = [
    "Need Support",
    "Venting",
    "Opinion / Thoughts",
    "Sadness / Grief",
    "Good News / Happy",
    "Inspiration / Encouragement",
    "Resources",
    "Research Study",
]

# Community, body texts of removed posts, excluded and bare author names, prefixes.
COMMUNITY = "mentalhealth"
TOMBSTONES = ["[deleted]", "[removed]"]
EXCLUDED_AUTHOR = "AutoModerator"
DELETED_AUTHOR = "[deleted]"
AUTHOR_PREFIX = "u/"
LINK_PREFIX = "https://www.reddit.com"

# Dump file names and the month inside them.
DUMP_GLOB = "R[CS]_*.zst"
MONTH_PATTERN = r"(\d{4}-\d{2})"

# ASCII punctuation, URL pattern, word pattern of the vectorizer.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
URL_PATTERN = r"(?U)https?://[^\s\x1C-\x1F]+"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
SPACE_PATTERN = r"[\t-\r\x1C-\x20]+"
TERM_PATTERN = r"(?U)\b\w\w+\b"

# Words the tokenizer splits in two.
SPLIT_WORDS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]

# Noun endings and what replaces them.
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# English stopwords (entries with an apostrophe never match punctuation-free text).
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
