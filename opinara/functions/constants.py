"""Word lists and thresholds.

FIXED VALUES.  Results depend on these exact values, so they are stated as plain
data and must not be edited for style.
"""

from __future__ import annotations

# Class names, in alphabetical (= index) order and in display order.
CLASSES = ("Negative", "Neutral", "Positive")
DISPLAY_ORDER = ("Positive", "Neutral", "Negative")

# Negators of the training profile (window 3) and of the serving profile (window 2).
NEGATORS = ("not", "no", "never", "nor", "none", "nothing", "nowhere")
SERVING_NEGATORS = ("not", "no", "never", "n't")

# Names under which a text column is looked for, in order.
TEXT_COLUMNS = ("text", "reviewText", "message", "content", "review")

# The common 179-word English stop list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its itself
    they them their theirs themselves what which who whom this that that'll these those
    am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such
    no nor not only own same so than too very s t can will just don don't should should've
    now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn
    hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
    wouldn't
    """.split()
)

# Noun suffix rules (ending, replacement).
NOUN_RULES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# Compound-score constants as published for the rule-based valence model.
COMPOUND_ALPHA = 15.0
COMPOUND_THRESHOLD = 0.05
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
BOOST_DECAY = (1.0, 0.95, 0.9)
EXCLAIM_STEP = 0.292
EXCLAIM_MAX = 4
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "enormously", "entirely", "especially", "exceptionally", "extremely",
    "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "majorly", "more",
    "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "totally", "tremendously", "unbelievably",
    "unusually", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta",
)
RULE_NEGATORS = (
    "ain't", "aint", "aren't", "arent", "can't", "cannot", "cant", "couldn't", "couldnt",
    "didn't", "didnt", "doesn't", "doesnt", "don't", "dont", "hadn't", "hadnt", "hasn't",
    "hasnt", "haven't", "havent", "isn't", "isnt", "neither", "never", "none", "nope",
    "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldn't", "shouldnt",
    "wasn't", "wasnt", "weren't", "werent", "without", "won't", "wont", "wouldn't",
    "wouldnt",
)

# Rating blend.
LENGTH_FULL_WORDS = 100.0
CONFIDENCE_WEIGHTS = (0.5, 0.3, 0.2)  # strength, agreement, length
ALPHA_BLEND = 0.6
DISAGREEMENT_THRESHOLD = 1.5

# Text-generation instructions.
SUMMARY_INSTRUCTION = (
    "You are an assistant. Summarise the following customer review in 50 words or fewer. "
    "Return only the summary with no extra text.\n\nReview: "
)
SERVICE_INSTRUCTION = (
    "You are a professional and empathetic customer service representative "
    "for an Amazon Gift Cards product. Respond politely, address the "
    "customer's concern directly, and offer helpful next steps."
)
SERVICE_PREFIX = "Customer review: "
SUMMARY_TOKENS = 80
SERVICE_TOKENS = 150
LONG_REVIEW_WORDS = 100
QUESTION_REVIEW_WORDS = 20
SUMMARY_WORD_LIMIT = 50
