"""Word lists, templates, labels and weights that results depend on."""

# words that leak the label of an example
LABEL_WORDS = ("literal", "idiomatic")

# words that end an interactive session
STOP_WORDS = ("exit", "stop", "quit", "q")

# class number → display label
LABELS = {0: "Literal", 1: "Idiomatic"}

# short contexts around an entity: (text before, text after, label)
WEAK_CONTEXTS = (("", "", 1), ("she ", "", 1), ("", " on the floor", 0), ("", " in the cup", 0))

# labelled parts of a bank text, in order
BANK_PARTS = ("idiom: ", ". idiom: ", ". meaning: ", ". paraphrase: ", ". explanation: ", ". usage: ")

# failure types: shared word, both short, otherwise
FAILURE_TYPES = ("Lexical Confusion", "Short/Ambiguous Idioms", "Semantic Confusion")
SHORT_WORDS = 3

# error types: right, gold at rank 2 or 3, otherwise
ERROR_TYPES = ("Correct", "Near-miss (Top-3)", "Hard error")

# lexical scoring
K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_FEATURES, MIN_DF = 30_000, 2

# fusion, phrase boost, low-confidence limit
DENSE_WEIGHT, DEMO_DENSE_WEIGHT = 0.8, 0.65
PHRASE_BOOST, PHRASE_THRESHOLD = 0.20, 0.85
SURE = 0.90
