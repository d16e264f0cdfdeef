"""Fixed values that must equal the reference's for identical results."""

# --- fixed values: evaluation -------------------------------------------
# Report / evaluation language order.
LANGUAGES = [
    "english", "arabic", "bengali", "finnish", "indonesian", "japanese",
    "swahili", "korean", "russian", "telugu", "thai",
]
# Language left out of the macro average.
EXCLUDED_LANGUAGE = "english"
# Annotator vote thresholds.
PASSAGE_NON_NULL_THRESHOLD = 2
MINIMAL_NON_NULL_THRESHOLD = 2
# Precision targets of the recall-at-precision table.
PRECISION_TARGETS = [0.5, 0.75, 0.9]

# --- fixed values: language ids (enumeration order) ---------------------
LANGUAGE_IDS = {
    "arabic": 0, "bengali": 1, "finnish": 2, "indonesian": 3, "japanese": 4,
    "swahili": 5, "korean": 6, "russian": 7, "telugu": 8, "thai": 9,
    "english": 10,
}

# --- fixed values: answer types -----------------------------------------
ANSWER_TYPES = {"UNKNOWN": 0, "YES": 1, "NO": 2, "MINIMAL": 3, "PASSAGE": 4}

# --- fixed values: preparation defaults ---------------------------------
MAX_PASSAGES = 45
MAX_POSITION = 45
MAX_SEQ_LENGTH = 512
DOC_STRIDE = 128
MAX_QUESTION_LENGTH = 64
INCLUDE_UNKNOWNS = -1.0
MAX_OVERSAMPLE_RATIO = 10
MAX_INPUT_CHARS_PER_WORD = 200
UNK_TOKEN = "[UNK]"
CONTINUATION_PREFIX = "##"
QUESTION_MARKER = "[Q]"

# Special tokens kept whole by the offset-preserving tokenizer, plus any token
# starting with one of SPECIAL_TOKEN_PREFIXES.
SPECIAL_TOKENS = [
    "[CLS]", "[SEP]", "[PAD]", "[Q]", "[YES]", "[NO]", "[NoLongAnswer]",
    "[NoShortAnswer]", "[SA]", "[/SA]", "[UNK]", "[MASK]",
]
SPECIAL_TOKEN_PREFIXES = ["[Paragraph=", "[ContextId="]
UNUSED_TOKEN_PATTERN = r"^\[unused\d+\]$"

# --- fixed values: post-processing --------------------------------------
CANDIDATE_BEAM = 30
MAX_ANSWER_LENGTH = 100

# --- fixed values: gold-passage task ------------------------------------
GOLDP_LANGUAGES = [
    "english", "arabic", "bengali", "finnish", "indonesian", "swahili",
    "korean", "russian", "telugu",
]
GOLDP_ENGLISH_LABEL = "english-DO-NOT-AVERAGE"
