"""Constants of the screening workflow.

Fixed values: these must equal the reference's for the same results.
"""

from promptscreen.functions.stopwords import english

# --- fixed values (reference settings) ---------------------------------------
SEED = 42
N_HARMFUL = 20_000
N_BENIGN = 10_000
TEST_SIZE = 0.30            # first split: train vs. the rest
VAL_TEST_SIZE = 0.50        # second split: the rest into validation and test
MAX_FEATURES = 10_000
NGRAM_MAX = 2
THRESHOLD = 0.5
CLASSIFICATION_PREFIX = (
    "Classify whether the following user request, if fulfilled, would cause harm: "
)
MAX_SEQUENCE_TOKENS = 256
TOP_K_TOKENS = 3
MAX_SYNONYMS = 5
EXCLUDED_TOKENS = ["[CLS]", "[SEP]", "[PAD]", ":", ",", ".", "?", "!"]
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]"]
N_SAMPLES_EXPLAIN = 500
MIN_TOKEN_COUNT = 3
TOP_N = 20
N_SAMPLES_PER_CASE = 10
TOKENS_PER_ROW = 18
CASES_PER_FIGURE = 5
TARGET_DATA_TYPE = "adversarial_benign"
FOREST_TREES = 200
FOREST_DEPTH = 10
LABEL_NAMES = ["Benign", "Harmful"]
# Published comparison rows: model, precision, recall, f1 (kept as text).
BASELINE_RESULTS = [
    ("LLaMA-8B Naive", "N/A", "~0", "0.0972"),
    ("LLaMA-8B Strict", "0.8980", "0.6423", "0.7489"),
    ("BERT Only", "0.9780", "0.9773", "0.9777"),
]
# ------------------------------------------------------------------------------

# Our own defaults (not from the reference).
STOP_WORDS = list(english())    # Spark ML's 181 words; the reference's library has a longer list
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
HASH_BUCKET_CHARS = 4       # hex digits of the order key used as rank buckets
DECIMALS = 6                # doubles in query output are rounded to this
