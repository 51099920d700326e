"""Formats, budgets, type lists and names that results depend on."""

# The five text formats, in the order that breaks ties.
FORMATS = ["csv", "json", "keyvalue", "markdown", "sql_schema"]

# Packing and fitting.
TOKEN_BUDGET = 3800
MAX_CELL_CHARS = 500

# Held-out chunks, sample size and seed of the evaluation set.
HELD_OUT_CHUNKS = [24, 25]
SAMPLE_TABLES = 300
SAMPLE_SEED = 42

# Statement pairs.
PAIR_TYPES = ["lookup", "aggregation", "comparison", "inference", "multihop"]
MAX_ATTEMPTS = 2
MAX_SEQUENCE = 4096

# Training runs: tokens per step and the target step.
TOKENS_PER_STEP = 256 * 4096
TARGET_TOKENS = 30_000_000_000
TARGET_STEP = TARGET_TOKENS // TOKENS_PER_STEP
EXPERIMENT = r"^tabular-(csv|json|keyvalue|markdown|sql_schema)-1p5b(?:-seed([0-9]+))?-([0-9]+)$"
EXPERIMENT_IN_PATH = r"tabular-(csv|json|keyvalue|markdown|sql_schema)-1p5b"
CHECKPOINT_DIR = r"^iter_([0-9]+)$"

# Token shards.
TOKEN_SHARDS = 28
TRAIN_SHARDS = 24
TRAIN_PER_MILLE = 983

# Index file of a token shard: magic, then version u64, type u8, sequences u64, documents u64.
INDEX_MAGIC = b"MMIDIDX\x00\x00"
INDEX_HEADER_BYTES = 34
INDEX_TYPE_CODES = [1, 2, 3, 4, 5, 6, 7, 8]
TOKEN_BYTES = 4

# Words are what lies between whitespace, in the sense of Python's str.split(). The pattern
# covers ASCII; the other whitespace characters are mapped to spaces first.
WORD = r"[^\t-\r\x1c-\x20]+"
WIDE_SPACES = (
    "\x85\xa0        "
    "        　"
)
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + WIDE_SPACES
