"""Parameter defaults and the fixed values every result depends on."""

from __future__ import annotations

# ---- fixed values: classifier names with their capability rank ----------------------------
MODEL_TIERS = {
    "wd-vit-tagger-v3": 1,
    "wd-swinv2-tagger-v3": 2,
    "wd-vit-large-tagger-v3": 3,
    "wd-eva02-large-tagger-v3": 4,
}

# ---- fixed values: skip reasons, label category codes, reject codes -----------------------
SKIP_SAME_MARKER = "wd_model_marker_present"
SKIP_HIGHER_TIER = "wd_skip_higher_tier_model_present"
GENERAL, CHARACTER, RATING = 0, 4, 9
REJECT_OUTCOMES = ("empty_queue", "invalid_request")

# ---- parameter defaults -------------------------------------------------------------------
DEFAULT_MODEL = "wd-vit-tagger-v3"
MARKER_PREFIX = "wd14:"
GENERAL_THRESHOLD = 0.35
CHARACTER_THRESHOLD = 0.85
GENERAL_PREFIX = ""
CHARACTER_PREFIX = "character:"
RATING_PREFIX = "rating:"
SCORE_BATCH = 8
# Files fetched at once.
FETCH_PARALLEL = 8
APPLY_EVERY = 8
SKIP_TAIL_BATCH = 512
LEARNING_FRACTION = 0.1
LEARNING_MIN_FILES = 32
TUNING_WINDOW = 32
WARM_UP_BATCHES = 3
PAGE_SIZE = 50
RESULTS_PAGE_SIZE = 25

# ---- fixed values: artifact checks ---------------------------------------------------------
REQUIRED_ARTIFACTS = ("model.onnx", "selected_tags.csv")
REQUIRED_LABEL_COLUMNS = ("category", "name", "tag_id")
MIN_MODEL_BYTES = 1_000_000
MIN_LABEL_BYTES = 800
MIN_LABEL_ROWS = 100

# A label table is one classifier's vocabulary (about ten thousand rows). It is embedded in a
# plan as one value, so its size is checked against this bound first.
MAX_LABELS = 200_000

# Rows of one ordered group that a single task may hold at once (see operators/ordered.py).
CHUNK_ROWS = 65_536
