"""They must equal those of the pipelines whose corpora this library reads and extends."""

# Label codes.
SENTIMENT_CODES = {"neutral": 0, "bullish": 1, "bearish": 2}
PROMPT_CODES = {"neutral": 0, "positive": 1, "negative": 2}
GENERAL_TO_CANONICAL = {0: 2, 1: 0, 2: 1}
TO_POLARITY = {"bullish": "positive", "bearish": "negative"}
SCORE_LABELS = ["NEUTRAL", "BULLISH", "BEARISH"]

# Mask tokens.
URL_TOKEN = "[URL]"
USER_TOKEN = "@USER"
TICKER_TOKEN = "[TICKER]"

# Words that give a generated post away.
META_WORDS = ["sentiment", "tweets", "synthetic"]
LEAKED_LABELS = ["positive", "negative", "neutral"]

# Code point ranges in which a repeated character is collapsed, in code point order.
EMOJI_RANGES = [
    (0x24C2, 0x1F251),
    (0x2702, 0x27B0),
    (0x1F1E0, 0x1F1FF),
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
]

# Prompt sent to the text generator: opening (with the class in capitals), the examples, closing.
PROMPT_OPENING = "Create synthetic {} tweets about the financial market or crypto currencies. Examples:"
PROMPT_CLOSING = "Do not explain your answer. Only answer according to the shown valid JSON format."
EXAMPLES_PER_PROMPT = 10
REQUESTS_PER_CLASS = 10
CLASS_QUOTA = 500_000

# Columns a trainer reads, by mode.
TRAINING_COLUMNS = {
    "pretrain": ["input_ids", "attention_mask"],
    "pre-finetune": ["input_ids", "token_type_ids", "attention_mask", "label"],
    "finetune": ["input_ids", "token_type_ids", "attention_mask", "label"],
}

# Near-duplicate search.
NUM_PERM = 128
THRESHOLD = 0.95
