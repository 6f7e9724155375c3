"""Types and enumerations of span labels."""

from __future__ import annotations

# Fixed values of the label scheme, in their order.
EMOTIONS = ("fear_anxiety", "pessimism_despair", "anger_disgust", "optimism_confidence", "excitement_euphoria", "confusion_uncertainty", "surprise")
SOURCES = ("comment", "post", "parent")
CAUSES = (
    "inflation", "monetary_policy", "employment", "growth_gdp", "fiscal_taxes", "trade_tariffs", "energy", "housing", "geopolitics",
    "markets_themselves", "crypto", "corporate_earnings", "inequality_distribution", "personal_finance", "interpersonal", "other", "unclear",
)
ASSETS = ("equities", "bonds", "gold", "crypto", "USD", "housing", "none")
MAX_PAIRS = 8

# Sign of each emotion's valence; the others are 0.
VALENCE = {"optimism_confidence": 1, "excitement_euphoria": 1, "fear_anxiety": -1, "pessimism_despair": -1, "anger_disgust": -1}
DROP_CAUSE = "interpersonal"
# Emotion and cause combinations followed on their own.
CELLS = (
    ("fear_anxiety", "inflation"), ("fear_anxiety", "monetary_policy"), ("optimism_confidence", "growth_gdp"),
    ("fear_anxiety", "markets_themselves"), ("anger_disgust", "fiscal_taxes"), ("optimism_confidence", "corporate_earnings"),
)
#: Forward returns in weeks.
HORIZONS = {"1w": 1, "1m": 4, "3m": 13}

PAIR = (
    "struct<emotion:string,emotion_span:string,cause_span:string,cause_source:string,cause_category:string,"
    "target_asset:string,intensity:double,sarcasm:boolean>"
)
PAIRS = f"array<{PAIR}>"
PAIR_FIELDS = ("emotion", "emotion_span", "cause_span", "cause_source", "cause_category", "target_asset", "intensity", "sarcasm")

COMMENT = "id string, created_utc bigint, link_id string, parent_id string, author string, score int, body string"
POST = "id string, created_utc bigint, title string, selftext string, is_self int, num_comments int, score int"
CORPUS_LABEL = f"comment_id string, created_utc bigint, link_id string, neutral boolean, pairs {PAIRS}"
