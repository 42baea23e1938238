"""Schemas of the engine's tables, always given explicitly (never inferred)."""

REQUESTS = (
    "request_id string, ts timestamp, api_key string, claims struct<tid:string,sub:string>, "
    "symbols array<struct<ticker:string,name:string>>, lookback_hours int, max_articles int"
)

PAYLOADS = (
    "request_id string, feed int, ticker string, call_id string, http_status int, "
    "body string, received_at timestamp"
)

ANSWERS = "request_id string, chunk int, provider string, http_status int, body string"

CALL_LOG = (
    "call_id string, provider string, attempt int, status int, error_kind string, ts timestamp"
)

SENTIMENT = (
    "symbol string, sentiment_score double, label string, confidence double, source_tier string, "
    "news_provider string, article_count int, reasoning string"
)

# Result columns in the order the JSON form prints them.
RESULT_COLUMNS = [part.strip().split(" ")[0] for part in SENTIMENT.split(",")]

ERROR_DETAIL = "struct<code:string,field:string,message:string>"
