"""Job parameters. Plain values that a job is started with; nothing here touches Spark data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Request bounds, batch sizes and defaults of the service contract.
MAX_SYMBOLS = 50
MAX_TICKER_BYTES = 16
MAX_NAME_BYTES = 120
MIN_LOOKBACK_HOURS, MAX_LOOKBACK_HOURS = 1, 168
MIN_ARTICLES, MAX_ARTICLES = 1, 20
ANSWER_CHUNK = 15
DURATION_SAMPLES = 4096
MAX_ATTEMPTS = 3

# Answer providers in default failover order.
ANSWER_PROVIDERS = ["grok", "deepseek", "openai"]

# Hosts that outgoing calls may always reach.
DEFAULT_HOSTS = [
    "api.tiingo.com",
    "finnhub.io",
    "api.marketaux.com",
    "www.alphavantage.co",
    "api.x.ai",
    "api.deepseek.com",
    "api.openai.com",
]

# News feeds in call order, by feed rank.
FEED_NAMES = {1: "tiingo", 2: "marketaux", 3: "alphavantage", 4: "finnhub"}


@dataclass(frozen=True)
class Params:
    """Everything a job run is configured with."""

    feed2: bool = True
    feed3: bool = True
    feed4: bool = True
    call_budget: int = 6
    news_only: bool = False
    ttl_seconds: int = 300
    share_run: bool = True
    tenant_per_minute: int = 100
    global_per_minute: int = 1000
    auth_mode: str = "none"
    answer_order: tuple = tuple(ANSWER_PROVIDERS)
    answer_keys: frozenset = frozenset()
    extra_hosts: tuple = ()
    secrets: tuple = field(default=(), repr=False)

    @property
    def answers_configured(self) -> bool:
        return bool(self.answer_keys)


def parse_key_pairs(raw: str) -> list[tuple[str, str]]:
    """``tenant:key,tenant:key`` → pairs; the first colon separates, blank sides are an error."""
    pairs = []
    for entry in raw.split(","):
        if not entry.strip():
            continue
        tenant, _, key = (side.strip() for side in entry.partition(":"))
        if not tenant or not key:
            raise ValueError("API key entry needs the form tenant:key")
        pairs.append((tenant, key))
    return pairs


def parse_hosts(raw: str) -> tuple[str, ...]:
    """Comma list of extra hosts, trimmed and lower-cased, blanks dropped."""
    return tuple(h for h in (part.strip().lower() for part in raw.split(",")) if h)


def failover_order(raw: str | None, primary: str) -> list[str]:
    """Answer providers in the order they are tried.

    An explicit list wins; otherwise the primary comes first and the others follow. Repeats keep
    their first place; an unknown name is an error.
    """
    named = [p.strip().lower() for p in (raw or "").split(",") if p.strip()]
    order = named or [primary.strip().lower(), *ANSWER_PROVIDERS]
    unknown = [p for p in order if p not in ANSWER_PROVIDERS]
    if unknown:
        raise ValueError(f"unsupported answer provider: {unknown[0]}")
    return list(dict.fromkeys(order))
