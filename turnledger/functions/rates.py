"""Published list prices, in USD per 1,000 tokens."""

from __future__ import annotations

# Context size above which a session is billed at the long-context rate.
LONG_CONTEXT_THRESHOLD = 272_000
LONG_CONTEXT_SUFFIX = "-long-context"

# Model -> (input, cached input, cache write, output); None = no such rate.
# fmt: off
DEFAULT_RATES: dict[str, tuple[float | None, float | None, float | None, float | None]] = {
    "gpt-5": (0.00125, 0.000125, None, 0.01),
    "gpt-5-codex": (0.00125, 0.000125, None, 0.01),
    "gpt-5-codex-mini": (0.00025, 0.000025, None, 0.002),
    "gpt-5-mini": (0.00025, 0.000025, None, 0.002),
    "gpt-5-nano": (0.00005, 0.000005, None, 0.0004),
    "gpt-5-chat-latest": (0.00125, 0.000125, None, 0.01),
    "gpt-5-pro": (0.015, 0, None, 0.12),
    "gpt-5.1": (0.00125, 0.000125, None, 0.01),
    "gpt-5.1-chat-latest": (0.00125, 0.000125, None, 0.01),
    "gpt-5.1-codex": (0.00125, 0.000125, None, 0.01),
    "gpt-5.1-codex-max": (0.00125, 0.000125, None, 0.01),
    "gpt-5.1-codex-mini": (0.00025, 0.000025, None, 0.002),
    "gpt-5.2": (0.00175, 0.000175, None, 0.014),
    "gpt-5.2-chat-latest": (0.00175, 0.000175, None, 0.014),
    "gpt-5.2-codex": (0.00175, 0.000175, None, 0.014),
    "gpt-5.2-pro": (0.021, 0, None, 0.168),
    "gpt-5.3-chat-latest": (0.00175, 0.000175, None, 0.014),
    "gpt-5.3-codex": (0.00175, 0.000175, None, 0.014),
    "gpt-5.3-codex-spark": (0.002, 0.001, None, 0.008),
    "gpt-5.4": (0.0025, 0.00025, None, 0.015),
    "gpt-5.4-2026-03-05": (0.0025, 0.00025, None, 0.015),
    "gpt-5.4-long-context": (0.005, 0.0005, None, 0.0225),
    "gpt-5.4-2026-03-05-long-context": (0.005, 0.0005, None, 0.0225),
    "gpt-5.4-mini": (0.00075, 0.000075, None, 0.0045),
    "gpt-5.4-mini-2026-03-17": (0.00075, 0.000075, None, 0.0045),
    "gpt-5.4-pro": (0.03, 0, None, 0.18),
    "gpt-5.4-pro-2026-03-05": (0.03, 0, None, 0.18),
    "gpt-5.4-pro-long-context": (0.06, 0, None, 0.27),
    "gpt-5.4-pro-2026-03-05-long-context": (0.06, 0, None, 0.27),
    "gpt-5.5": (0.005, 0.0005, None, 0.03),
    "gpt-5.5-2026-04-23": (0.005, 0.0005, None, 0.03),
    "gpt-5.5-long-context": (0.01, 0.001, None, 0.045),
    "gpt-5.5-2026-04-23-long-context": (0.01, 0.001, None, 0.045),
    "gpt-5.5-pro": (0.03, 0, None, 0.18),
    "gpt-5.5-pro-2026-04-23": (0.03, 0, None, 0.18),
    "gpt-5.5-pro-long-context": (0.06, 0, None, 0.27),
    "gpt-5.5-pro-2026-04-23-long-context": (0.06, 0, None, 0.27),
    "gpt-4.1": (0.002, 0.0005, None, 0.008),
    "gpt-4.1-mini": (0.0004, 0.0001, None, 0.0016),
    "gpt-4.1-nano": (0.0001, 0.000025, None, 0.0004),
    "gpt-4o": (0.0025, 0.00125, None, 0.01),
    "gpt-4o-mini": (0.00015, 0.000075, None, 0.0006),
    "o3": (0.002, 0.0005, None, 0.008),
    "o3-mini": (0.0011, 0.00055, None, 0.0044),
    "o4-mini": (0.0011, 0.000275, None, 0.0044),
    "codex-mini-latest": (0.0015, 0.000375, None, 0.006),
    "claude-opus-4.8": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4-8": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4.7": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4-7": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4.6": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4-6": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4.5": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4-5": (0.005, 0.0005, 0.00625, 0.025),
    "claude-opus-4.1": (0.015, 0.0015, 0.01875, 0.075),
    "claude-opus-4-1": (0.015, 0.0015, 0.01875, 0.075),
    "claude-opus-4": (0.015, 0.0015, 0.01875, 0.075),
    "claude-opus-4-20250514": (0.015, 0.0015, 0.01875, 0.075),
    "claude-sonnet-4.6": (0.003, 0.0003, 0.00375, 0.015),
    "claude-sonnet-4-6": (0.003, 0.0003, 0.00375, 0.015),
    "claude-sonnet-4.5": (0.003, 0.0003, 0.00375, 0.015),
    "claude-sonnet-4-5": (0.003, 0.0003, 0.00375, 0.015),
    "claude-sonnet-4": (0.003, 0.0003, 0.00375, 0.015),
    "claude-sonnet-4-20250514": (0.003, 0.0003, 0.00375, 0.015),
    "claude-haiku-4.5": (0.001, 0.0001, 0.00125, 0.005),
    "claude-haiku-4-5": (0.001, 0.0001, 0.00125, 0.005),
    "claude-haiku-3.5": (0.0008, 0.00008, 0.001, 0.004),
    "claude-haiku-3-5": (0.0008, 0.00008, 0.001, 0.004),
    "claude-3-5-haiku-20241022": (0.0008, 0.00008, 0.001, 0.004),
}
# fmt: on

# Rate for models without an entry; it has no cache-write price.
FALLBACK_RATE = (0.00125, 0.000125, None, 0.01)
