"""Settings of the environment, each with a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from vakya.functions.lexicons import LOW_CONFIDENCE, MAX_CHARS, MAX_TEXT_CHARS, MAX_TEXTS, MAX_TOTAL_CHARS, SENTIMENT_TOKENS


@dataclass(frozen=True)
class Settings:
    max_texts: int = MAX_TEXTS
    max_text_chars: int = MAX_TEXT_CHARS
    max_total_chars: int = MAX_TOTAL_CHARS
    max_prompt_chars: int = MAX_CHARS
    low_confidence: float = LOW_CONFIDENCE
    sentiment_tokens: int = SENTIMENT_TOKENS
    translation_batch: int = 8
    sentiment_batch: int = 16
    fallback: bool = False
    chat_url: str = "http://localhost:11434"
    chat_model: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "VAKYA_") -> Settings:
        """What `prefix` and the setting's name in capitals say; empty ones count as not set. ValueError names a setting that can't be read."""
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            said = env.get(prefix + f.name.upper(), "").strip()
            if said:
                try:
                    out[f.name] = said.lower() in ("1", "true", "yes", "on") if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type](said)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()}={said!r} is no {f.type}") from e
        return cls(**out)
