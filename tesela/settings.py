"""Settings of retrieval, read from the environment once and passed to the builders."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """k of 0 or None in a call means top_k.  7 is the documented operating point; the code's default of 5 is TOP_K's."""

    llm_model: str = "llama3"
    embedding_model: str = "nomic-embed-text"
    chunk_size: int = 900
    chunk_overlap: int = 150
    top_k: int = 5
    reranker_enabled: bool = False
    reranker_pool_size: int = 20
    reranker_alpha: float = 0.5
    log_retention_days: int = 30
    collection_name: str = "riesgos_corpus"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Each field from the variable of its name in upper case; true, 1 and yes in any case are true, anything else false."""
        env = os.environ if env is None else env
        read = {bool: lambda x: x.strip().lower() in ("true", "1", "yes"), int: int, float: float, str: str}
        made = {}
        for name, default in vars(cls()).items():
            if (raw := env.get(name.upper())) is not None:
                made[name] = read[type(default)](raw)
        return cls(**made)

    def k(self, asked: int | None) -> int:
        return asked or self.top_k
