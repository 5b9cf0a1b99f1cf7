"""Configuration from a mapping, JSON text or a JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

# Keys, their fields and defaults.
KEYS = {
    "RAG_PG_CONNINFO": ("pg_conninfo", ""),
    "RAG_MILVUS_BASE_URL": ("milvus_base_url", "http://localhost:19530"),
    "RAG_MILVUS_TOKEN": ("milvus_token", "root:Milvus"),
    "RAG_MILVUS_COLLECTION": ("milvus_collection", "clause_text"),
    "RAG_EMBED_BASE_URL": ("embed_base_url", "https://api.siliconflow.cn"),
    "RAG_EMBED_PATH": ("embed_path", "/v1/embeddings"),
    "RAG_EMBED_MODEL": ("embed_model", "Qwen/Qwen3-Embedding-8B"),
    "RAG_EMBED_DIM": ("embed_dim", "4096"),
    "RAG_EMBED_KEY": ("embed_key", ""),
    "RAG_DEEPSEEK_BASE_URL": ("deepseek_base_url", "https://api.deepseek.com"),
    "RAG_DEEPSEEK_PATH": ("deepseek_path", "/chat/completions"),
    "RAG_DEEPSEEK_MODEL": ("deepseek_model", "deepseek-v4-pro"),
    "RAG_DEEPSEEK_KEY": ("deepseek_key", ""),
    "RAG_DOC_PATH": ("doc_path", ""),
}
REQUIRED = ("RAG_PG_CONNINFO", "RAG_EMBED_KEY", "RAG_DEEPSEEK_KEY")


@dataclass(frozen=True)
class Config:
    values: Mapping[str, str]

    @classmethod
    def from_map(cls, given: Mapping[str, str]) -> Config:
        """An empty string counts as missing."""
        return cls({key: given.get(key) or default for key, (_, default) in KEYS.items()})

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Strings as they are, null skipped, other values as JSON text; what isn't a JSON object gives an empty configuration."""
        try:
            data = json.loads(text)
        except ValueError:
            data = None
        items = data.items() if isinstance(data, dict) else ()
        return cls.from_map({k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in items if v is not None})

    @classmethod
    def from_file(cls, path: str) -> Config:
        """A missing file gives an empty configuration."""
        try:
            with open(path, encoding="utf-8-sig") as f:
                return cls.from_json(f.read())
        except OSError:
            return cls.from_map({})

    def __getattr__(self, name: str):
        for key, (field, _) in KEYS.items():
            if field == name:
                return int(self.values[key]) if field == "embed_dim" else self.values[key]
        raise AttributeError(name)

    def missing_required(self) -> list[str]:
        return [key for key in REQUIRED if not self.values[key]]
