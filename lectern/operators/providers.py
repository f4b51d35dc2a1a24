"""Clients of chat services over plain HTTP; instances are pickled to the executors, keys come from the caller or the environment."""

from __future__ import annotations

import http.client
import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass

from .enrich import PROVIDERS, ProviderError, RateLimitError, retry_after

# How ids of models that chat begin.
CHAT_MODELS = ("gpt-", "o1", "o3", "o4", "chatgpt")


def chat_models(ids: list[str]) -> list[str]:
    """Ids of chat models, sorted; all ids if none looks like one."""
    return sorted(i for i in ids if i.startswith(CHAT_MODELS)) or sorted(ids)


@dataclass
class HttpProvider:
    """Subclasses say where to ask, what to send and where the answer is."""

    name = ""
    env = ""
    base = ""
    needs_key = True

    model: str = ""
    key: str = ""
    url: str = ""
    temperature: float | None = 0.0
    schema: dict | None = None
    timeout: float = 300.0

    def __post_init__(self) -> None:
        self.key = (self.key or os.environ.get(self.env, "")).strip() if self.env else self.key
        self.url = (self.url or self.base).rstrip("/")

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"}

    def request(self, system: str, user: str, max_tokens: int) -> tuple[str, dict]:
        raise NotImplementedError

    def answer(self, found: dict) -> str:
        raise NotImplementedError

    def models_path(self) -> str:
        return "/models"

    def model_ids(self, found: dict) -> list[str]:
        return [m["id"] for m in found.get("data", [])]

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        path, body = self.request(system, user, max_tokens)
        return self.answer(self._ask(path, body))

    def list_models(self) -> list[str]:
        return sorted(self.model_ids(self._ask(self.models_path(), None)))

    def _ask(self, path: str, body: dict | None) -> dict:
        if self.needs_key and not self.key:
            raise ProviderError(f"{self.name} needs a key: pass one or set {self.env}")
        send = None if body is None else json.dumps(body).encode()
        ask = urllib.request.Request(self.url + path, data=send, headers={"Content-Type": "application/json", **self.headers()})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            said = f"{self.name}: {e.code} {e.read(2000).decode('utf-8', 'replace')}"
            if e.code == 429:
                wait = e.headers.get("Retry-After", "")
                raise RateLimitError(said, float(wait) if wait.replace(".", "", 1).isdigit() else retry_after(said)) from e
            raise ProviderError(said) from e
        except (OSError, http.client.HTTPException, ValueError) as e:
            raise ProviderError(f"{self.name}: {e}") from e


class Anthropic(HttpProvider):
    name, env, base = "anthropic", "ANTHROPIC_API_KEY", "https://api.anthropic.com/v1"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key, "anthropic-version": "2023-06-01"}

    def request(self, system: str, user: str, max_tokens: int) -> tuple[str, dict]:
        # the long instructions are the same for all batches of a document
        body = {"model": self.model, "max_tokens": max_tokens, "system": [{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}], "messages": [{"role": "user", "content": user}]}
        return "/messages", body | ({} if self.temperature is None else {"temperature": self.temperature})

    def answer(self, found: dict) -> str:
        return "".join(b.get("text", "") for b in found.get("content", []) if b.get("type") == "text")


class OpenAI(HttpProvider):
    name, env, base = "openai", "OPENAI_API_KEY", "https://api.openai.com/v1"

    def request(self, system: str, user: str, max_tokens: int) -> tuple[str, dict]:
        body = {"model": self.model, "max_completion_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.temperature is not None:
            body["temperature"] = self.temperature
        if self.schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "results", "schema": self.schema, "strict": True}}
        return "/chat/completions", body

    def answer(self, found: dict) -> str:
        return (found.get("choices") or [{}])[0].get("message", {}).get("content") or ""

    def model_ids(self, found: dict) -> list[str]:
        return chat_models(super().model_ids(found))


class Gemini(HttpProvider):
    name, env, base = "gemini", "GEMINI_API_KEY", "https://generativelanguage.googleapis.com/v1beta"

    def headers(self) -> dict[str, str]:
        return {"x-goog-api-key": self.key}

    def request(self, system: str, user: str, max_tokens: int) -> tuple[str, dict]:
        how = {"maxOutputTokens": max_tokens, "responseMimeType": "application/json"} | ({} if self.temperature is None else {"temperature": self.temperature})
        return f"/models/{self.model}:generateContent", {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": how}

    def answer(self, found: dict) -> str:
        return "".join(p.get("text", "") for p in (found.get("candidates") or [{}])[0].get("content", {}).get("parts", []))

    def model_ids(self, found: dict) -> list[str]:
        return [m["name"].removeprefix("models/") for m in found.get("models", []) if "generateContent" in m.get("supportedGenerationMethods", ["generateContent"])]


class Ollama(HttpProvider):
    """A service on this machine or network; it takes no key."""

    name, base, needs_key = "ollama", "http://localhost:11434", False

    def __post_init__(self) -> None:
        self.url = self.url or os.environ.get("OLLAMA_HOST", "")
        super().__post_init__()
        self.url = self.url if "://" in self.url else f"http://{self.url}"

    def headers(self) -> dict[str, str]:
        return {}

    def request(self, system: str, user: str, max_tokens: int) -> tuple[str, dict]:
        how = {"num_predict": max_tokens} | ({} if self.temperature is None else {"temperature": self.temperature})
        return "/api/chat", {"model": self.model, "stream": False, "format": self.schema or "json", "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "options": how}

    def answer(self, found: dict) -> str:
        return found.get("message", {}).get("content", "")

    def models_path(self) -> str:
        return "/api/tags"

    def model_ids(self, found: dict) -> list[str]:
        return [m["name"] for m in found.get("models", [])]


for _kind in (Anthropic, OpenAI, Gemini, Ollama):
    PROVIDERS[_kind.name] = _kind


def provider_names() -> list[str]:
    return sorted(PROVIDERS)
