"""Requests to language models that score contexts, and what is read from their replies.

Each backend is a pair: what is sent for a prompt, and where the text is in the reply. The sending is the
caller's: ``post(url, headers, body) -> (status, text)``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

# Public endpoints and usual models by backend.
ENDPOINTS = {
    "openai": ("https://api.openai.com/v1/chat/completions", "gpt-5-mini"),
    "deepseek": ("https://api.deepseek.com/chat/completions", "deepseek-chat"),
    "vllm": ("http://localhost:8000/v1/chat/completions", "Qwen/qwen3-4B-Instruct-2507"),
    "anthropic": ("https://api.anthropic.com/v1/messages", "claude-haiku-4-5"),
    "ollama": ("http://localhost:11434/api/generate", "Qwen/qwen3-4B-Instruct-2507"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/models", "gemini-2.5-flash-lite"),
}
MOST_TOKENS, TEMPERATURE = 2000, 0.1


@dataclass(frozen=True)
class Backend:
    """A language model by its kind of interface; endpoint and model default to the usual ones."""

    kind: str
    model: str = ""
    endpoint: str = ""
    key: str = ""

    def __post_init__(self):
        if self.kind not in ENDPOINTS:
            raise ValueError(f"unknown backend: {self.kind}")
        object.__setattr__(self, "endpoint", self.endpoint or ENDPOINTS[self.kind][0])
        object.__setattr__(self, "model", self.model or ENDPOINTS[self.kind][1])

    def request(self, prompt: str) -> tuple[str, dict[str, str], str]:
        """(url, headers, body) of a prompt."""
        said = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MOST_TOKENS}
        headers, url = {"Content-Type": "application/json"}, self.endpoint
        if self.kind == "anthropic":
            headers |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        elif self.kind == "ollama":
            said = {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": TEMPERATURE, "num_predict": MOST_TOKENS}}
        elif self.kind == "gemini":
            url = f"{url}/{self.model}:generateContent" + (f"?key={self.key}" if self.key else "")
            said = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": TEMPERATURE, "maxOutputTokens": MOST_TOKENS, "responseMimeType": "application/json"}}
        else:
            headers["Authorization"] = f"Bearer {self.key}"
            if self.kind == "openai":
                said["response_format"] = {"type": "json_object"}
        return url, headers, json.dumps(said)

    def reply(self, text: str) -> str:
        """The model's words in a reply; empty where it has none."""
        paths = {"anthropic": ("content", 0, "text"), "ollama": ("response",), "gemini": ("candidates", 0, "content", "parts", 0, "text")}
        found = json.loads(text)
        for step in paths.get(self.kind, ("choices", 0, "message", "content")):
            try:
                found = found[step]
            except (KeyError, IndexError, TypeError):
                return ""
        return found if isinstance(found, str) else ""

    def sender(self, post: Callable[[str, dict[str, str], str], tuple[int, str]]) -> Callable[[str, str, str], tuple[int, str]]:
        """A transport for ``operators.answers`` that sends prompts."""

        def send(source: str, kind: str, prompt: str) -> tuple[int, str]:
            status, text = post(*self.request(prompt))
            return (status, self.reply(text)) if 200 <= status < 300 else (status, text)

        return send
