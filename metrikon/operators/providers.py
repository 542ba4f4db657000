"""Language models that complete a prompt, by the name of their provider.

A provider holds its settings only and makes its client on first use, so it travels to the executors as it is.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from metrikon.schema import MissingDependencyError, require_positive

# Providers with their package, default model and the environment variables of their key.
PROVIDERS = {
    "openai": ("openai", "gpt-5.4-nano", ("OPENAI_API_KEY",)),
    "anthropic": ("anthropic", "claude-haiku-4-5-20251001", ("ANTHROPIC_API_KEY",)),
    "google": ("google.genai", "gemini-3-flash-preview", ("GEMINI_API_KEY", "GOOGLE_API_KEY")),
}
# Other names of providers.
PROVIDER_ALIASES = {"google-genai": "google", "gemini": "google"}


def provider_name(name: str) -> str:
    """Canonical name of a provider; an unknown one is an error."""
    low = name.strip().lower()
    low = PROVIDER_ALIASES.get(low, low)
    if low not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return low


def _package(name: str) -> Any:
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingDependencyError(f"the package {name} is not installed") from e


@dataclass(frozen=True)
class Provider:
    """One model of a provider. ``max_tokens`` bounds a reply where the provider asks for a bound."""

    provider: str
    model: str
    api_key: str
    temperature: float = 0.0
    max_retries: int = 3
    max_tokens: int = 1024

    def __getstate__(self) -> dict[str, Any]:
        """Clients stay behind: each process makes its own."""
        return {k: v for k, v in self.__dict__.items() if k not in ("client", "async_client")}

    def _connect(self, waiting: bool) -> Any:
        package = _package(PROVIDERS[self.provider][0])
        if self.provider == "google":
            client = package.Client(api_key=self.api_key)
            return client if waiting else client.aio
        kind = {"openai": ("OpenAI", "AsyncOpenAI"), "anthropic": ("Anthropic", "AsyncAnthropic")}[self.provider][0 if waiting else 1]
        return getattr(package, kind)(api_key=self.api_key, max_retries=self.max_retries)

    @cached_property
    def client(self) -> Any:
        return self._connect(True)

    @cached_property
    def async_client(self) -> Any:
        return self._connect(False)

    def _ask(self, client: Any, prompt: str) -> Any:
        if self.provider == "google":
            return client.models.generate_content(model=self.model, contents=prompt, config={"temperature": self.temperature, "max_output_tokens": self.max_tokens})
        request = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature}
        if self.provider == "openai":
            return client.chat.completions.create(**request)
        return client.messages.create(**request, max_tokens=self.max_tokens)

    def _text(self, reply: Any) -> str:
        if self.provider == "google":
            return (reply.text or "").strip()
        return (reply.choices[0].message.content if self.provider == "openai" else reply.content[0].text).strip()

    def complete(self, prompt: str) -> str:
        return self._text(self._ask(self.client, prompt))

    async def acomplete(self, prompt: str) -> str:
        return self._text(await self._ask(self.async_client, prompt))


def make_provider(provider: str, model: str | None = None, api_key: str | None = None, temperature: float = 0.0, max_retries: int = 3, max_tokens: int = 1024) -> Provider:
    """The provider of this name, its key from the environment and its default model unless given.

    A missing package or key is an error here, on the driver, and not later on an executor.
    """
    name = provider_name(provider)
    package, default, keys = PROVIDERS[name]
    _package(package)
    key = api_key or next((os.environ[k] for k in keys if os.environ.get(k)), None)
    if not key:
        raise ValueError(f"no API key for {name}: set {' or '.join(keys)} or pass api_key")
    return Provider(name, model or default, key, temperature, require_positive(max_retries, "max_retries"), max_tokens)
