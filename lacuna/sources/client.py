"""A client for models behind HTTP: a JSON request with messages, a JSON answer with text blocks and token counts."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request


class CallError(RuntimeError):
    """A call that failed; retryable if another may succeed."""

    def __init__(self, message: str, retryable: bool):
        super().__init__(message)
        self.retryable = retryable


def read_env(path: str = ".env") -> list[str]:
    """Sets KEY=VALUE lines of a file (a byte order mark, `export` and quotes are taken off) that the environment lacks; the names found."""
    if not os.path.exists(path):
        return []
    found = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            name, value = name.strip(), value.strip().strip("'\"")
            if sign and name and value and not name.startswith("#"):
                os.environ.setdefault(name, value)
                found.append(name)
    return found


class HttpClient:
    """complete() posts a prompt; last_usage holds the tokens that the answer states.

    The key is read from the environment on the worker and is part of no plan, no file and no error. headers may hold what
    a service wants besides. Answers 408, 409, 429 and 5xx and broken connections may be tried again, others not.
    """

    def __init__(self, url: str, model: str, key_name: str = "MODEL_API_KEY", key_header: str = "x-api-key", headers: dict[str, str] | None = None, timeout: float = 120.0):
        self.url, self.model, self.timeout = url, model, timeout
        self.key_name, self.key_header, self.headers = key_name, key_header, headers or {}
        self.last_usage: tuple[int, int] | None = None

    def complete(self, prompt: str, *, max_tokens: int = 1024) -> str:
        if not (key := os.environ.get(self.key_name)):
            raise CallError(f"{self.key_name} isn't set in the environment", retryable=False)
        body = json.dumps({"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]})
        headers = {"content-type": "application/json", self.key_header: key, **self.headers}
        self.last_usage = None
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body.encode(), headers), timeout=self.timeout) as got:
                told = json.load(got)
        except urllib.error.HTTPError as e:
            raise CallError(f"the service answered {e.code}", e.code in (408, 409, 429) or e.code >= 500) from None
        except (OSError, ValueError) as e:
            raise CallError(f"no answer that can be read ({type(e).__name__})", True) from None
        if usage := told.get("usage"):
            self.last_usage = int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0)
        return "".join(b.get("text", "") for b in told.get("content", []) if b.get("type") == "text")
