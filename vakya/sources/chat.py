"""A model behind an HTTP chat service, as the judging and translating stages take one: built once per Python worker, which keeps its connection."""

from __future__ import annotations

import http.client
import json
import time
from dataclasses import dataclass
from urllib.parse import urlsplit


class ChatError(Exception):
    """The service couldn't be reached or answered with an error."""


@dataclass(frozen=True)
class Chat:
    """Where the service is and how it's asked. Called, it gives a function from (texts, prompt) to replies; texts go one by one.

    A request that fails is repeated up to `retries` times, waiting longer each time. A service that refuses a schema (status 400) is
    asked for plain JSON at once, and from then on."""

    url: str
    model: str
    timeout_s: float = 60.0
    retries: int = 1
    schema: str | None = None
    wait_s: float = 0.5

    def __call__(self):
        at = urlsplit(self.url)
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        state = {"schema": self.schema, "open": None}

        def send(body: dict) -> tuple[int, bytes]:
            if state["open"] is None:
                state["open"] = kind(at.netloc, timeout=self.timeout_s)
            try:
                state["open"].request("POST", f"{at.path.rstrip('/')}/api/chat", json.dumps(body), {"Content-Type": "application/json"})
                r = state["open"].getresponse()
                return r.status, r.read()
            except (OSError, http.client.HTTPException) as e:
                state["open"].close()
                state["open"] = None
                raise ChatError(type(e).__name__) from e

        def ask(text: str, prompt: str) -> str:
            body = {"model": self.model, "stream": False, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}]}
            status, answer = send(body | {"format": json.loads(state["schema"]) if state["schema"] else "json"})
            if status == 400 and state["schema"]:
                state["schema"] = None
                status, answer = send(body | {"format": "json"})
            if status != 200:
                raise ChatError(f"status {status}")
            return json.loads(answer)["message"]["content"]

        def tried(text: str, prompt: str) -> str:
            for k in range(self.retries + 1):
                try:
                    return ask(text, prompt)
                except (ChatError, KeyError, ValueError):
                    if k == self.retries:
                        raise
                    time.sleep(self.wait_s * 2**k)
            raise AssertionError

        return lambda texts, prompt: [tried(t, prompt) for t in texts]

    def healthy(self) -> bool:
        """Whether the service answers and has the model."""
        at = urlsplit(self.url)
        c = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc, timeout=min(5.0, self.timeout_s))
        try:
            c.request("GET", f"{at.path.rstrip('/')}/api/tags")
            r = c.getresponse()
            return r.status == 200 and any(m.get("name") == self.model for m in json.loads(r.read()).get("models", []))
        except (OSError, http.client.HTTPException, ValueError):
            return False
        finally:
            c.close()
