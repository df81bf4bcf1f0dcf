"""Outside services: embedding of texts, rewriting of queries, judging of results. All are optional and off by default; any object with the
method will do. A failing service never fails a search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from ocellus.plans.understanding import Rewrite, json_object


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class Rewriter(Protocol):
    def __call__(self, query: str) -> Rewrite | None: ...


class Judge(Protocol):
    def __call__(self, query: str, results: list[dict]) -> dict[int, float]: ...


def rewriter_from_chat(chat: Callable[[str], str]) -> Rewriter:
    """A rewriter over a chat function that answers with a JSON object of keywords_zh, keywords_en and must_terms; after a failure it stays off."""
    state = {"on": True}

    def rewrite(query: str) -> Rewrite | None:
        if not state["on"]:
            return None
        try:
            found = json_object(chat(query))
        except Exception:
            found = None
        if found is None:
            state["on"] = False
            return None
        words = lambda key, n: tuple(str(x) for x in (found.get(key) or [])[:n])
        return Rewrite(words("keywords_zh", 1), words("keywords_en", 2), words("must_terms", 1))

    return rewrite


def attempt(function, *arguments):
    """The function's result, or None where there is no function or it fails."""
    try:
        return function(*arguments) if function else None
    except Exception:
        return None
