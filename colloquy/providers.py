"""Named providers for what pretrained models would do, made once a Python worker.

Registered by default: `punctuation` plain and keep, `sentences` pattern, `language` tokens, `encoder` hashed,
`summary` extractive. Question answering has a slot and no default; a factory is given with `register`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from colloquy.operators import parse, punctuation, sections, sentences, vectors

_FACTORIES: dict[tuple[str, str], Callable[[], object]] = {
    ("punctuation", "plain"): lambda: punctuation.plain,
    ("punctuation", "keep"): lambda: punctuation.keep,
    ("sentences", "pattern"): lambda: sentences.split_sentences,
    ("language", "tokens"): lambda: parse.token_lists,
    ("encoder", "hashed"): vectors.hashed_embedder,
    ("summary", "extractive"): lambda: sections.summarise,
}
KINDS = ("punctuation", "encoder", "sentences", "language", "summary", "questions")


def register(kind: str, name: str, factory: Callable[[], object]) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    _FACTORIES[kind, name] = factory
    get.cache_clear()


@lru_cache(maxsize=None)
def get(kind: str, name: str) -> object:
    if (kind, name) not in _FACTORIES:
        raise KeyError(f"no {kind} provider {name}")
    return _FACTORIES[kind, name]()
