"""Stop-word lists.

The general Spanish list is Spark ML's own (the one behind
``StopWordsRemover.loadDefaultStopWords``), kept as a plain resource of this
package so that it is available without a JVM or any look-up inside the
PySpark installation (the DuckDB oracle strings are built from it too).
"""

from __future__ import annotations

import functools
from importlib import resources

# Extra Spanish stop words the reference adds for post cleaning.
POST_EXTRA_STOPWORDS = (
    "q", "ver", "tan", "va", "ser", "cosa", "tra", "sido", "vez",
    "hoy", "ahora", "año", "día", "nuevo", "gente",
    "así", "solo", "parte", "mientras", "puede", "cómo", "hizo",
)

# Extra Spanish stop words the reference adds for topic cleaning,
# and the verbs it removes only for topic modelling.
TOPIC_EXTRA_STOPWORDS = (
    "q", "va", "ser", "tra", "sido", "vez", "hoy", "ahora", "nuevo", "así",
)
TOPIC_EXTRA_VERBS = (
    "haber", "tener", "hacer", "decir", "poder", "dar", "ir", "poner", "ser",
    "estar", "querer",
)


@functools.lru_cache(maxsize=None)
def default_list(language: str) -> tuple[str, ...]:
    """Default stop words for ``language`` (only ``"spanish"`` is shipped)."""
    raw = resources.files("pulso.resources").joinpath(f"stopwords_{language}.txt")
    return tuple(w for w in raw.read_text(encoding="utf-8").split() if w)


def post_stopwords() -> tuple[str, ...]:
    """Spanish list plus the post-cleaning extras, sorted, no duplicates."""
    return tuple(sorted(set(default_list("spanish")) | set(POST_EXTRA_STOPWORDS)))


def topic_stopwords() -> tuple[str, ...]:
    """Spanish list plus topic extras and verbs, sorted, no duplicates."""
    return tuple(sorted(set(default_list("spanish")) | set(TOPIC_EXTRA_STOPWORDS)
                        | set(TOPIC_EXTRA_VERBS)))
