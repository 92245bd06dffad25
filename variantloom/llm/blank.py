"""What stands for no answer: nothing, white or invisible characters, an empty wrapper, a failure mark or a placeholder."""

from __future__ import annotations

import json
import re

from variantloom.llm.textnorm import base_form, plain_words

# What stands for no answer.
PLACEHOLDERS = {
    "", "fail", "failed", "failure", "error", "api error", "api_error", "model_fail", "model fail", "timeout", "timed out", "n a", "na", "none", "null", "nil", "nan",
    "empty", "blank", "undefined", "no output", "no response", "no answer", "no content", "no text", "not available", "unavailable", "missing", "placeholder", "pending", "tbd", "todo",
    "output", "response", "answer", "text", "rewrite", "result", "true", "false", "your answer here", "insert text here", "lorem ipsum",
}
MOST_WORDS = max(len(p.split()) for p in PLACEHOLDERS)
_TAGGED = re.compile(r"</?[a-zA-Z][^<>]*>|```\w*|[`*_#]+")
_WORD = re.compile(r"\w+")


def unwrapped(text: str | None) -> str:
    """The content of a text in JSON, tags, fences or quotes; '' for blank."""
    text = _fenceless(base_form(text or "").strip())
    for _ in range(3):
        if not (text[:1] in "{[" and text[-1:] in "}]" and text):
            break
        try:
            value = json.loads(text)
        except ValueError:
            break
        text = " ".join(_leaves(value)).strip()
    return _TAGGED.sub(" ", text).strip().strip("\"'“”‘’()[]<>").strip()


def _fenceless(text: str) -> str:
    return re.sub(r"^```\w*\s*|\s*```$", "", text).strip() if text.startswith("```") else text


def _leaves(value) -> list[str]:
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    return [] if value is None or isinstance(value, bool) else [str(value)]


def is_empty(text: str | None) -> bool:
    """Whether the content, of whatever length its wrapper is, is a placeholder or holds no letter or digit."""
    if not text:
        return True
    first = text.lstrip()[:1]
    if first not in "{[<`(\"'“‘*_#" and text.isascii() and len(plain_words(text[:400])) > MOST_WORDS:
        return False  # without a wrapper its first words alone are more than any placeholder has
    words = _WORD.findall(unwrapped(text).lower())
    return len(words) <= MOST_WORDS and " ".join(words) in PLACEHOLDERS or not any(c.isalnum() for w in words for c in w)
