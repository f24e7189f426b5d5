"""Byte-level BPE ids, the same as those of the tokenizer file, for whole texts.

The vocabulary file is a parameter; it is read where it lies and never copied.  Ids
come from the rank table of the same vocabulary, which is several times faster; a text
that its pattern engine cannot take goes to the tokenizer file itself.  With ``added``
(the operators' way) a text is cut at the file's added tokens, such as ``<|endoftext|>``,
which get their own id, as the file does; without it their strings are ordinary text.
"""

from __future__ import annotations

import re

import numpy as np

from tessera.llm._tables import worker_cache

VOCABULARY = "byte_bpe_50k.json"
#: Longer texts without a break are known to exhaust the pattern engine's stack.
_LONG = 200_000


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    cache = worker_cache()
    if ("tokens", path) not in cache:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
        # stands for itself, the other bytes follow from code point 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocabulary.items() if all(c in byte_of for c in w) and not w.startswith("<|")}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        cache["tokens", path] = fast
    return cache["tokens", path]


def _reference(path: str):
    """The tokenizer file itself, read when a text needs it."""
    cache = worker_cache()
    if ("file", path) not in cache:
        from tokenizers import Tokenizer

        cache["file", path] = Tokenizer.from_file(path)
        cache["file", path].encode_special_tokens = True
    return cache["file", path]


def _added(path: str):
    """``(pattern, ids by string, whole)`` of the file's added tokens; ``whole`` if one takes
    blanks beside it, single words or normalized text only, which cutting does not cover."""
    cache = worker_cache()
    if ("added", path) not in cache:
        import json

        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        pattern = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(tokens, key=lambda t: -len(t["content"]))) + ")") if tokens else None
        cache["added", path] = pattern, {t["content"]: t["id"] for t in tokens}, any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return cache["added", path]


def encoder(path: str, added: bool = False):
    """A function from a text to its ids (uint32)."""
    fast = _encoder(path)

    def slow(text: str) -> np.ndarray:
        return np.array(_reference(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(text: str) -> np.ndarray:
        if len(text) > _LONG:
            longest = max(map(len, text.split()), default=0)
            blanks = len(text) - sum(map(len, text.split()))
            if longest > _LONG // 4 or blanks > len(text) // 2:
                return slow(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except Exception as error:  # the pattern engine gives up on some long runs
            if "stack" not in str(error).lower() and "backtrack" not in str(error).lower():
                raise
            return slow(text)

    pattern, id_of, whole = _added(path) if added else (None, {}, False)
    if pattern is None:
        return ids
    cache = worker_cache()

    def with_added(text: str) -> np.ndarray:
        if pattern.search(text) is None:
            return ids(text)
        if whole:
            if ("whole", path) not in cache:
                from tokenizers import Tokenizer

                cache["whole", path] = Tokenizer.from_file(path)
            return np.array(cache["whole", path].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        # Odd pieces are the added tokens.
        return np.concatenate([np.array([id_of[s]], dtype=np.uint32) if k % 2 else ids(s) for k, s in enumerate(pattern.split(text))])

    return with_added
