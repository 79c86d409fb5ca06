"""Access to the public tokenizers, one instance per Python worker."""

from __future__ import annotations

import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task; threads of their own would oversubscribe it


@functools.lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer in ``name``: a file of ``public_tokenizers``, or a path that has a slash."""
    from tokenizers import Tokenizer

    if "/" not in name:
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    return Tokenizer.from_file(name)


@functools.lru_cache(maxsize=4)
def of_words(name: str):
    """The same for texts that are normalised pre-tokens with a space between any two: it looks for no others and normalises nothing."""
    from tokenizers import pre_tokenizers

    out = load.__wrapped__(name)
    out.normalizer = None
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out
