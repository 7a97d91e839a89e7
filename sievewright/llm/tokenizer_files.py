"""Where the public tokenizer files are; operators take the path as a parameter, the queries ask here."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
