"""Where the public tokenizer files lie. They are read in place and never copied into the repository."""

from __future__ import annotations


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
