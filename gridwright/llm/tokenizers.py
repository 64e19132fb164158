"""Byte-pair token ids of cells, from the vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
from collections.abc import Callable

import tiktoken
import tokenizers


#: Texts of more characters go through ``tokenizers``: the other library's pattern runs out of stack on a million spaces in a row.
LONG_TEXT = 1 << 17


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes.

    Printable bytes stand for themselves; the others, in order, get the code
    points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_pair_encoder(path: str, pattern: str, added_tokens: bool = False) -> Callable[[str], list[int]]:
    """A function from a text to its ids by a byte-level ``tokenizer.json``.

    The ids are those of ``tokenizers`` with ``add_special_tokens=False``. With
    ``added_tokens`` the strings of added tokens in a text get their own ids,
    as that library does by default; without, they are ordinary text
    (``encode_special_tokens``). In these files a token's id is its merge rank,
    so the vocabulary alone gives the ranks, and ``tiktoken`` finds the same
    ids in a quarter of the time; very long texts and those that hold an added
    token go through ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = content.get("added_tokens", [])
    special = {t["id"] for t in added}
    strings = [t["content"] for t in added] if added_tokens else []
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in content["model"]["vocab"].items() if i not in special}
    fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = not added_tokens

    def encode(text: str) -> list[int]:
        if len(text) > LONG_TEXT or any(x in text for x in strings):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode
