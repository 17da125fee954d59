"""Token ids of whole texts, the same as the tokenizers library gives, at several times its speed.

Most texts are simple: Latin letters, single white-space characters, no added token.  There the byte-level
pre-tokenizer needs no look-ahead, so its pattern runs as a plain automaton, and the merges of the same
vocabulary file run in a faster public engine.  Any other text goes to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

#: The byte-level pre-tokenizer's pattern where no two white-space characters are adjacent.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

#: What makes a text not simple: adjacent white space, characters beyond Latin Extended-B, separators 1C-1F
#: and the numerals that are no digits, on which Python's classes and Unicode's differ.
_NOT_SIMPLE = re.compile("\\s\\s|[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")


#: Bytes that need the pattern's look (1C-1F, all leads but those of U+00C0 to U+023F) become 1C, white space becomes a space.
_CLASSES = bytes(0x1C if 0x1C <= b <= 0x1F or b == 0xC2 or b >= 0xC9 else 0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def is_simple(text: str, added: list[str]) -> bool:
    seen = text.encode().translate(_CLASSES)
    if (b"\x1c" in seen or b"  " in seen) and _NOT_SIMPLE.search(text):
        return False
    return not any(x in text for x in added)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """A vocabulary file: an absolute path as it is, else a name in the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=4)
def vocabulary(name: str) -> dict:
    with open(tokenizer_path(name), encoding="utf-8") as file:
        return json.load(file)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def _simple_encoder(name: str):
    """The fast engine, or None if the file's ids are not in merge order, on which that engine relies."""
    import tiktoken

    spec = vocabulary(name)
    vocab, value = spec["model"]["vocab"], {x: b for b, x in enumerate(byte_alphabet())}
    added = {x["content"] for x in spec["added_tokens"]}
    merged = [vocab["".join(x) if isinstance(x, list) else x.replace(" ", "")] for x in spec["model"]["merges"]]
    if merged != sorted(set(merged)):
        return None
    ranks = {bytes(value[x] for x in token): k for token, k in vocab.items() if token not in added}
    return tiktoken.Encoding("simple", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=4)
def packed_encoder(name: str = DEFAULT_TOKENIZER):
    """A function from a text to its ids as an array of little-endian unsigned 32-bit integers."""
    import numpy as np

    encode, fast = library_tokenizer(name).encode, _simple_encoder(name)
    added = [x["content"] for x in vocabulary(name)["added_tokens"]]

    def packed(text: str) -> np.ndarray:
        if fast and is_simple(text, added):
            return np.array(fast(text), "<u4")
        return np.array(encode(text, add_special_tokens=False).ids, "<u4")

    return packed
