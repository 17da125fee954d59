"""Operator 4: byte-level BPE encoding and decoding by our own merge engine.

A segment tree stands over the adjacent pairs of a pre-token.  Each leaf holds the pair's merge rank and place,
each inner node the smaller child, so the root is the leftmost pair of lowest rank.  A merge changes three leaves,
each repaired up to the root in logarithmic time; it ends when the root holds no mergeable pair.  Ids equal the tokenizers
library's.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .tokens import DEFAULT_TOKENIZER, byte_alphabet, is_simple, library_tokenizer, vocabulary


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge `symbols` until no adjacent pair is in `merges`, which gives a pair's rank and the merged symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    none = len(merges) * n + n  # above every rank * n + place
    size = 1 << (n - 2).bit_length()
    tree = [none] * (2 * size)  # the root is tree[1], the children of tree[i] are tree[2 * i] and tree[2 * i + 1]
    tree[size : size + n - 1] = [found[0] * n + i if (found := get(pair)) else none for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < none:
        i = least % n
        j = after[i]
        symbols[i] = merged = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        changed = [(i, found[0] * n + i if k < n and (found := get((merged, symbols[k]))) else none)]
        if j < n - 1:
            changed.append((j, none))
        if k < n:
            before[k] = i
        if (k := before[i]) >= 0:
            changed.append((k, found[0] * n + k if (found := get((symbols[k], merged))) else none))
        for place, value in changed:
            at = size + place
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                if a > b:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
    return [x for x in symbols if x >= 0]


#: The same pattern as tokens.PATTERN, in the classes of Python's `re`, for simple texts.
_SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s")

#: Pre-tokens that a worker's cache may hold, about 250 bytes each.
CACHE_ENTRIES = 1_000_000
#: Longer pre-tokens are merged each time.
CACHE_CHARS = 64


class WordCache:
    """Pre-token -> ids in two generations: a full young one becomes the old one; what is used again moves back."""

    def __init__(self, encode):
        self.old: dict = {}
        cache = self

        class Young(dict):
            def __missing__(self, word: str):
                if (found := cache.old.get(word)) is None:
                    found = encode(word)
                    if len(word) > CACHE_CHARS:
                        return found
                if 2 * len(self) >= CACHE_ENTRIES:
                    cache.old = dict(self)
                    self.clear()
                self[word] = found
                return found

        self.get = Young().__getitem__


class Bpe:
    """A byte-level BPE read from a vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        spec = vocabulary(name)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.letters = [vocab[x] for x in alphabet]
        value = {x: b for b, x in enumerate(alphabet)}
        size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(value[x] for x in token) if all(x in value for x in token) else token.encode()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, k in self.added.items():
            self.bytes_of[k] = content.encode()
        self.added_names = list(self.added)
        self.digits = [str(k) for k in range(size)]
        split = library_tokenizer(name).pre_tokenizer.pre_tokenize_str
        self.split = lambda text: [text[a:b] for _, (a, b) in split(text)]
        self.cache = WordCache(self._word)

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(merge_symbols([*map(self.letters.__getitem__, word.encode())], self.merges))

    def _words(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.cache.get, words)))

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; an added token's string in the text becomes that token."""
        if is_simple(text, self.added_names):
            return self._words(_SIMPLE.findall(text))
        out: list[int] = []
        while at := [(text.find(x), -len(x), x) for x in self.added_names if x in text]:
            start, size, content = min(at)
            out += [*self._words(self.split(text[:start])), self.added[content]]
            text = text[start - size :]
        return out + self._words(self.split(text)) if text else out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def bpe(name: str = DEFAULT_TOKENIZER) -> Bpe:
    return Bpe(name)


def encode_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, ids: the ids of each row's whole text, whatever its length.

    Null and empty texts give an empty list; null ids stay null; repeated rows repeat; an empty table gives no rows; other
    columns are not read, so their names may clash with ours.  Of pairs of equal rank the leftmost merges first.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = bpe(tokenizer).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, text from doc_id, ids.  Null ids give an empty text; repeated rows repeat; an empty table gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = bpe(tokenizer).decode
        for batch in batches:
            texts = [decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from those ids, in one pass.

    Texts of any length are read whole.  Null and empty texts have no ids and decode to the empty text; a null doc_id
    stays null; repeated rows repeat; an empty table gives no rows; other columns are not read, so their names may clash.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        engine = bpe(tokenizer)
        digits = engine.digits.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, shas, backs = [], [], []
                for text in part.column("text").to_pylist():
                    ids = engine.encode(text or "")
                    sizes.append(len(ids))
                    shas.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                    backs.append(hashlib.sha256(engine.decode(ids).encode()).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(backs)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
