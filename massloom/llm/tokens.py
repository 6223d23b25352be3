"""Encoding a corpus with a public byte-level BPE, by traversal of a trie of its words.

The distinct words of a task's texts are put into a trie of bytes. Going down the trie
depth first, each node gets the last token of its prefix's encoding: of the tokens that
end there, the one that byte-pair merging leaves standing beside the last token of the
prefix before it. There is exactly one such token, so a node needs no more than its
ancestors, and what words have in common at their beginning is encoded once. A word's
encoding is read off backwards from its last node. No row is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: where the vocabulary lies on every executor, unless a query names another place
VOCABULARY = "byte_bpe_50k.tiktoken"
#: a task's trie is begun anew beyond so many nodes, which bounds its memory
MOST_NODES = 400_000
#: words longer than this are encoded on their own and not kept
LONG_WORD = 256


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern that splits a text into words before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TrieEncoder:
    """Encodes words by ``ranks``; keeps the trie of the words it has seen."""

    def __init__(self, ranks: dict[bytes, int], most_nodes: int = MOST_NODES):
        self.ranks, self.most_nodes = ranks, most_nodes
        self.longest = max(map(len, ranks))
        # lengths of tokens by their last two bytes, so that few slices are looked up at a node
        by_end: dict[bytes, set[int]] = {}
        for token in ranks:
            by_end.setdefault(token[-2:], set()).add(len(token))
        self.by_end = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.last: list[bytes] = [b""]

    def merged(self, text: bytes) -> list[bytes]:
        """Plain byte-pair merging, lowest rank first and leftmost on ties."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        known = self.stands.get((a, b))
        if known is None:
            if len(self.stands) > 2_000_000:
                self.stands.clear()
            known = self.stands[a, b] = self.merged(a + b) == [a, b]
        return known

    def _last_token(self, word: bytes, end: int, last: list[bytes]) -> bytes:
        """Last token of word[:end], from the last tokens of its shorter prefixes."""
        for n in self.by_end.get(word[max(0, end - 2) : end], ()) if end > 1 else (1,):
            if n <= end and (t := word[end - n : end]) in self.ranks and (n == end or self._stands(last[end - n], t)):
                return t
        return word[end - 1 : end]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        if not word:
            return []
        if word in self.ranks:
            return [self.ranks[word]]
        if len(word) > LONG_WORD:
            last = [b""]
            for end in range(1, len(word) + 1):
                last.append(self._last_token(word, end, last))
        else:
            last = self._walk(word)
        out, end = [], len(word)
        while end:
            t = last[end]
            out.append(self.ranks[t])
            end -= len(t)
        return out[::-1]

    def _walk(self, word: bytes) -> list[bytes]:
        """Last tokens of all prefixes of the word; makes the nodes that are new."""
        node, last = 0, [b""]
        for end in range(1, len(word) + 1):
            following = self.child[node].get(word[end - 1])
            if following is None:
                following = len(self.child)
                self.child[node][word[end - 1]] = following
                self.child.append({})
                self.last.append(self._last_token(word, end, last))
            node = following
            last.append(self.last[node])
        return last

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words; sorted, they go down the trie depth first."""
        if len(self.child) > self.most_nodes:
            self.clear()
        return {w: self.encode(w) for w in sorted(words)}


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``out``, the list of token ids of ``text``, to every row.

    Null and empty texts both get the empty list; a blank text is encoded as it is, and
    strings that look like special tokens are ordinary text. Whole texts of any length
    are encoded. A column named ``out`` is replaced.
    """
    path = path or vocabulary_path()
    splitter = pattern()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        find = regex.compile(splitter).findall
        encoder = TrieEncoder(load_ranks(path))
        known: dict[str, list[int]] = {}
        for batch in batches:
            results = []
            for start in range(0, len(batch), 256):
                split = [find(x) if x else [] for x in batch.iloc[start : start + 256]]
                new = {w for words in split for w in words if w not in known}
                if len(known) > MOST_NODES:
                    known.clear()
                    new = {w for words in split for w in words}
                encoding = encoder.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
                known.update((w, encoding[w.encode("utf-8", "surrogatepass")]) for w in new)
                results += [[i for w in words for i in known[w]] for words in split]
            yield pd.Series(results, dtype=object)

    return df.withColumn(out, encoded(F.col(text)))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """Adds the number of tokens of each text; 0 for null and empty ones."""
    return encode_texts(df, text, out, path).withColumn(out, F.size(out))


def as_long(c: Column) -> Column:
    return c.cast("bigint")
