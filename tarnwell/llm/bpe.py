"""Exact and fast use of public tokenizers: each distinct piece of text is encoded once and remembered.

Both vocabularies split a text before they merge, and no split reaches over the places at which
texts are cut here. A piece between two cuts therefore encodes alike in every text.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Pieces that a worker remembers in a generation; forgetting costs time but changes no result.
REMEMBER = 500_000
END_OF_TEXT = "<|endoftext|>"


#: White space without a break from which a text goes to the library of the JSON file: the other one's pattern runs out of
#: stack near a million such characters.
LONG_SPACE = re.compile(r"\s{65536}")


class ByteBpe:
    """Ids of byte-level BPE as an array of unsigned 32-bit numbers, as the library of the JSON file gives them.

    The ranks file holds the same vocabulary; its encoder is several times faster and gives the same ids. Texts with very
    long runs of white space, which it cannot split, are encoded by the JSON file's library. The
    special string in a text is its own token, as is the library's default.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, special: str = END_OF_TEXT) -> None:
        self.path, self.tokenizer = path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= 65536 and LONG_SPACE.search(text):
            if self.tokenizer is None:
                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special="all")


class WholeWords:
    """Token counts of word-level BPE with word ends, by proven whole tokens.

    ``proven`` holds the strings that the library encodes alone as one token; pre-tokens among them count
    one without merging, and only the rest is merged, many at a time. Texts are cut at white space, over
    which neither splitting nor normalising reaches; counts of pieces are remembered in two generations.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD_SPACE = re.compile("[\x1c-\x1f]")
    PLAIN = re.compile("[\x00-\u024f]*")

    def __init__(self, path: str, proven: frozenset[str], end: str = "</w>") -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.proven = proven
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def merge(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merge_all(self, tokens: list[str]) -> None:
        """Token counts of pre-tokens, encoded in one text; each ends with the token that carries its word end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(tokens)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(self.ends[ids])
        if len(at) == len(tokens):
            self.merged.update(zip(tokens, np.diff(at, prepend=-1).tolist()))
        else:
            self.merged.update((t, self.merge(t)) for t in tokens)

    def learn(self, pieces: set[str]) -> None:
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
            self.merged = {}
        new = pieces - self.young.keys()
        for p in new & self.old.keys():
            self.young[p] = self.old[p]
        new -= self.young.keys()
        split = {}
        for p in new:
            # Other scripts have letter cases and compositions that only the library's normaliser settles.
            if "<|" in p or not self.PLAIN.fullmatch(p):
                self.young[p] = self.merge(p)
            else:
                split[p] = self.SPLIT.findall(p.lower())
        rest = sorted(set().union(*split.values()) - self.proven - self.merged.keys())
        for lo in range(0, len(rest), 2000):
            self.merge_all(rest[lo : lo + 2000])
        for p, tokens in split.items():
            self.young[p] = sum(1 if t in self.proven else self.merged[t] for t in tokens)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [None if self.ODD_SPACE.search(t) else t.split() for t in texts]
        self.learn(set().union(*(p for p in parts if p)))
        return [self.merge(t) if p is None else sum(map(self.young.__getitem__, p)) for t, p in zip(texts, parts)]


def prove_whole_tokens(path: str, end: str = "</w>") -> frozenset[str]:
    """Vocabulary strings (as text, without the word end) that the tokenizer encodes alone as exactly one token.

    Each is put to the library itself, so nothing is inferred from the merge list. The result is
    bounded by the vocabulary.
    """
    tokenizer = Tokenizer.from_file(path)
    letters = _byte_letters()
    words = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith(end):
            try:
                words.append(bytes(letters[c] for c in token[: -len(end)]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    words = [w for w in words if w and WholeWords.PLAIN.fullmatch(w) and WholeWords.SPLIT.findall(w) == [w] and w == w.lower()]
    found = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, found) if len(e.ids) == 1)


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable bytes themselves, then the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
