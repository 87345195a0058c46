"""Exact token ids of whole texts, with a bounded cache of the stretches between spaces.

A byte-level BPE whose pre-tokens are ` ?letters`, ` ?digits`, ` ?others` or white space always starts a
new token at a single space between two non-space characters, so a text can be cut there and each stretch
(with the space before it) encoded by itself. Within a stretch it also starts one where a run of letters ends
and on both sides of a lone line break, so an unknown stretch is put together from parts that mostly are known.
Stretches and parts that recur are encoded once per worker. A text that holds the string of an added token, such
as the end of a text, is encoded as a whole, so that the string becomes that token as the tokenizer has it. So is
every text where the file's pre-tokenizer, normalizer or model is another than that.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

import numpy as np

CACHED, LONGEST = 600_000, 48
#: letters only, though not all letters: a run is cut off where what follows is no letter at all
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the n-th other as character 256 + n."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}


_SHOWN = _byte_letters()
_WRITTEN = {c: "".join(_SHOWN[b] for b in chr(c).encode()) for c in range(256) if chr(c).isalpha()}
_SPACE = _SHOWN[32]


def tokenizer_of(path: str):
    """The tokenizer as its file has it, on one thread, as a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranks_of(path: str, pattern: str, special: dict[str, int]):
    """The encoding of a file of ranks (a token in base 64 and its id a line), and how many bytes each id stands for."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
    sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), sizes


def cuts_at_spaces(path: str) -> bool:
    """Whether the file is a byte-level BPE of which the rules above hold."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    before, model = own.get("pre_tokenizer") or {}, own.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(plain and merges and not own.get("normalizer"))


class Encoder(dict):
    """Maps a stretch without its leading space to the bytes of its ids, or None where it can't stand alone."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizer_of(path)
        self.whole = not cuts_at_spaces(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.merges = getattr(self.tokenizer.model, "tokenize", None)

    def word(self, letters: str, space: str) -> bytes:
        """A run of letters is one pre-token, so its ids come from the merges alone."""
        return array("I", [t.id for t in self.merges(space + letters.translate(_WRITTEN))]).tobytes()

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, stretch: str) -> bytes | None:
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            value = None
        else:
            m = _LETTERS.match(stretch)
            cut = m.end() if m else 0
            if cut and cut < len(stretch) and not stretch[cut].isalpha():
                value = self[stretch[:cut]] + self.bare(stretch[cut:])
            else:
                value = self.word(stretch, _SPACE) if cut == len(stretch) else self.direct(" " + stretch)
        if len(stretch) <= LONGEST:
            self[stretch] = value
        return value

    def bare(self, text: str) -> bytes:
        """The ids of a stretch, or a part of one, that no space precedes."""
        if (value := self.parts.get(text)) is not None:
            return value
        before, line, after = text.partition("\n")
        m = _LETTERS.match(text)
        cut = m.end() if m else 0
        if line and before and after and not before[-1].isspace() and not after[0].isspace():
            value = self.bare(before) + self.bare(line) + self.bare(after)
        elif cut and cut < len(text) and not text[cut].isalpha():
            value = self.bare(text[:cut]) + self.bare(text[cut:])
        else:
            value = self.word(text, "") if cut == len(text) else self.direct(text)
        if len(text) <= LONGEST:
            self.parts[text] = value
        return value

    def values(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self.whole or any(a in text for a in self.added):
            return np.frombuffer(self.direct(text), np.uint32)
        if len(self) > CACHED or len(self.parts) > CACHED:
            self.clear(), self.parts.clear()
        parts = text.split(" ")
        head, found = parts[0], [self[p] for p in parts[1:]]
        if (not head or head[0].isspace() or head[-1].isspace()) or None in found:
            parts, found = self._joined(parts)
            head = parts[0]
        return np.frombuffer(self.direct(head) + b"".join(found), np.uint32)

    def _joined(self, parts: list[str]) -> tuple[list[str], list[bytes]]:
        """The text cut only at spaces between two non-space characters."""
        runs = [[parts[0]]]
        for before, p in zip(parts, parts[1:]):
            if before and p and not before[-1].isspace() and not p[0].isspace():
                runs.append([p])
            else:
                runs[-1].append(p)
        joined = [" ".join(r) for r in runs]
        found = [(self[j] if len(r) == 1 else None) or self.direct(" " + j) for r, j in zip(runs[1:], joined[1:])]
        return joined, found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_bytes: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    if path not in _bytes:
        own = encoder(path).tokenizer
        of = {c: b for b, c in _SHOWN.items()}
        added = own.get_added_tokens_decoder()
        table = [b""] * own.get_vocab_size(with_added_tokens=True)
        for token, i in own.get_vocab(with_added_tokens=True).items():
            table[i] = added[i].content.encode() if i in added else bytes(of[c] for c in token)
        _bytes[path] = table
    return _bytes[path]
