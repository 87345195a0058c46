"""Token counts per section: whole texts are encoded once, tokens are attributed by their offsets.

Sections are the lines of a text (a line break ends the section it belongs to), or any character spans
that `sections` gives. Token starts and section bounds are sorted, so the interval join is one search of all
in all.
A token that crosses a border goes by `rule`: "first" (the section of its first character), "last" (of its
last), or "split" (to each in proportion to the characters it has there). A token before, between or after
given spans counts to no section. Counts of a text's sections and of its rest always add up to its tokens.

Defined cases: null and empty texts have no tokens and one empty section; rows with equal ids stay separate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import slices, utf8
from stratalog.llm.shared import small_batches
from stratalog.llm.tokens import ranks_of, tokenizer_of

#: bytes of text whose encodings are held at once; a longer text is encoded alone
TOGETHER = 100_000
RULES = ("first", "last", "split")


def lines(text: str) -> list[tuple[int, int]]:
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    cuts = [0, *ends]
    return list(zip(cuts, [*ends, len(text)]))


def attribute(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]], rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens (or shares of tokens) of each of the sorted, disjoint spans; and how many tokens cross a border. A token reaches
    from its start to its stop, where the tokenizer's offsets have them; several that make up one character all have that."""
    begin, end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    starts, stops = np.asarray(starts, np.int64), np.asarray(stops, np.int64)
    final = np.maximum(stops - 1, starts)
    low, high = (np.searchsorted(begin, at, "right") - 1 for at in (starts, final))
    # spans of no characters share their begin with the next: the last of them is found, as it should be
    crosses = (low != high) | ((low >= 0) & (final >= end[np.maximum(low, 0)]) & (starts < end[np.maximum(low, 0)]))
    out = np.zeros(len(spans))
    at, place = (low, starts) if rule == "first" else (high, final)
    ok = (at >= 0) & (place < end[np.maximum(at, 0)])
    if rule == "split":
        ok &= ~crosses
        for s, t in zip(starts[crosses], stops[crosses]):
            out += np.clip(np.minimum(end, t) - np.maximum(begin, s), 0, None) / (t - s)
    np.add.at(out, at[ok], 1)
    return out, int(crosses.sum())


def encoded(tokenizer, texts: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each text and the offsets (start and stop, as characters) of its tokens. Whole texts are encoded, once. tokenizer: one of
    `tokenizers`, which has offsets, or what ranks_of() gives: there a token reaches over as many bytes as its id
    stands for, and from the character of the first of them to that of the last."""
    if isinstance(tokenizer, tuple):
        encoding, sizes = tokenizer
        for text in texts:
            text = text.as_py() or ""
            ids = encoding.encode_to_numpy(text, allowed_special="all")
            raw = np.frombuffer(text.encode(), np.uint8)
            character = np.cumsum((raw & 0xC0) != 0x80) - 1
            stops = np.cumsum(sizes[ids])
            yield text, np.stack([character[stops - sizes[ids]], character[stops - 1] + 1], 1)
        return
    _, offsets = utf8(texts)
    for a, b in slices(offsets, TOGETHER):
        own = [t or "" for t in texts.slice(a, b - a).to_pylist()]
        for text, e in zip(own, tokenizer.encode_batch(own, add_special_tokens=False)):
            yield text, np.fromiter(chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections: Callable[[str], list[tuple[int, int]]] = lines, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, n_sections, n_crossing and section_tokens, in the order of the sections. tokenizer: a JSON file, or
    with `pattern` (what pre-tokens are) and `special` tokens a file of ranks, which encodes the same several times as fast."""
    small_batches(docs.sparkSession)
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        own = ranks_of(tokenizer, pattern, special or {}) if pattern else tokenizer_of(tokenizer)
        for b in batches:
            tokens, n_sections, crossing, counts = [], [], [], []
            for text, at in encoded(own, b.column("text")):
                spans = sections(text)
                got, crosses = attribute(at[:, 0], at[:, 1], spans, rule)
                tokens.append(len(at)), n_sections.append(len(spans)), crossing.append(crosses), counts.append(got)
            cuts = np.append(0, np.cumsum(n_sections)).astype(np.int32)
            flat = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(tokens, pa.int64()), "n_sections": pa.array(n_sections, pa.int64()), "n_crossing": pa.array(crossing, pa.int64()), "section_tokens": pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
