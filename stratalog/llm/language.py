"""Language identification by cross-parsing: suffix automata of labelled text, fewest phrases win.

One suffix automaton per language is built from a bounded sample of that language's text. A text is parsed greedily
into the longest phrases that the automaton holds; phrases times log2(sample size) over the text's length estimates its
cross-entropy in bits a symbol, and the language with the least wins (ties: the smaller name). A symbol that the language's
sample doesn't have is a phrase of its own and costs the logarithm of the alphabet besides.

Texts are parsed whole. To parse many at once they are cut into windows that start a parse of their own, all of which advance
one symbol at a time together; then the last phrase of each window goes on into the next, until it ends where a
phrase of that window begins: from there on both parses are the same. The phrases are exactly those of the greedy parse.

Symbols: every lower-cased letter that the samples hold, one symbol for all other letters, and one for every run of anything
else. Transitions are sparse: rows of different states are laid into each other, so a table grows with the sample and
not with the alphabet.

Bounds of the sample, parameters of fit(): `docs_a_language` documents, picked by a hash of their id, equal texts once, whole, and fewer of
them where they would exceed `symbols` characters, which texts of some thousand characters do after a few dozen; the first is
taken whatever its length. A table has about 20 bytes a character, on the driver and in each worker; so of more than `total` /
`symbols` languages each has its share of `total` only, and `total` is to be raised with the memory there is.
Every fifth is kept out of the automaton, to tell what is usual for unseen text of the language.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled text at all,
every text is `und`. Ids that are null are never learned from; rows that share an id are learned from as one, by the text that
sorts first. More than MOST_LANGUAGES values of lang are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import slices, utf8
from stratalog.llm.shared import give_back, small_batches

DOCS, SYMBOLS, TOTAL, WINDOW, AHEAD, MOST_LANGUAGES = 300, 100_000, 3_000_000, 512, 64, 100_000
UNKNOWN = "und"
#: bits a symbol above a language's own mean beyond which a filter takes a text for no language; for texts
#: of fewer than STEADY symbols the excess counts in proportion to their length
EXCESS_BITS, STEADY = 4.0, 200
_alphabetic: list[np.ndarray] = []


def alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _alphabetic:
        _alphabetic.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alphabetic[0]


class Languages:
    """The automata of all languages. A state is the place where its row begins; the transition by a symbol lies that many
    places on, and is the state's own where `owner` names the state there."""

    def __init__(self, samples: dict[str, list[str]], held: dict[str, list[str]] | None = None):
        self.names = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.letters = {ord(c): k + 2 for k, c in enumerate(letters)}
        self.width = len(letters) + 2
        owners, goes, self.start, dead, self.log2, at = [], [], [], [], [], 0
        for name in self.names:
            codes, _ = self.encode(["\n".join(samples[name])])
            owner, to, none = laid([*automaton(codes.tolist()), {}], self.width)
            owners.append(np.where(owner < 0, -1, owner + at))
            goes.append(to + at)
            self.start.append(at)
            dead.append(at + none)
            self.log2.append(np.log2(max(len(codes), 2)))
            at += len(owner)
        self.owner = np.concatenate(owners).astype(np.int32) if owners else np.zeros(0, np.int32)
        self.to = np.concatenate(goes).astype(np.int32) if goes else np.zeros(0, np.int32)
        self.start = np.array(self.start, np.int32)
        # where each language's parse goes from its start: a symbol that no text of the sample has is a phrase by itself
        self.first = np.zeros((len(self.names), self.width), np.int32)
        for k, (s, none) in enumerate(zip(self.start, dead)):
            place = s + np.arange(self.width)
            self.first[k] = np.where(self.owner[place] == s, self.to[place], none)
        self.unseen = self.first == np.array(dead, np.int32)[:, None]
        self.log2 = np.array(self.log2)
        self.usual = np.full(len(self.names), np.nan)
        for k, name in enumerate(self.names):
            if texts := (held or {}).get(name):
                bits, n = self.bits(texts)
                self.usual[k] = bits[:, k].sum() / max(1, n.sum())
        # a language of one labelled text: as for the others; if there are none, nothing is too much
        known = self.usual[~np.isnan(self.usual)]
        self.usual[np.isnan(self.usual)] = known.max() if len(known) else np.inf

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, one after another, and how many each has."""
        if not hasattr(self, "_symbol"):
            self._symbol = alphabetic().astype(np.int32)
            for c, k in self.letters.items():
                self._symbol[c] = k
        low = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self._symbol[points]
        keep = codes > 0
        gap = ~keep
        gap[1:] &= keep[:-1]
        keep |= gap
        ends = np.cumsum([len(t) + 1 for t in low]) - 1  # of the separators between texts
        keep[ends[:-1]] = False
        kept = np.append(0, np.cumsum(keep))
        cuts = np.append(ends, len(points))[: len(low)]
        begins = np.append(0, ends[:-1] + 1)
        return codes[keep], kept[np.minimum(cuts, len(points))] - kept[begins]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_symbol"}

    def _step(self, language: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more symbol, and whether a phrase begins with it."""
        place = state + code
        new = self.owner.take(place) != state
        return np.where(new, self.first[language, code], self.to.take(place)), new

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: phrases times log2(sample), and the spelling of symbols that the sample doesn't have, in bits for
        the whole text; and the texts' symbols."""
        codes, counts = self.encode(texts)
        total = np.zeros((len(self.names), len(texts)))
        begins = np.cumsum(counts) - counts
        for k, row in enumerate(self._phrases(codes, begins, counts)):
            at = np.append(0, np.cumsum(row))
            total[k] = (at[begins + counts] - at[begins]) * self.log2[k]
            odd = np.flatnonzero(self.unseen[k].take(codes))
            total[k] += (np.searchsorted(odd, begins + counts) - np.searchsorted(odd, begins)) * np.log2(self.width)
        return total.T, counts

    def _phrases(self, codes: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Languages x symbols: whether a phrase of the greedy parse begins there."""
        n_languages, n = len(self.names), len(codes)
        windows = -(-counts // WINDOW)
        owner = np.repeat(np.arange(len(counts)), windows)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = begins[owner] + k * WINDOW
        high = np.minimum(low + WINDOW, (begins + counts)[owner])
        flags = np.zeros((n_languages, n + 1), bool)
        # every window by itself
        order = np.argsort(low - high, kind="stable")
        at, length = low[order], (high - low)[order]
        state = np.repeat(self.start[:, None], len(order), 1)
        every = np.arange(n_languages)[:, None]
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for j, m in enumerate(live):
            now = at[:m] + j
            state[:, :m], new = self._step(every, state[:, :m], codes[now])
            flags[:, now] = new
        flags[:, low] = True
        if not len(owner) or windows.max() < 2:
            return flags[:, :n]
        # each window's last phrase goes on into the windows after it, at first all together for up to AHEAD symbols
        last = np.empty_like(state)
        last[:, order] = state
        goes_on = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))
        head = np.repeat(np.cumsum(windows) - windows, windows)
        language, window = (x.reshape(-1) for x in np.meshgrid(np.arange(n_languages), goes_on, indexing="ij"))
        from_, stop = high[window], (begins + counts)[owner][window]
        state, seen = last[language, window], np.zeros((len(window), AHEAD), bool)
        length, met = np.zeros(len(window), np.int64), np.full(len(window), -1, np.int64)
        live = np.arange(len(window))
        for j in range(AHEAD):
            over = from_[live] + j >= stop[live]
            met[live[over]] = n + 1
            live = live[~over]
            if not len(live):
                break
            now = from_[live] + j
            state[live], new = self._step(language[live], state[live], codes[now])
            seen[live, j] = new
            length[live] = j + 1
            same = new & flags[language[live], now]
            met[live[same]] = now[same]
            live = live[~same]
        # in the order of a text's windows: what an earlier phrase or repair has passed over has no say
        fixed = flags.copy()
        fixed[:, low[goes_on + 1]] = False
        valid, done, text = np.zeros(len(window), bool), 0, None
        for i, (k, w, at, found) in enumerate(zip(language.tolist(), head[window].tolist(), from_.tolist(), met.tolist())):
            if (k, w) != text:
                text, done = (k, w), 0
            if done < at:
                valid[i] = True
                done = found if found >= 0 else self._run_on(k, int(state[i]), codes, at + AHEAD, int(stop[i]), flags[k], fixed[k])
        own = np.flatnonzero(valid)
        pair = np.repeat(own, length[own])
        step = np.arange(len(pair)) - np.repeat(np.cumsum(length[own]) - length[own], length[own])
        fixed[language[pair], from_[pair] + step] = seen[pair, step]
        return fixed[:, :n]

    def _run_on(self, k: int, state: int, codes: np.ndarray, at: int, stop: int, flags: np.ndarray, fixed: np.ndarray) -> int:
        """One parse alone, as far as it takes to meet another's phrase; where that is."""
        owner, to, first, code = memoryview(self.owner), memoryview(self.to), self.first[k].tolist(), memoryview(codes)
        while at < stop:
            c = code[at]
            if owner[state + c] == state:
                state = to[state + c]
                fixed[at] = False
            else:
                state = first[c]
                fixed[at] = True
                if flags[at]:
                    return at
            at += 1
        return len(codes) + 1

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol beyond the usual for it, per text."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
        different = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        if len(different) < len(texts):
            names, score, excess = self.judge(list(different))
            back = [different[t] for t in texts]
            return [names[k] for k in back], score[back], excess[back]
        bits, counts = self.bits(texts)
        best = bits.argmin(1)
        score = 1 / np.exp(np.minimum(0.35 * (bits.min(1)[:, None] - bits), 0)).sum(1)
        letter = alphabetic()
        lettered = np.array([bool(t) and any(letter[ord(c)] for c in t[:64]) or bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
        excess = (bits.min(1) / np.maximum(counts, 1) - self.usual[best]) * np.minimum(1, counts / STEADY)
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), np.where(lettered, excess, np.inf)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of a suffix automaton; state 0 is its start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        now, p = len(goto) - 1, last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = now
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                copy = len(goto) - 1
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return goto


def laid(goto: list[dict[int, int]], width: int, slack: float = 1.5) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of transitions laid into each other: (owner, to), and the place of the last state. State 0 begins at place 0.
    A row begins at a place of its own, so a place's owner is known by where its row begins."""
    size = int(max(sum(map(len, goto)), len(goto)) * slack) + 4 * width + 16
    rng = np.random.default_rng(7)
    place, free, taken = {0: 0}, bytearray(b"\1") * size, bytearray(size)
    taken[0] = 1
    for c in goto[0]:
        free[c] = 0
    tries = iter(())
    for s in sorted((s for s in range(1, len(goto)) if len(goto[s]) > 1), key=lambda s: -len(goto[s])):
        own = tuple(goto[s])
        while True:
            at = next(tries, None)
            if at is None:
                tries = iter(rng.integers(1, size - width, 100_000).tolist())
            elif not taken[at] and all(free[at + c] for c in own):
                break
        place[s] = at
        taken[at] = 1
        for c in own:
            free[at + c] = 0
    # rows of one transition fit wherever a place is free
    gaps = iter(np.flatnonzero(np.frombuffer(free, np.uint8)).tolist())
    left: list[int] = []  # free places that a row of another symbol could not use
    for s in range(1, len(goto)):
        if len(goto[s]) != 1:
            continue
        (c,) = goto[s]
        for i, g in enumerate(left):
            if g >= c and not taken[g - c]:
                left.pop(i)
                break
        else:
            for g in gaps:
                if g >= c and not taken[g - c]:
                    break
                if len(left) < 50:
                    left.append(g)
            else:
                return laid(goto, width, 1.5 * slack)
        place[s] = g - c
        taken[g - c] = 1
    unused = iter(k for k in range(size) if not taken[k])
    for s in range(1, len(goto)):
        if not goto[s]:
            place[s] = next(unused)
    owner, to = np.full(size + width, -1, np.int64), np.zeros(size + width, np.int64)
    for s, row in enumerate(goto):
        for c, t in row.items():
            owner[place[s] + c] = place[s]
            to[place[s] + c] = place[t]
    return owner, to, place[len(goto) - 1]


def fit(docs: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_a_language: int = DOCS, symbols: int = SYMBOLS, total: int = TOTAL) -> Languages:
    """Automata from rows where the SQL condition `learn` on id_col holds and the language isn't null."""
    small_batches(docs.sparkSession)
    key = F.col(id_col).cast("string")
    rows = docs.filter(f"({learn}) and {id_col} is not null and {lang_col} is not null").filter(F.col(text_col) != "")
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not counts:
        return Languages({})
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, n long")
    share = 1.5 * docs_a_language
    few = F.pmod("h", F.lit(1_000_003)) < F.least(F.lit(1_000_003), F.floor(1_000_003 * share / F.col("n")) + 1)
    picked = rows.join(F.broadcast(counts), "lang").filter(few)  # a row a language, MOST_LANGUAGES at most
    # lengths first, so that no more text than the bound comes to the driver; rows that share an id count once
    sizes = picked.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n")).collect()  # about 1.5 * docs_a_language rows a language
    by: dict[str, list] = {}
    for r in sorted(sizes, key=lambda r: r.h):
        by.setdefault(r.lang, []).append(r)
    bound = min(symbols, total // max(1, len(by)))
    chosen = []
    for lang, own in by.items():
        size = 0
        for k, r in enumerate(own[:docs_a_language]):
            if not k or size + r.n <= 5 * bound // 4:
                size += r.n
                chosen.append((lang, r.h))
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    got = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    samples, held = {}, {}
    for lang in list(by):
        texts = list(dict.fromkeys(r.text for r in sorted(got, key=lambda r: r.h) if r.lang == lang))
        if any(c.isalpha() for t in texts for c in t):
            held[lang] = texts[4::5] if len(texts) > 4 else texts[1:][-1:]
            out = set(held[lang])
            samples[lang] = [t for t in texts if t not in out]
            if not any(c.isalpha() for t in samples[lang] for c in t):
                samples[lang], held[lang] = texts, []
    del got, sizes, by
    model = Languages(samples, held)
    del samples, held
    give_back()
    return model


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score and excess_bits."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for texts, a, n in _texts(b.column("text")):
                names, score, excess = model.value.judge(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(a, n), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()), "excess_bits": pa.array(excess, pa.float64())})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, excess_bits double")


def keep_languages(docs: DataFrame, model: Languages, text_col: str = "text", excess_bits: float = EXCESS_BITS) -> DataFrame:
    """The rows of docs, whatever their columns, whose text is in one of the languages."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, at=docs.columns.index(text_col)):
        for b in batches:
            for texts, a, n in _texts(b.column(at)):
                names, _, excess = model.value.judge(texts)
                yield b.slice(a, n).filter(pa.array([k != UNKNOWN and x <= excess_bits for k, x in zip(names, excess)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def _texts(column: pa.Array):
    _, offsets = utf8(column)
    for a, b in slices(offsets):
        yield column.slice(a, b - a).to_pylist(), a, b - a
