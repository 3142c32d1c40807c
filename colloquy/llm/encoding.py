"""Token ids of whole texts by a public vocabulary, inside Spark tasks.

The tokenizers library encodes every distinct pre-token once; a task then finds
the ids of the pre-tokens it has seen in a table of numpy arrays, by a 64-bit
code, and compares the bytes of every hit. A text goes to the library as it is
where the split into pre-tokens is not certain (characters outside a set of
Latin letters, digits and signs, or an apostrophe), where it holds the string of
an added token such as an end of text, and where two pre-tokens share a code.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np

from colloquy.llm.textscan import LONG, lanes, range_codes

#: Pre-tokens that one worker remembers before it starts afresh.
MOST_WORDS = 800_000
#: And so many bytes of them.
MOST_BYTES = 64 << 20
#: So many new words are encoded as one text.
JOINED = 512

# The characters for which the vocabularies' rules for pre-tokens are followed here.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7e¡-¬®-±´¶-¸»¿{_LETTER}×÷‐-‧€]|İ")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

WHITE, LETTER, DIGIT, SIGN = 0, 1, 2, 3
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[9, 10, 13, 32]] = WHITE
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
_KIND[48:58] = DIGIT


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    if len(lead):
        first, second = data[lead], data[lead + 1]
        kind[lead[(first == 0xC2) & np.isin(second, (0xAA, 0xB5, 0xBA))]] = LETTER
        kind[lead[(first == 0xC3) & np.isin(second, (0x97, 0xB7))]] = SIGN
        kind[lead + 1] = kind[lead]
    return kind


def pre_tokens(data: np.ndarray, off: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts, and the first of each text (one more entry at the end).

    Runs of letters, of digits and of signs. For ``words`` digits stand alone and
    white space falls away; otherwise a space belongs to what follows it, and of
    other white space the last character before something stands alone.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    kind = _kinds(data)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[off] = True
    begins |= opens[:-1]
    if words:
        begins |= kind == DIGIT
    else:
        after = np.flatnonzero((kind[1:] != WHITE) & (kind[:-1] == WHITE) & ~opens[1:-1]) + 1
        begins[after - 1] = True
        begins[after[data[after - 1] == 32]] = False
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    if words:
        held = kind[start] != WHITE
        start, end = start[held], end[held]
    return start, end, np.searchsorted(start, off)


class _Table:
    """Places of 64-bit keys, by open addressing."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at, open_ = keys & self.mask, np.arange(len(keys))
        while len(open_):
            here = at[open_]
            held = self.keys[here]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (held != 0)]
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys on from the last."""
        values = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        at, open_ = keys & self.mask, np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[at[open_]] == 0]
            self.keys[at[free]] = keys[free]
            placed = free[self.keys[at[free]] == keys[free]]  # of several keys for one place one got it
            self.values[at[placed]] = values[placed]
            open_ = np.setdiff1d(open_, placed, assume_unique=True)
            at[open_] = (at[open_] + np.uint64(1)) & self.mask


class Encoder:
    """``lower``: the vocabulary reads lower-case text, else it reads bytes and spaces."""

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.lower = lower
        self._forget()

    def _forget(self) -> None:
        self.table, self.ids = _Table(), np.zeros(0, np.uint32)
        self.bounds, self.places = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = np.zeros(0, np.uint8)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, new: list[str]) -> list[bytes]:
        """Ids of pre-tokens. Those made of letters are encoded many at a time, as a text whose pre-tokens they are."""
        known: dict[str, bytes] = {}
        plain = [w for w in new if w.isalpha()] if self.lower else [w for w in new if w[0] == " " and w[1:].isalpha()]
        chunks = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        gap = " " if self.lower else ""
        for chunk, coded in zip(chunks, self.library.encode_batch([gap.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids, word = np.array(coded.ids, "<u4"), np.array(coded.word_ids)
            cuts = [0, *(np.flatnonzero(word[1:] != word[:-1]) + 1).tolist(), len(ids)]
            raw = ids.tobytes()
            known.update(zip(chunk, [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        rest = [w for w in new if w not in known]
        known.update(zip(rest, self._ask(rest), strict=True))
        return [known[w] for w in new]

    def _differ(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which pre-tokens are other bytes than those of the entry that their code found."""
        size, at = end - start, self.places[entry]
        out = size != self.places[entry + 1] - at
        # Codes of up to 8 bytes of one length are all different, so longer ones are left to compare.
        open_ = np.flatnonzero(~out & (size > 8) & (size <= LONG))
        mine, theirs = lanes(data), lanes(self.held)
        for step in range(0, LONG, 8):
            open_ = open_[size[open_] > step]
            if not len(open_):
                break
            back = np.minimum(step, size[open_] - 8)  # the last eight bytes overlap the ones before
            out[open_] |= mine[start[open_] + back] != theirs[at[open_] + back]
        for i in np.flatnonzero(~out & (size > LONG)).tolist():
            out[i] = not np.array_equal(data[start[i] : end[i]], self.held[at[i] : at[i] + size[i]])
        return out

    def _looked_up(self, texts: list[str]) -> list[bytes | None]:
        raws = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        all_bytes = b"".join(raws)
        data = np.frombuffer(all_bytes, np.uint8)
        start, end, first = pre_tokens(data, off, self.lower)
        keys = range_codes(data, start, end)
        keys[keys == 0] = 1
        if self.table.size > MOST_WORDS or len(self.held) > MOST_BYTES:
            self._forget()
        entry = self.table.find(keys)
        gaps = np.flatnonzero(entry < 0)
        if len(gaps):
            new, at = np.unique(keys[gaps], return_index=True)
            words = [all_bytes[a:b] for a, b in zip(start[gaps[at]].tolist(), end[gaps[at]].tolist(), strict=True)]
            coded = self._encode_words([w.decode() for w in words])
            self.table.add(new)
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(c) // 4 for c in coded])])
            self.held = np.concatenate([self.held, np.frombuffer(b"".join(words), np.uint8)])
            self.places = np.concatenate([self.places, self.places[-1] + np.cumsum([len(w) for w in words])])
            entry[gaps] = self.table.find(keys[gaps])
        other = set((np.searchsorted(first, np.flatnonzero(self._differ(data, start, end, entry)), "right") - 1).tolist())
        size = self.bounds[entry + 1] - self.bounds[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.bounds[entry] - total[:-1], size)].astype("<u4", copy=False)
        cuts = total[first].tolist()
        return [None if i in other else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]

    def _certain(self, text: str) -> bool:
        """Whether the split into pre-tokens is certain."""
        if "'" in text or (not text.isascii() and _OTHER.search(text)) or (not text.isprintable() and _CONTROL.search(text)):
            return False
        return not any(token in text for token in self.added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        split = [i for i, t in enumerate(texts) if self._certain(t)]
        if split:
            for i, ids in zip(split, self._looked_up([texts[i].lower() if self.lower else texts[i] for i in split]), strict=True):
                out[i] = ids
        whole = [i for i, ids in enumerate(out) if ids is None]
        if whole:
            for i, ids in zip(whole, self._ask([texts[i] for i in whole]), strict=True):
                out[i] = ids
        return out


def encoder(path: str, lower: bool) -> Encoder:
    """The encoder of this Python worker, kept from one task to the next."""
    held = sys.modules.setdefault("_colloquy_encoders", types.ModuleType("_colloquy_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path, lower)
    return held.__dict__[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
