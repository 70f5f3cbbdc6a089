"""Encoding whole columns of text with a tokenizers-library model.

The model drops white space, and its splitting cuts text into parts (runs of
letters, single digits, runs of other characters) that are encoded apart from
each other. A batch of texts is cut into parts with array operations, and the
library encodes each part that the worker hasn't met before.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

MEMO_PARTS = 1_000_000
END_ID = 1
SPACE, LETTER, DIGIT, OTHER, ODD, UNKNOWN = range(6)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PartTable:
    """A bounded hash table from parts of up to 16 bytes to their ids.

    Keys are kept whole (two 8-byte words and a length), so a hit is exact.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self._start(1 << (2 * self.limit - 1).bit_length())

    def _start(self, slots: int) -> None:
        self._slots = slots
        self._lo, self._hi = np.zeros(self._slots, np.uint64), np.zeros(self._slots, np.uint64)
        self._len = np.zeros(self._slots, np.uint8)
        self._row = np.zeros(self._slots, np.int32)
        self.size = 0

    def _first_slot(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        mixed = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(
            np.int64
        ) & (self._slots - 1)

    def find(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(lo), -1, np.int32)
        left, slot = np.arange(len(lo)), self._first_slot(lo, hi)
        while len(left):
            same = (self._lo[slot] == lo[left]) & (self._hi[slot] == hi[left]) & (self._len[slot] == n[left])
            out[left[same]] = self._row[slot[same]]
            more = ~same & (self._len[slot] > 0)
            left, slot = left[more], (slot[more] + 1) & (self._slots - 1)
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
        """Add distinct keys that aren't there yet."""
        if 3 * (self.size + len(lo)) > 2 * self._slots:  # one text of very many parts
            held = np.flatnonzero(self._len)
            old = self._lo[held], self._hi[held], self._len[held], self._row[held]
            self._start(1 << (2 * (self.size + len(lo))).bit_length())
            self.add(*old)
        self.size += len(lo)
        left, slot = np.arange(len(lo)), self._first_slot(lo, hi)
        while len(left):
            free = np.flatnonzero(self._len[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = left[free[first]]
            self._lo[at], self._hi[at], self._len[at], self._row[at] = lo[won], hi[won], n[won], rows[won]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & (self._slots - 1)


class TextEncoder:
    """Encodes texts to unsigned 32-bit ids, as the library does for whole texts.

    Only for BPE models that normalise by NFC and lower case, split by SPLIT
    and mark ends of parts, such as word_bpe_49k; another model is an error.
    Words with an apostrophe and long parts are encoded one by one with a
    memo; texts in which the model might find a special token, that aren't in
    NFC, or that hold a character of kind ODD are given to the library whole.

    What kind a character is, the model's own splitter says, at the
    character's first occurrence. ODD ones are those whose normal form isn't
    known to be the same here and in the library: its normaliser makes of one
    alone something else than its lower case, that is several characters, or
    it is a mark that wasn't in the Unicode standard before its normal forms
    became stable.
    """

    # How the model normalises text and by which pattern it splits it.
    NORMAL = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, memo_parts: int = MEMO_PARTS, chunk_chars: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._check()
        vocab = self._model.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(self._model.get_vocab_size(), bool)
        self._ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self._kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._table = PartTable(memo_parts)
        self._odd: dict[bytes, int] = {}
        self._chunk = chunk_chars
        self._forget()

    def _check(self) -> None:
        made = json.loads(self._model.to_str())
        steps = (made["normalizer"] or {}).get("normalizers", [])
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = (
            [x["type"] for x in steps] == self.NORMAL
            and splits[0].get("pattern") == {"Regex": self.SPLIT}
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and made["model"].get("end_of_word_suffix") == "</w>"
            and all(x["content"].startswith("<|") for x in made["added_tokens"])
        )
        if not known:
            raise ValueError("not a model that this encoder knows how to split for")

    def _learn_kinds(self, chars: np.ndarray) -> None:
        """Set the kind of every character that isn't known yet."""
        split = self._model.pre_tokenizer.pre_tokenize_str
        for code in np.unique(chars[self._kind[chars] == UNKNOWN]).tolist():
            char = chr(code)
            mark = unicodedata.category(char) in ("Mn", "Mc", "Me", "Cn")
            normal = " " if char.isspace() else char.lower()
            if (
                self._model.normalizer.normalize_str(char) != normal
                or len(normal) > 1
                or (mark and not unicodedata.ucd_3_2_0.category(char).startswith("M"))
            ):
                self._kind[code] = ODD
            elif not split(char):
                self._kind[code] = SPACE
            elif len(split(f"a{char}a")) == 1:
                self._kind[code] = LETTER
            else:
                self._kind[code] = OTHER if len(split(f"!{char}!")) == 1 else DIGIT

    def _forget(self) -> None:
        self._table.clear()
        self._odd.clear()
        self._pool = np.zeros(1 << 16, np.uint32)
        self._used, self._at, self._n = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text begins and the last one ends.

        end_id, unless None, follows each text.
        """
        all_ids, all_n, at = [], [], 0
        while at < len(texts):
            took, stop = 0, at
            while stop < len(texts) and (stop == at or took < self._chunk):
                took += len(texts[stop])
                stop += 1
            ids, n = self._chunk_ids(texts[at:stop])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                n = n + 1
            all_ids.append(ids)
            all_n.append(n)
            at = stop
        ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)
        return ids, np.concatenate(([0], np.cumsum(np.concatenate(all_n)))) if all_n else np.zeros(1, np.int64)

    def _chunk_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        self._learn_kinds(chars)
        lasts = np.cumsum([len(t) + 1 for t in texts])
        odd = set(np.searchsorted(lasts, np.flatnonzero(self._kind[chars] == ODD), "right").tolist())
        # the library lower-cases every sigma alike, wherever it stands
        lowered = [t.replace("Σ", "σ").lower() for t in texts]
        whole = {  # parts of a text that lower-casing takes out of NFC would be composed anew by the library
            i: self._library(t)
            for i, t in enumerate(texts)
            if i in odd or "<|" in t or not (unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", lowered[i]))
        }
        plain = ["" if i in whole else t for i, t in enumerate(lowered)]
        ids, n = self._plain_ids(plain)
        if whole:
            cuts = np.concatenate(([0], np.cumsum(n)))
            pieces = [whole.get(i, ids[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]
            ids, n = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, n

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._table.size > self._table.limit or len(self._odd) > self._table.limit // 4:
            self._forget()
        joined = "\n".join([*texts, ""])
        octets = joined.encode()
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        self._learn_kinds(chars)
        kind = self._kind[chars]
        before = np.concatenate(([SPACE], kind[:-1]))
        starts = np.flatnonzero((kind != SPACE) & ((kind != before) | (kind == DIGIT)))
        cuts = np.flatnonzero((kind != before) | (kind == DIGIT))
        ends = np.append(cuts, len(chars))[np.searchsorted(cuts, starts, "right")]
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        del width
        quotes = np.flatnonzero(chars == 0x27)
        if len(quotes):  # these words may hold contractions
            space = np.flatnonzero(kind == SPACE)
            to = space[np.searchsorted(space, quotes)]
            since = np.concatenate(([-1], space))[np.searchsorted(space, quotes)] + 1
            since, to = np.unique(since), np.unique(to)
            inside = np.searchsorted(since, starts, "right") - 1
            free = (inside < 0) | (starts >= to[inside])
            starts, ends = np.append(starts[free], since), np.append(ends[free], to)
            odd = np.append(np.zeros(int(free.sum()), bool), np.ones(len(since), bool))
            order = np.argsort(starts, kind="stable")
            starts, ends, odd = starts[order], ends[order], odd[order]
        else:
            odd = np.zeros(len(starts), bool)
        row = self._rows(octets, place[starts], place[ends], odd)
        n = self._n[row]
        per_text = np.searchsorted(starts, text_ends)
        total = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(self._at[row] - total[:-1], n) + np.arange(total[-1])
        return self._pool[take], np.diff(total[np.concatenate(([0], per_text))])

    def _rows(self, octets: bytes, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """The row of each part in the pool's directory."""
        n = ends - starts
        odd = odd | (n > 16)
        padded = octets + bytes(24)
        words = np.ndarray((len(octets) + 16,), "<u8", padded, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        row = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(~odd)
        s, m = starts[short], n[short]
        lo, hi = words[s] & keep[np.minimum(m, 8)], words[s + 8] & keep[np.maximum(m - 8, 0)]
        found = self._table.find(lo, hi, m)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            order = lost[np.lexsort((lo[lost], hi[lost], m[lost]))]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0) | (np.diff(m[order]) != 0)
            first = order[new]
            rows = self._learn([octets[i:j].decode() for i, j in zip(s[first].tolist(), (s[first] + m[first]).tolist(), strict=True)])
            self._table.add(lo[first], hi[first], m[first], rows)
            found[order] = rows[np.cumsum(new) - 1]
        row[short] = found
        others = np.flatnonzero(odd)
        keys = [octets[i:j] for i, j in zip(starts[others].tolist(), ends[others].tolist(), strict=True)]
        fresh = list(set(keys).difference(self._odd))
        for quoted in (False, True):
            some = [k for k in fresh if (b"'" in k) is quoted]
            texts = [k.decode() for k in some]
            rows = self._store([self._library(t) for t in texts]) if quoted else self._learn(texts)
            self._odd.update(zip(some, rows.tolist(), strict=True))
        row[others] = [self._odd[key] for key in keys]
        return row

    def _learn(self, parts: list[str]) -> np.ndarray:
        found: list[np.ndarray] = []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = self._library(" ".join(some))
            stops = np.flatnonzero(self._ends[ids]) + 1
            found += np.split(ids, stops[:-1]) if len(stops) == len(some) else map(self._library, some)
        return self._store(found)

    def _store(self, found: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in found], np.int64)
        need = self._used + int(n.sum())
        if need > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros(max(need, len(self._pool)), np.uint32)))
        self._pool[self._used : need] = np.concatenate([*found, np.zeros(0, np.uint32)])
        rows = np.arange(len(self._at), len(self._at) + len(found))
        self._at = np.append(self._at, self._used + np.cumsum(n) - n)
        self._n = np.append(self._n, n)
        self._used = need
        return rows

    def _library(self, text: str) -> np.ndarray:
        found = self._model.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and model, so that its memo lasts."""
    return TextEncoder(path)
