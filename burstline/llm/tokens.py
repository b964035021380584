"""Token ids of whole texts by a public tokenizer file, with a memory of words."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# bytes that words, and parts of words, with their ids may take in a worker; beyond, all are forgotten
MEMORY = 48 << 20
# characters beyond printable Latin letters, line ends and blanks
_ODD_LETTER = "[^\n\x20-\x7e\u00a1-\u00ac\u00ae-\u012f]"
_ENTRY = 160  # a word and its ids in a dictionary, besides their characters and bytes
_TOGETHER = 128  # words that go to the model in one call
_LAST = 0xF0000  # letters that end a word are written as private characters from here on


_BLANK, _LETTER, _NUMERAL, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """The kind of each character up to U+012F: by its byte, or from 256 on by the two of its code."""
    def kind(c: str) -> int:
        name = unicodedata.category(c)[0]
        return _BLANK if c.isspace() else _LETTER if name == "L" else _NUMERAL if name == "N" else _OTHER

    return np.array([kind(chr(c)) for c in range(256)] + [kind(chr(c)) for c in range(0x80, 0x140)], np.uint8)


_KIND = _kinds()


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of texts, for tokenizer files of lower-cased words: white space only parts words.

    Each word is encoded once and remembered; the ids of a text are those of its words in a row. Printable
    words of Latin letters, where normalising means lower-casing, go to the tokenizer's model part by part,
    by the file's own pattern; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._model = self._encoder.model
        self.size = self._encoder.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        if [n["type"] for n in steps["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer file of lower-cased words is needed")
        self._parts = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._special = sorted({t["content"][:2] for t in steps["added_tokens"]})
        self._letters = byte_letters()
        self._ids = [i.to_bytes(4, "little") for i in range(self.size)]
        self._many = _model_of_many(steps["model"])
        self.forget()

    def forget(self) -> None:
        """Give back the memory of words."""
        self._known: dict[str, bytes] = {}
        self._known_parts: dict[str, bytes] = {}
        self._held = 0

    def _encoded(self, letters: str) -> bytes:
        return b"".join([self._ids[t.id] for t in self._model.tokenize(letters)])

    def _spelt(self, part: str) -> str:
        """A part in the letters of the vocabulary."""
        return part if part.isascii() else "".join(map(self._letters.__getitem__, part.encode()))

    def _together(self, parts: list[str]) -> list[bytes]:
        """Ids of parts in the letters of the vocabulary, many in one call of the model."""
        if self._many is None:
            return list(map(self._encoded, parts))
        model, last, ends = self._many
        out: list[bytes] = []
        for lo in range(0, len(parts), _TOGETHER):
            some = parts[lo:lo + _TOGETHER]
            joined = "".join([p[:-1] + last.get(p[-1], p[-1]) for p in some])
            ids = np.array([t.id for t in model.tokenize(joined)], "<u4")
            raw, at = ids.tobytes(), (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(at) == len(some) and at[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *at], at)]
            else:  # a letter that the vocabulary lacks
                out += map(self._encoded, some)
        return out

    def _part(self, part: str) -> bytes:
        ids = self._known_parts.get(part)
        if ids is None:
            ids = self._encoded(self._spelt(part))
            self._known_parts[part] = ids
            self._held += _ENTRY + len(part) + len(ids)
        return ids

    def _plain(self, word: str) -> bool:
        return word.isprintable() and (word.isascii() or max(word) < "İ") and not any(s in word for s in self._special)

    def _word(self, word: str) -> bytes:
        if self._plain(word):
            low = word.lower()
            return self._part(low) if low.isalpha() else b"".join(map(self._part, self._parts.findall(low)))
        return np.array(self._encoder.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]], unsigned 32-bit.

        Each distinct word, or part of a word, of the texts is looked up once.
        """
        units, (first, last) = self._units(pa.array(texts, pa.large_string()))
        units = units.dictionary_encode()
        found = self._lookup(units.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # the units of the texts, one text after the other
        count = last - first
        at = units.indices.to_numpy()[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        taken = n[at]
        ends = np.concatenate([[0], np.cumsum(taken)])
        out = ids[np.repeat((np.cumsum(n) - n)[at] - ends[:-1], taken) + np.arange(ends[-1])]
        return out, ends[np.concatenate([[0], np.cumsum(count)])]

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(strings, bounds) per text, whose ids in a row are those of the text: parts by the kind of their letters, in
        lower case, where that is all that normalising does; else what stands between blanks."""
        odd = pc.match_substring_regex(texts, _ODD_LETTER)
        for s in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        parts, at = _parts(pc.utf8_lower(texts.filter(pc.invert(odd))))
        rest = pc.split_pattern(pc.replace_substring(texts.filter(odd), "\n", " "), " ")
        places = np.concatenate([at, len(parts) + rest.offsets.to_numpy()[1:]])
        # texts with odd letters stand behind the others
        rank = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([parts, rest.flatten()]), np.stack([places[:-1][rank], places[1:][rank]])

    def _lookup(self, words: list[str]) -> list[bytes]:
        out = list(map(self._known.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        letters, rest = [], []
        for k in new:  # most are single parts
            w = words[k]
            if w.isascii() and w.isalpha() and w.islower():
                letters.append((k, w))
            elif self._plain(w) and (low := w.lower()).isalpha():
                letters.append((k, self._spelt(low)))
            else:
                rest.append(k)
        for (k, _), ids in zip(letters, self._together([p for _, p in letters])):
            out[k] = ids
        for k in rest:
            out[k] = self._word(words[k])
        for k in new:
            if self._held > MEMORY:
                self.forget()
            self._known[words[k]] = out[k]
            self._held += _ENTRY + len(words[k]) + len(out[k])
        return out


def _model_of_many(model: dict) -> tuple | None:
    """(model, last letters, whether an id ends a word) for words without anything between them, or None.

    The file's pieces and merges with each letter that ends a word written as one character of its own: nothing merges
    across the end of a word, so the ids of many words in a row are those of each.
    """
    from tokenizers.models import BPE

    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    lasts = sorted(v[0] for v in model["vocab"] if len(v) == 1 + len(suffix) and v.endswith(suffix))
    last = {c: chr(_LAST + i) for i, c in enumerate(lasts)}
    if any(a.endswith(suffix) for a, _ in merges) or any(
            v.endswith(suffix) and v[:-len(suffix)][-1:] not in last for v in model["vocab"]):
        return None

    def renamed(piece: str) -> str:
        return piece[:-len(suffix) - 1] + last[piece[-len(suffix) - 1]] if piece.endswith(suffix) else piece

    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for v, i in model["vocab"].items() if v.endswith(suffix)]] = True
    return BPE({renamed(v): i for v, i in model["vocab"].items()}, [(renamed(a), renamed(b)) for a, b in merges]), last, ends


def _parts(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(strings, bounds): runs of letters, single numerals, runs of other characters and runs of white space of texts
    without odd letters, each word with an apostrophe in one."""
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    begins = offsets - offsets[0]
    kind = _KIND[data]
    wide = np.flatnonzero(data >= 0xC2)  # two bytes
    kind[wide] = kind[wide + 1] = _KIND[0x100 + (data[wide] - 0xC2).astype(np.int64) * 64 + (data[wide + 1] & 63)]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMERAL)
    new[wide + 1] = False
    new[begins] = True
    if (data == 0x27).any():  # what follows an apostrophe depends on what stands before it
        edge = new[:-1] & ((kind == _BLANK) | np.concatenate([[True], kind[:-1] == _BLANK]))
        edge[begins[:-1][begins[:-1] < len(data)]] = True
        word = np.cumsum(edge) - 1
        whole = np.bincount(word[data == 0x27], minlength=word[-1] + 1) > 0
        new[:-1] &= edge | ~whole[word]
    starts = np.flatnonzero(new)
    strings = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes()))
    return strings, np.searchsorted(starts, begins)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def unload(path: str) -> None:
    """Give back a tokenizer's memory: for workers that go on to other work."""
    _loaded.pop(path, None)
