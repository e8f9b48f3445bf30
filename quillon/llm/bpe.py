"""Byte-pair encoding, vectorised over distinct words: speculate by greedy longest match, verify every
adjacent pair, merge exactly only the words that fail.

A word's canonical encoding is the one sequence of vocabulary tokens whose adjacent pairs are each what
exact merging makes of the two tokens' bytes. So a greedy proposal that passes every pair check is the
exact result, and only the others need merging.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import flat, held_over, ragged

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Distinct chunks a worker remembers before it starts afresh.
CACHE_CHUNKS = 600_000
#: Stands between chunks that are split in one call; a private-use character.
MARK = "\ue000"
_MARK = MARK.encode()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies, inverted; a fixed value of the file format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The file's own normaliser, but for white space, which no word holds. Its Unicode tables are those that ids depend on.
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
#: First UTF-8 byte of U+0240: below it every Unicode version composes and lower-cases alike, and letters are the same.
_WIDE = 0xC9


def _normal(text: str) -> str:
    return text.lower() if text.isascii() else _NORMAL.normalize_str(text)


@functools.cache
def _letters_and_numbers() -> tuple[dict[str, str], np.ndarray]:
    r"""\p{L} and \p{N} as the library knows them, as ranges; and a table of the code points that `regex` takes for one
    and the library does not: Unicode versions differ, so the library is asked."""
    out, odd = {}, np.zeros(0x110000, bool)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}"):
        mine = "".join(regex.findall(name, every))
        split = pre_tokenizers.Split(Regex(f"[{name}]+"), "removed", invert=True)
        known = np.array([ord(c) for word, _ in split.pre_tokenize_str(mine) for c in word])
        ends = np.flatnonzero(np.diff(known) != 1)
        out[name] = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(known[np.append(0, ends + 1)].tolist(), known[np.append(ends, len(known) - 1)].tolist(), strict=True))
        odd[np.setdiff1d(np.array([ord(c) for c in mine]), known)] = True
    return out, odd


def _spelled_out(pattern: str) -> str:
    """A splitter's pattern with the library's letters and numbers in place of their names."""
    for name, ranges in _letters_and_numbers()[0].items():
        pattern = regex.sub(r"\[[^\]]*\]", lambda m, n=name, r=ranges: m[0].replace(n, r), pattern)
        pattern = pattern.replace(name, f"[{ranges}]")
    return pattern


class PairTable:
    """Open-addressing map from 64-bit keys to int32, built once, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = _U(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size + 64, ~_U(0), _U), np.full(size + 64, -1, np.int32)
        slot = ((keys * _GOLD) >> self.shift).astype(np.int64)
        self.probes = 1
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == ~_U(0)
            _, first = np.unique(slot[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[slot[left[take]]], self.values[slot[left[take]]] = keys[left[take]], values[left[take]]
            left = left[~take]
            slot[left] += 1
            self.probes += bool(len(left))
        if int(slot.max(initial=0)) >= size + 64:
            raise ValueError("pair table is too full")

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * _GOLD) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.keys[slot] != ~_U(0)))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] += 1
            hit = self.keys[slot[todo]] == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (self.keys[slot[todo]] != ~_U(0))]
        return out


class Bpe:
    """A BPE vocabulary file of the tokenizers library (byte-level), with its normaliser and word splitter.

    encode(column) returns the ids of every text, exactly as the library's encode(add_special_tokens=False)
    without truncation and padding. Null encodes as the empty text. The strings of special tokens inside a
    text become those tokens, as in the library.
    """

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        self.path, self.suffix = path, model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.words_only = bool(self.suffix)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._library = None
        if self.words_only:
            inner = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            marked = inner.replace(r"[^\s", r"[^\s" + MARK)
        else:
            inner = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level splitter's pattern
            marked = inner.replace(r"[^\s", r"[^\s" + MARK).replace(r"(?!\S)", rf"(?![^\s{MARK}])")
        # the splitter is exact for every text; the faster one is for texts without code points that it would take for letters
        self.splitter, self.marked = regex.compile(_spelled_out(inner)), regex.compile(f"{MARK}|{marked}")
        self.unknown = _letters_and_numbers()[1]

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.top = max(self.vocab.values()) + 1
        left, right, made = (np.array([self.vocab[x] for x in col], np.int64) for col in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.made = made.astype(np.int32)
        key = left.astype(_U) << _U(20) | right.astype(_U)
        _, first = np.unique(key, return_index=True)
        self.ranks = PairTable(key[first], first.astype(np.int32))
        self.byte_id = np.array([self.vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        self.end_id = np.array([self.vocab[c + self.suffix] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)

        size = max([self.top, *(i + 1 for i in self.special.values())])
        self.text: list[bytes] = [b""] * size
        self.ends = np.zeros(size, bool)
        for token, i in self.vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token not in self.special
            body = token[: -len(self.suffix)] if ends else token
            self.text[i], self.ends[i] = bytes(alphabet[c] for c in body) if all(c in alphabet for c in body) else token.encode(), ends
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.lens = np.array([len(x) for x in self.text], np.int64)
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.at = np.cumsum(self.lens) - self.lens

        # Longest match: a hash of bytes (and of the word's end) to a token, by length.
        usable = np.array(sorted(i for t, i in self.vocab.items() if t not in self.special), np.int64)
        self.longest = int(self.lens[usable].max())
        codes = self.codes(usable)
        keys, first = np.unique(codes, return_index=True)
        if len(keys) != len(usable):
            raise ValueError("two tokens share a hash")
        self.tokens = PairTable(keys, usable[first].astype(np.int32))
        self.has_len = np.zeros(self.longest + 1, bool)
        self.has_len[self.lens[usable]] = True
        self.good = np.zeros(0, _U)  # verified pairs
        self.bad = np.zeros(0, _U)
        self.reset()

    # ------------------------------------------------------------ kernels

    _STEP = _U(0x100000001B3)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """The lookup code of each token: a hash of its bytes, changed where it ends a word."""
        code = np.full(len(ids), _U(0xCBF29CE484222325), _U)
        for j in range(int(self.lens[ids].max(initial=0))):
            live = self.lens[ids] > j
            code[live] = (code[live] ^ (self.blob[self.at[ids[live]] + j].astype(_U) + _U(1))) * self._STEP
            code[live] ^= code[live] >> _U(29)
        return np.where(self.ends[ids], code ^ _U(0x5851F42D4C957F2D), code)

    def greedy(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of each word: flat ids, and how many each word has."""
        n, end = len(off) - 1, off[1:]
        pos, live, who, ids = off[:-1].copy(), np.flatnonzero(np.diff(off) > 0), [], []
        while len(live):
            at, stop = pos[live], end[live]
            best, step = np.full(len(live), -1, np.int32), np.zeros(len(live), np.int64)
            code = np.full(len(live), _U(0xCBF29CE484222325), _U)
            sub = np.arange(len(live))
            for j in range(self.longest):
                sub = sub[at[sub] + j < stop[sub]]
                if not len(sub):
                    break
                c = (code[sub] ^ (data[at[sub] + j].astype(_U) + _U(1))) * self._STEP
                c ^= c >> _U(29)
                code[sub] = c
                if not self.has_len[j + 1]:
                    continue
                if self.suffix:
                    c = np.where(at[sub] + j + 1 == stop[sub], c ^ _U(0x5851F42D4C957F2D), c)
                got = self.tokens.get(c)
                hit = got >= 0
                best[sub[hit]], step[sub[hit]] = got[hit], j + 1
            if (best < 0).any():
                # no token starts here that also respects the word's end: leave the word to exact merging
                lost = live[best < 0]
                who.append(lost)
                ids.append(np.full(len(lost), -1, np.int32))
                live, best, step = live[best >= 0], best[best >= 0], step[best >= 0]
            who.append(live)
            ids.append(best)
            pos[live] += step
            live = live[pos[live] < end[live]]
        if not who:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        who, ids = np.concatenate(who), np.concatenate(ids)
        return ids[np.argsort(who, kind="stable")], np.bincount(who, minlength=n)

    def merge(self, data: np.ndarray, off: np.ndarray, endings: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging: in every word the leftmost pair of least rank merges, until no pair has a rank."""
        lens = np.diff(off)
        sym = self.byte_id[data].copy()
        if self.suffix:
            last = off[1:][lens > 0] - 1
            if endings is not None:
                last = last[endings[lens > 0]]
            sym[last] = self.end_id[data[last]]
        n, word = len(lens), np.repeat(np.arange(len(lens)), lens)
        done_ids, done_word = [], []
        none = np.iinfo(np.int32).max
        while len(sym):
            same = word[:-1] == word[1:]
            rank = np.full(len(sym), none, np.int32)
            got = self.ranks.get(sym[:-1][same].astype(_U) << _U(20) | sym[1:][same].astype(_U))
            rank[:-1][same] = np.where(got < 0, none, got)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            over = least == none
            if over.any():
                gone = np.repeat(over, count)
                done_ids.append(sym[gone])
                done_word.append(word[gone])
                keep = ~gone
                sym, word, rank = sym[keep], word[keep], rank[keep]
                count, least = count[~over], least[~over]
                if not len(sym):
                    break
                first = np.cumsum(count) - count
            hit = np.flatnonzero(rank == np.repeat(least, count))
            _, lead = np.unique(word[hit], return_index=True)
            hit = hit[lead]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word = np.concatenate(done_word)
        return np.concatenate(done_ids)[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the two tokens' bytes gives back just these two; answers are remembered."""
        key, back = np.unique(a.astype(_U) << _U(20) | b.astype(_U), return_inverse=True)
        new = np.setdiff1d(np.setdiff1d(key, self.good, True), self.bad, True)
        if len(new):
            pair = np.stack([new >> _U(20), new & _U(0xFFFFF)], 1).astype(np.int64).ravel()
            data = self.blob[ragged(self.at[pair], self.lens[pair])]
            lens = self.lens[pair].reshape(-1, 2).sum(1)
            ids, count = self.merge(data, np.concatenate([[0], np.cumsum(lens)]), self.ends[pair[1::2]])
            at = np.cumsum(count) - count
            two = count == 2
            ok = np.zeros(len(new), bool)
            ok[two] = (ids[at[two]] == pair[0::2][two]) & (ids[at[two] + 1] == pair[1::2][two])
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])
        where = np.searchsorted(self.good, key)
        return (self.good[np.minimum(where, len(self.good) - 1)] == key if len(self.good) else np.zeros(len(key), bool))[back]

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and their number: proposals that pass, the others merged exactly."""
        ids, count = self.greedy(data, off)
        word = np.repeat(np.arange(len(count)), count)
        fails = np.zeros(len(count), bool)
        fails[word[ids < 0]] = True
        same = (word[:-1] == word[1:]) & ~fails[word[:-1]]
        left = np.flatnonzero(same)
        if len(left):
            fails[word[left[~self.compatible(ids[left], ids[left + 1])]]] = True
        if fails.any():
            which, lens = np.flatnonzero(fails), np.diff(off)
            again, number = self.merge(data[ragged(off[which], lens[which])], np.concatenate([[0], np.cumsum(lens[which])]))
            keep = ~fails[word]
            word = np.concatenate([word[keep], np.repeat(which, number)])
            ids = np.concatenate([ids[keep], again])[np.argsort(word, kind="stable")]
            count = count.copy()
            count[which] = number
        self.speculated += len(count)
        self.merged += int(fails.sum())
        return ids, count

    # ------------------------------------------------------------ texts

    def reset(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.slot_ids, self.slot_len = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.slot_at = np.zeros(0, np.int64)
        self.speculated = self.merged = 0

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of pieces that encode independently of each other."""
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        if self.words_only:  # a word and the white space after it; words never join over white space
            blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
            cut[1:-1] |= blank[:-1] & ~blank[1:]
        else:  # a single space between two visible ASCII or multi-byte letters always starts a word
            blank = data <= 32
            wide = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)  # may start a wide blank
            tail = (data == 0x80) | (data == 0x85) | ((data >= 0xA0) & (data < 0xB0)) | ((data >= 0x80) & (data <= 0x8A)) | (data == 0x9F)  # may end one
            if len(data) > 2:
                cut[1:-2] |= (data[1:-1] == 32) & ~blank[:-2] & ~tail[:-2] & ~blank[2:] & ~wide[2:] & (data[2:] != 0x7F)
        return np.flatnonzero(cut[: len(data)])

    def _split(self, chunk: str) -> list[str]:
        if self.words_only:
            chunk = _normal(chunk)
        return self.splitter.findall(chunk)

    def _split_all(self, chunks: list[bytes], wide: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words of all chunks end to end, and each chunk's number of words; no chunk holds MARK. wide: some go beyond _WIDE."""
        text = _MARK.join(chunks).decode("utf-8", "replace")
        if self.words_only:
            text = _normal(text) if wide else text.lower()
        coded = pa.array(self.marked.findall(text), pa.large_string()).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark = coded.dictionary.to_pylist().index(MARK) if len(chunks) > 1 else -1
        gaps = np.concatenate([[-1], np.flatnonzero(index == mark), [len(index)]])
        return pa.DictionaryArray.from_arrays(pa.array(index[index != mark]), coded.dictionary), np.diff(gaps) - 1

    def _plain(self, chunk: bytes) -> bool:
        """Whether a chunk beyond _WIDE may be split with the others."""
        if _MARK in chunk:
            return False
        text = chunk.decode("utf-8", "replace")
        text = text + _normal(text) if self.words_only else text
        return not self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

    def _encode_plain(self, chunks: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are split all at once, end to end, and how many each has."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded, marks = self._split_all(chunks, wide)
        data, off = flat(coded.dictionary)
        ids, count = self.words(data, off)
        at, index = np.cumsum(count) - count, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(count[index])])[np.concatenate([[0], np.cumsum(marks)])]
        return ids[ragged(at[index], count[index])], np.diff(bounds)

    def _learn(self, new: list[bytes]) -> None:
        """Encode chunks not met before and remember them."""
        near, far, special, whole = new, [], [], b"".join(new)
        if b"<|" in whole:
            special = [x for x in new if b"<|" in x and any(s.encode() in x for s in self.special)]
            near = [x for x in new if x not in set(special)] if special else new
        if np.frombuffer(whole, np.uint8).max(initial=0) >= _WIDE:
            high = [x for x in near if not x.isascii() and max(x) >= _WIDE]
            near = [x for x in near if x.isascii() or max(x) < _WIDE]
            plain = [self._plain(x) for x in high]
            special, far = special + [x for x, p in zip(high, plain, strict=True) if not p], [x for x, p in zip(high, plain, strict=True) if p]
        # ASCII letters and one blank, after a word or (byte-level) before it, are one word: most chunks need no splitting
        if self.words_only:
            easy = [x[:-1].isalpha() and x[-1] in b" \n\t\r" for x in near]
            words = b"".join([x[:-1] for x, e in zip(near, easy, strict=True) if e]).lower()
        else:
            easy = [x[:1] == b" " and x[1:].isalpha() for x in near]
            words = b"".join([x for x, e in zip(near, easy, strict=True) if e])
        simple = [x for x, e in zip(near, easy, strict=True) if e]
        near = [x for x, e in zip(near, easy, strict=True) if not e]
        sizes = np.fromiter(map(len, simple), np.int64, len(simple)) - self.words_only
        found = self.words(np.frombuffer(words, np.uint8), np.concatenate([[0], np.cumsum(sizes)])) if simple else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        got = [found, self._encode_plain(near, False), self._encode_plain(far, True)]
        for x in special:
            ids = np.array(self._exact(x.decode("utf-8", "replace")), np.int32)
            got.append((ids, np.array([len(ids)], np.int64)))
        flat_ids, lens = (np.concatenate(x) for x in zip(*got, strict=True))
        new = simple + near + far + special
        base, first = len(self.slot_ids), len(self.slots)
        self.slots.update(zip(new, range(first, first + len(new)), strict=True))
        self.slot_ids = np.concatenate([self.slot_ids, flat_ids])
        self.slot_len = np.concatenate([self.slot_len, lens])
        self.slot_at = np.concatenate([self.slot_at, base + np.cumsum(lens) - lens])

    def _exact(self, text: str) -> list[int]:
        """A chunk that holds a special token's string: split at the first such string from the left."""
        found = sorted((text.find(s), -len(s), s) for s in self.special if s in text)
        if not found:
            out: list[int] = []
            for w in self._split(text):
                raw = np.frombuffer(w.encode(), np.uint8)
                out += self.merge(raw, np.array([0, len(raw)]))[0].tolist()
            return out
        at, _, s = found[0]
        return [*self._exact(text[:at]), self.special[s], *self._exact(text[at + len(s) :])]

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Remembered slots of every chunk of every text, flat, and each text's first chunk (one more at the end)."""
        data, off = flat(column)
        starts = self._chunks(data, off)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        if len(self.slots) > CACHE_CHUNKS:
            self.reset()
        bounds = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        raw, cut = flat(coded.dictionary)
        raw, cut = raw.tobytes(), cut.tolist()
        seen = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        slots = list(map(self.slots.get, seen))
        missing = [i for i, x in enumerate(slots) if x is None]
        if missing:
            self._learn([seen[i] for i in missing])
            for i in missing:
                slots[i] = self.slots[seen[i]]
        slot = np.array(slots, np.int64)
        return slot[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, off)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each text's start in them (one more at the end)."""
        slot, first = self.pieces(column)
        lens = self.slot_len[slot]
        ids = self.slot_ids[ragged(self.slot_at[slot], lens)]
        return ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)[first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens end to end; a word-end mark is a space."""
        ids = np.asarray(ids, np.int64)
        if not self.suffix:
            return self.blob[ragged(self.at[ids], self.lens[ids])].tobytes()
        return b"".join(self.text[i] + b" " * bool(self.ends[i]) for i in ids)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
        held_over.append(_loaded[path])
    return _loaded[path]


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
