"""Token ids through the ``tokenizers`` library, with a bounded per-worker memo of words.

The normaliser of a tokenizer for which ``splits_at_spaces`` holds turns every run of white space into one
space, its pre-tokenizer drops spaces, and none of its special strings has one.  The ids of a text are then the
ids of its space-separated words, one after another, so the library needs to see each word only once.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

#: Words kept per worker process (60 bytes each), and new ones that are gathered before they are merged with those.
MEMO_WORDS, FRESH_WORDS = 1_000_000, 60_000
#: Words of up to so many 8-byte loads are kept; longer ones are encoded anew for each batch.
LOADS = 4
_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_digest(path: str) -> str:
    """Version digest of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_spaces(spec: dict) -> bool:
    """Whether words between ASCII spaces can be encoded apart, judged from the tokenizer's own description."""
    rules = (spec.get("normalizer") or {}).get("normalizers", [])
    collapses = any(r.get("type") == "Replace" and r["pattern"] == {"Regex": "\\s+"} and r["content"] == " " for r in rules)
    harmless = all(r.get("type") in ("NFC", "Replace", "Lowercase") for r in rules)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    drops = drops and "[^\\s\\p{L}\\p{N}]+" in steps[0]["pattern"].get("Regex", "")
    apart = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec.get("added_tokens", []))
    return collapses and harmless and drops and apart


class Encoder:
    """Ids of texts as little-endian bytes, 2 bytes an id where the vocabulary allows, else 4."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_spaces(spec)
        #: A special string is found before all else and cuts a text, so it can stand between words.
        special = [t for t in spec.get("added_tokens", []) if t["special"] and not t["normalized"]]
        self.cut = (special[0]["content"], special[0]["id"]) if special else None
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        #: Ids that end a word, for vocabularies that mark them: a word of ASCII letters is one run of ids up to such an id.
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo, self.fresh = WordMemo(self.dtype), WordMemo(self.dtype)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, many in one text."""
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.ends is not None else []  # of bytes: ASCII only
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([words[i] for i in part]).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) != len(part):
                letters = letters[:at]  # not as the vocabulary says: leave the rest to the marks
                break
            raw = ids.tobytes()
            for i, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                out[i] = raw[a:b]
        done = set(letters)
        rest = [i for i in range(len(words)) if i not in done] if done else range(len(words))
        for i, x in zip(rest, self._encode_marked([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _encode_marked(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words: many in one text, held apart by a special string, which spares a call for each."""
        if not words:
            return []
        if self.cut is None:
            return self._encode([w.decode() for w in words])
        mark, mark_id = self.cut
        size, out = self.dtype.itemsize, []
        joined = [mark.join([w.decode() for w in words[i : i + 1000]]) for i in range(0, len(words), 1000)]
        for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(x.ids, dtype=self.dtype)
            raw, cuts = ids.tobytes(), np.flatnonzero(ids == mark_id) * size
            out += [raw[i:j] for i, j in zip([0, *(cuts + size).tolist()], [*cuts.tolist(), len(raw)], strict=True)]
        return out

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        whole = b" ".join(words)
        special = [i for i, w in enumerate(words) if any(x in w for x in self.specials)] if any(x in whole for x in self.specials) else []
        apart = set(special)
        plain = [i for i in range(len(words)) if i not in apart] if apart else range(len(words))
        ids: list[bytes] = [b""] * len(words)
        encoded = self._encode_words([words[i] for i in plain]) if len(plain) else []
        for i, x in zip(plain, encoded, strict=True):
            ids[i] = x
        for i, x in zip(special, self._encode([words[i].decode() for i in special]) if special else [], strict=True):
            ids[i] = x
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return np.frombuffer(b"".join(ids), self.dtype), n

    def _known(self, mix: np.ndarray, keys: list[np.ndarray], data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct short words: a pool of ids, where each word's ids begin in it, and how many they are."""
        if len(self.fresh.mix) > FRESH_WORDS:
            self.memo.merge(self.fresh, MEMO_WORDS)
            self.fresh = WordMemo(self.dtype)
        at, n = np.full(len(mix), -1), np.zeros(len(mix), np.int64)
        base = 0
        for table in (self.memo, self.fresh):
            where = table.find(mix, keys)
            met = where >= 0
            at[met], n[met] = table.at[where[met]] + base, table.n[where[met]]
            base += len(table.pool)
        new = np.flatnonzero(at < 0)
        words = [data[i : i + k] for i, k in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)]
        ids, count = self._ids_of(words)
        begin = np.cumsum(count) - count
        at[new], n[new] = begin + base, count
        pool = np.concatenate((self.memo.pool, self.fresh.pool, ids))
        self.fresh.merge(WordMemo(self.dtype, mix[new], [k[new] for k in keys], begin, count, ids), 1 << 62)
        return pool, at, n

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text begins (with the end as last)."""
        raw = [t.encode() for t in texts]
        if not self.by_word:
            parts = self._encode(texts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
            return np.frombuffer(b"".join(parts), self.dtype), np.concatenate(([0], np.cumsum(sizes)))
        begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        data = b" ".join([*raw, b" " * 64])  # the tail lets all loads start at any word
        starts, sizes = word_places(np.frombuffer(data, np.uint8))
        which = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= 8 * LOADS)
        mix, keys = word_keys(data, starts[short], sizes[short])
        mix, first, back = np.unique(mix, return_index=True, return_inverse=True)
        if all((k[first[back]] == k).all() for k in keys):
            which[short] = back
            rest = np.flatnonzero(sizes > 8 * LOADS)
        else:  # two words of one mix: all words of the batch go by a dictionary
            first, rest, mix = first[:0], np.arange(len(starts)), mix[:0]
        pool, pool_at, n = self._known(mix, [k[first] for k in keys], data, starts[short][first], sizes[short][first])
        number: dict[bytes, int] = {}
        for i in rest.tolist():
            which[i] = number.setdefault(data[starts[i] : starts[i] + sizes[i]], len(mix) + len(number))
        if number:
            ids, count = self._ids_of(list(number))
            pool_at, n, pool = np.concatenate((pool_at, np.cumsum(count) - count + len(pool))), np.concatenate((n, count)), np.concatenate((pool, ids))
        per_word = n[which]
        stop = np.cumsum(per_word)
        gather = np.arange(stop[-1] if len(stop) else 0) + np.repeat(pool_at[which] - stop + per_word, per_word)
        upto = np.concatenate(([0], stop))
        return pool[gather], upto[np.searchsorted(starts, begin)]

    def ids(self, texts: list[str]) -> list[bytes]:
        flat, at = self.flat(texts)
        raw, at = flat.tobytes(), (at * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        return np.diff(self.flat(texts)[1]).tolist()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words between ASCII white space; the data ends with a space."""
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1)))
    return edge[::2], edge[1::2] - edge[::2]


def word_keys(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of up to ``8 * LOADS`` bytes as masked 8-byte loads and a length, and a 64-bit mix of those.

    The mix only groups; equality is always checked on the loads and the length.
    """
    load = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    keys = []
    for at in range(0, 8 * LOADS, 8):
        bits = (np.clip(sizes - at, 0, 8) * 8).astype(np.uint64)
        mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        keys.append(load[starts + at] & mask)
    keys.append(sizes.astype(np.uint64))  # a word may end in zero bytes
    mix = keys[0] * np.uint64(0x9E3779B97F4A7C15)
    for k in keys[1:]:
        mix = (mix ^ (mix >> np.uint64(29)) ^ k) * np.uint64(0xBF58476D1CE4E5B9)
    return mix, keys


class WordMemo:
    """Known words in order of their mix, with their ids in a pool; words in use outlive a merge that is too large."""

    def __init__(self, dtype: np.dtype, mix=None, keys=None, at=None, n=None, pool=None) -> None:
        none = np.zeros(0, np.int64)
        self.mix = np.zeros(0, np.uint64) if mix is None else mix
        self.keys = [np.zeros(0, np.uint64)] * (LOADS + 1) if keys is None else keys
        self.at, self.n, self.pool = (none, none, np.zeros(0, dtype)) if at is None else (at, n, pool)
        self.used = np.ones(len(self.mix), bool)

    def find(self, mix: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Place of each word, -1 where it is not known."""
        if not len(self.mix):
            return np.full(len(mix), -1)
        at = np.searchsorted(self.mix, mix)
        at[at == len(self.mix)] = 0
        same = self.mix[at] == mix
        for own, other in zip(self.keys, keys, strict=True):
            same &= own[at] == other
        self.used[at[same]] = True
        return np.where(same, at, -1)

    def merge(self, other: "WordMemo", most: int) -> None:
        """Take in the words of ``other``; beyond ``most`` only words met since the last such cut stay."""
        keep = np.ones(len(self.mix), bool)
        if len(self.mix) + len(other.mix) > most:
            keep = self.used.copy() if self.used.sum() < 0.7 * len(keep) else np.zeros(len(self.mix), bool)
            self.used[:] = False
        own = self.mix[keep]
        spot = np.searchsorted(own, other.mix)
        add = (spot == len(own)) | (own[np.minimum(spot, len(own) - 1)] != other.mix) if len(own) else np.ones(len(other.mix), bool)
        mix = np.concatenate((own, other.mix[add]))  # of two words with one mix only the first is kept
        order = np.argsort(mix, kind="stable")
        self.mix = mix[order]
        self.keys = [np.concatenate((a[keep], b[add]))[order] for a, b in zip(self.keys, other.keys, strict=True)]
        n = np.concatenate((self.n[keep], other.n[add]))
        at = np.concatenate((self.at[keep], other.at[add] + len(self.pool)))
        source = np.concatenate((self.pool, other.pool))
        stop = np.cumsum(n)
        self.pool = source[np.arange(stop[-1] if len(stop) else 0) + np.repeat(at - stop + n, n)]
        self.used = np.concatenate((self.used[keep], np.zeros(int(add.sum()), bool)))[order]
        self.at, self.n = (stop - n)[order], n[order]


def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays loaded for the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
