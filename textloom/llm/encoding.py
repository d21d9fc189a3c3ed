"""Exact byte-level BPE encoding of whole texts by Arrow batches, with a bounded memory of words.

A vocabulary whose pre-tokeniser is plain byte-level splits every text before a single space unless white
space stands on both sides of it, so the segments between such spaces can be encoded alone and joined. A batch is
cut into segments by Arrow, each distinct segment is encoded once, and the ids are joined by numpy.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pattern of the byte-level pre-tokeniser (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments that one worker remembers; of up to so many bytes each, so this takes some 20 MB at most.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 32
#: Longer segments go to the library itself.
LONGEST = 1000
#: Bytes of text that are cut into segments at once.
PART = 4 << 20

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that has white space on both sides, or white space before it and nothing after.
_UNSAFE = rf"{_SPACE} (?:{_SPACE}|\z)"
#: Segments of letters that all libraries class alike and of ASCII marks and digits, breaks inside at most.
_LETTERS = r"!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}\x{410}-\x{44f}\x{4e00}-\x{9fa5}\x{3041}-\x{3094}\x{30a1}-\x{30fa}\x{ac00}-\x{d7a3}"
_PLAIN = rf"\A[{_LETTERS}](?:[{_LETTERS}\n\t]*[{_LETTERS}])?\z"


def _byte_of_char() -> dict[str, int]:
    """The format's printable stand-in of each byte: itself where printable, else 256 upwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _settled(text: str) -> bool:
    """Whether all characters are of an early Unicode version, which all libraries class alike."""
    return text.isascii() or all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in text)


def _gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges ``start``, ``length`` of ``pool``, one after the other."""
    before = np.cumsum(length) - length
    return pool[np.arange(int(length.sum())) + np.repeat(start - before, length)]


class TextEncoder:
    """``encode_batch(texts)`` gives the ids of each text, exactly as the library would."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.ranked = self._ranked(spec)
        self._forget()

    @property
    def library(self):
        """The vocabulary's own library, loaded when a text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _ranked(self, spec: dict):
        """A faster encoder of the same vocabulary, where ids are the merge order; else None."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("ignore_merges") or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            return None
        byte = _byte_of_char()
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:])) or len(ranks) != 256 + len(pairs):
            return None
        import tiktoken

        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        return tiktoken.Encoding("segments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _segment(self, text: str) -> list[int]:
        if len(text) <= LONGEST and _settled(text):
            return self.ranked.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``words``, each after a space; count of each). Those that are plain are encoded as one text,
        whose tokens' bytes tell where each word ends."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) & (size <= LONGEST)
        own = words.filter(pa.array(plain))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), " ")[0].as_py()
        joined = np.array(self.ranked.encode_ordinary(" " + text) if len(own) else [], np.uint32)
        place = np.searchsorted(np.cumsum(self.token_bytes[joined]), np.cumsum(size[plain] + 1), "left") + 1
        count = np.zeros(len(words), np.int64)
        count[plain] = np.diff(place, prepend=0)
        odd = np.flatnonzero(~plain)
        made = [self._segment(" " + w) for w in words.take(pa.array(odd)).to_pylist()]
        if not made:
            return joined, count
        count[odd] = [len(m) for m in made]
        ids, first = np.empty(int(count.sum()), np.uint32), np.cumsum(count) - count
        ids[np.repeat(plain, count)] = joined
        for i, m in zip(first[odd].tolist(), made):
            ids[i : i + len(m)] = m
        return ids, count

    def _remember(self, words: pa.Array, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Add the encoded ``words``; when there are too many, these take the place of all."""
        keep = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONGEST_REMEMBERED
        if len(self.words) + int(keep.sum()) > REMEMBERED:
            self._forget()
        keep &= np.cumsum(keep) <= REMEMBERED
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length[keep]) - length[keep]])
        self.length = np.concatenate([self.length, length[keep]])
        self.pool = np.concatenate([self.pool, _gather(ids, start[keep], length[keep])])
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(keep))])

    def _entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of each of the distinct ``words``, which stand after a space."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(place < 0)
        fresh = words.take(pa.array(new))
        ids, count = self._encoded(fresh)
        own = np.cumsum(count) - count
        start, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        old = place >= 0
        start[old], length[old] = self.start[place[old]], self.length[place[old]]
        start[new], length[new] = len(self.pool) + own, count
        pool = np.concatenate([self.pool, ids])
        self._remember(fresh, own, count, ids)
        return pool, start, length

    def _joined(self, texts: pa.Array, lead: np.ndarray, lengths_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text) of texts whose spaces are all safe; ``lead``: a space stands before the text."""
        parts = pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        edges -= edges[0]
        coded = parts.flatten().dictionary_encode()
        pool, start, length = self._entries(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(~lead)
        heads = [self._segment(x) if x else [] for x in coded.dictionary.take(pa.array(code[edges[first]])).to_pylist()]
        count = np.fromiter(map(len, heads), np.int64, len(heads))
        code[edges[first]] = len(start) + np.arange(len(first))
        start = np.concatenate([start, len(pool) + np.cumsum(count) - count])
        length = np.concatenate([length, count])
        own = length[code]
        sums = np.add.reduceat(own, edges[:-1]) if len(texts) else np.zeros(0, np.int64)
        if lengths_only:
            return np.zeros(0, np.uint32), sums
        pool = np.concatenate([pool, np.fromiter((x for m in heads for x in m), np.uint32, int(count.sum()))])
        return _gather(pool, start[code], own), sums

    def _long(self, text: str, lengths_only: bool) -> tuple[np.ndarray, int]:
        """As ``_joined`` for one long text, a part at a time; parts end before a space."""
        made, n, at = [], 0, 0
        while at < len(text):
            end = text.find(" ", at + PART) if at + PART < len(text) else -1
            end = len(text) if end < 0 else end
            lead = at > 0
            ids, sums = self._joined(pa.array([text[at + lead : end]], pa.string()), np.array([lead]), lengths_only)
            made.append(ids)
            n += int(sums[0])
            at = end
        return np.concatenate(made), n

    def _whole(self, texts: pa.Array, lengths_only: bool) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for m in ids for x in m), np.uint32, int(count.sum())) if not lengths_only else np.zeros(0, np.uint32), count

    def encode_batch(self, texts: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; count of each). A null is an empty text."""
        texts = texts.cast(pa.string()).fill_null("")
        n = len(texts)
        apart = np.full(n, self.ranked is None)
        for s in self.special:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        apart |= pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        # Runs of texts of one kind, whose bytes stay under PART; a longer text is a run of its own.
        kind = np.where(apart, 1, np.where(size > PART, 2, 0))
        made, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(size)
        breaks = np.append(np.flatnonzero(np.diff(kind)) + 1, n)
        while at < n:
            stop = int(breaks[np.searchsorted(breaks, at, "right")])
            stop = max(at + 1, min(stop, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right"))))
            run = texts.slice(at, stop - at)
            if kind[at] == 2:
                ids, count = self._long(run[0].as_py(), lengths_only)
                count = np.array([count], np.int64)
                stop = at + 1
            elif kind[at]:
                ids, count = self._whole(run, lengths_only)
            else:
                ids, count = self._joined(run, np.zeros(len(run), bool), lengths_only)
            made.append(ids)
            counts.append(count)
            at = stop
        return np.concatenate(made), np.concatenate(counts)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()))[0]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
