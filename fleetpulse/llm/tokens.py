"""Token ids of many texts at once with a public byte-level BPE vocabulary.

A text is cut into pre-tokens by one numpy pass over its code points (the rule that `public_tokenizers.PATTERN` states);
only pre-tokens that a worker has not met yet are encoded. Texts that hold a special token's string go through the
`tokenizers` library whole.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from fleetpulse.llm import words as W

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
MARK = "\u2581"  # stands for a space in pieces
MAX_CACHED = 500_000

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    # White space of Unicode.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


@lru_cache(1)
def _codes() -> np.ndarray:
    """A 64-bit code of each code point, for hashes of runs."""
    return W.mix(np.arange(1, 0x110001, dtype=np.uint64))


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts that are given as code points."""
    kind = _classes()[points]
    first = np.zeros(points.size + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    # The last white space before other characters is a pre-token's own start; a space character joins what follows.
    after = np.flatnonzero(change[1:] & ~first[1:] & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # 's 't 'd 'm 'll 've 're where an apostrophe begins a pre-token.
    at = np.flatnonzero((points == ord("'")) & start & change)
    at1, at2 = np.minimum(at + 1, points.size - 1), np.minimum(at + 2, points.size - 1)
    one, two = points[at1], points[at2]
    open1 = (at1 > at) & ~first[at1]
    open2 = open1 & (at2 > at1) & ~first[at2]
    short = open1 & np.isin(one, [ord(c) for c in "stdm"])
    long = np.zeros(at.size, bool)
    for a, b in ("ll", "ve", "re"):
        long |= open2 & (one == ord(a)) & (two == ord(b))
    start[at[short | long] + 1] = False
    rest = np.concatenate([at[short] + 2, at[long] + 3])
    start[rest[rest < points.size]] = True
    return np.flatnonzero(start)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a place of each, and which of them stands at each place; hashed, not sorted."""
    found = pa.array(values).dictionary_encode()
    unique, which = found.dictionary.to_numpy(), found.indices.to_numpy()
    sample = np.empty(unique.size, np.int64)
    sample[which] = np.arange(which.size)
    return unique, sample, which


class IdCache:
    """Ids of text runs, kept by their hash until MAX_CACHED are known; `first` are the ids of slot 0.

    Slots stand in a hash table of two numpy arrays, probed place by place and at most half full, so that all runs of a
    chunk are looked up at once.
    """

    def __init__(self, encode, first: list[int]):
        self._encode, self._first = encode, first
        self._clear()

    def _clear(self) -> None:
        self._hash, self._slot = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        # Ids of all known runs one after the other; slot s has _ids[_begin[s] : _begin[s + 1]]. Both have room to grow.
        self._ids, self._begin, self._known = np.array(self._first, np.uint32), np.array([0, len(self._first)]), 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if there is none."""
        last = self._hash.size - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        slots, other = self._slot[at], self._hash[at] != hashes
        look = np.flatnonzero(other & (slots >= 0))
        slots[other] = -1
        at = at[look]
        while look.size:
            at = (at + 1) & last
            found, other = self._slot[at], self._hash[at] != hashes[look]
            slots[look[~other]] = found[~other]
            on = other & (found >= 0)
            look, at = look[on], at[on]
        return slots

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Adds distinct hashes that the table does not have."""
        last = self._hash.size - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        while hashes.size:
            free = np.flatnonzero(self._slot[at] < 0)
            self._slot[at[free]] = slots[free]  # of those that meet in a place one stays
            free = free[self._slot[at[free]] == slots[free]]
            self._hash[at[free]] = hashes[free]
            rest = np.ones(hashes.size, bool)
            rest[free] = False
            hashes, slots, at = hashes[rest], slots[rest], (at[rest] + 1) & last

    def _add(self, hashes: np.ndarray, found: list[list[int]]) -> None:
        """Gives distinct new hashes the next slots, with their ids."""
        old, self._known = self._known, self._known + hashes.size
        ends = self._begin[old] + np.cumsum(np.fromiter(map(len, found), np.int64, hashes.size))
        self._begin, self._ids = _room(self._begin, self._known + 1), _room(self._ids, int(ends[-1]))
        self._ids[self._begin[old] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32)
        self._begin[old + 1 : self._known + 1] = ends
        slots = np.arange(old, self._known, dtype=np.int32)
        if 2 * self._known > self._hash.size:
            used = np.flatnonzero(self._slot >= 0)
            hashes, slots = np.append(self._hash[used], hashes), np.append(self._slot[used], slots)
            size = 1 << (2 * self._known).bit_length()
            self._hash, self._slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self._put(hashes, slots)

    def slots_of(self, hashes: np.ndarray, text, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each run text[begin:end], given with its hash; runs may repeat."""
        if self._known > MAX_CACHED:
            self._clear()
        slots = self._find(hashes)
        new = np.flatnonzero(slots < 0)
        if new.size:
            unique, sample, which = distinct(hashes[new])
            sample = new[sample]
            slots[new] = self._known + which
            self._add(unique, [self._encode(text[a:b]) for a, b in zip(begin[sample].tolist(), end[sample].tolist())])
        return slots

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots one after the other, and where each slot's begin."""
        begin = self._begin[slots]
        size = self._begin[slots + 1] - begin
        position = np.concatenate([[0], np.cumsum(size)])
        return self._ids[np.arange(position[-1]) + np.repeat(begin - position[:-1], size)], position


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """`values`, copied to a quarter more space at least if it has fewer than `size` places."""
    if size <= values.size:
        return values
    out = np.zeros(max(size, values.size + values.size // 4), values.dtype)
    out[: values.size] = values
    return out


class Encoder:
    """Ids of texts in the byte-level vocabulary."""

    def __init__(self, path_of, end_id: int):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path_of(RANKS), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # The library's own vocabulary takes half as much memory again, and few texts need it: it is kept from the first one on.
        self._load_whole = lambda: Tokenizer.from_file(path_of(VOCABULARY))
        self._special = [t.content for t in self._load_whole().get_added_tokens_decoder().values()]
        self._end = end_id
        # Slot 0 ends a text.
        self._cache = IdCache(bpe.encode_ordinary, [end_id])
        self.n_bytes = np.array([len(token) for token, _ in sorted(ranks.items(), key=lambda item: item[1])], np.int64)

    @cached_property
    def _whole(self):
        return self._load_whole()

    def encode(self, texts: pa.Array, specials: bool = True) -> list[np.ndarray]:
        """uint32 ids of each text followed by the end id; null counts as empty.

        Without `specials`, the strings of special tokens are ordinary text.
        """
        out: list[np.ndarray] = []
        for at, end, data, offsets in W.chunks(texts):
            text = data.tobytes().decode("utf-8", "replace")
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            bounds = offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)  # continuation bytes are no code points
            begin = pretoken_starts(points, bounds) if points.size else np.zeros(0, np.int64)
            stop = np.append(begin[1:], points.size)[: begin.size]
            runs = W.RunHashes(_codes()[points])
            slots = self._cache.slots_of(runs.of(begin, stop), text, begin, stop)
            per_text = np.searchsorted(begin, bounds)
            ids, position = self._cache.ids(np.insert(slots, per_text[1:], 0))
            cut = position[per_text[1:] + np.arange(1, per_text.size)]
            rows = np.split(ids, cut[:-1])
            if specials and any(s in text for s in self._special):
                for i in range(end - at):
                    own = text[bounds[i] : bounds[i + 1]]
                    if any(s in own for s in self._special):
                        rows[i] = np.array([*self._whole.encode(own, add_special_tokens=False).ids, self._end], np.uint32)
            out += rows
        return out


class PieceEncoder:
    """Ids of texts in the piece vocabulary, each with a space before it.

    No piece holds a space after another character (checked), so the ids of a text are those of its runs of spaces and
    what follows them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._pieces = pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("pieces that span spaces cannot be encoded by runs")
        self.n_bytes = np.array([1 if pieces.is_byte(i) else len(n.replace(MARK, " ").encode()) for i, n in enumerate(names)], np.int64)
        self._space = pieces.piece_to_id(MARK)
        self._cache = IdCache(self._run, [])

    def _run(self, run: bytes) -> list[int]:
        # The library adds the run's first space itself.
        return self._pieces.encode(run[1:].decode()) if len(run) > 1 else [self._space]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts that begin with a space, one text after the other, and where each text's begin."""
        space = data == ord(" ")
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1]] = True
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], data.size)
        slots = self._cache.slots_of(W.byte_runs(data).of(begin, stop), data.tobytes(), begin, stop)
        ids, position = self._cache.ids(slots)
        return ids, position[np.searchsorted(begin, offsets)]


@lru_cache(2)
def piece_encoder(directory: str | None) -> PieceEncoder:
    return PieceEncoder(_path_of(directory)(PIECES))


@lru_cache(2)
def encoder(directory: str | None, end_id: int) -> Encoder:
    """One encoder per worker process; `directory` holds the vocabulary files, by default those of public_tokenizers."""
    return Encoder(_path_of(directory), end_id)


def forget() -> None:
    """Drops this worker's byte-level encoders and what they know; they are made anew where they are needed again."""
    encoder.cache_clear()
    _codes.cache_clear()


def _path_of(directory: str | None):
    if directory:
        return lambda name: f"{directory}/{name}"
    import public_tokenizers

    return public_tokenizers.path
