"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the tokenizer's own splitting rule knows it.
_WHITE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = set("\t\n\v\f\r \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
#: A run of other characters with one white-space character before it, or white space that none follows.
_PIECE = re.compile(f"[{_WHITE}]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])")
#: A space, letters that all versions of Unicode know as such, and a mark: by the splitting rule two words, the letters with their space and the mark.
_MARKED = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+[.,!?;:]")
#: Pieces the cache may hold, with 16 ids each; when full it keeps those used most, which costs time and changes no id.
CACHE = 1_500_000


class _Pieces(dict):
    """Piece -> number; pieces met for the first time are listed in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids of texts for one tokenizer file (*path*; None: the public byte-level BPE of 50,257 ids).

    A byte-level BPE splits a text by a rule that never joins across white space but for one
    character before a word.  So a text is encoded piece by piece, and every distinct piece
    once; other kinds of tokenizer get whole texts, and so does a text that holds the string of an added token.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in state.get("added_tokens") or ()]
        self.by_piece = (state.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not state["model"].get("ignore_merges")
                         and not any(_SPACES & set(a) for a in self.added))  # joined words could make such a token
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # a byte-level token has one character for each byte
        self._start_anew()

    def _start_anew(self) -> None:
        self.pieces, self.pool = _Pieces(), np.zeros(1 << 20, np.uint32)
        self.starts, self.counts, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.uses = np.zeros(0, np.int32)

    def _forget(self, most: int) -> None:
        """Keep fewer than *most* pieces: those used most, of late above all."""
        uses = self.uses
        kept = np.flatnonzero(uses > max(1, np.partition(uses, -most)[-most])) if len(uses) > most else np.zeros(0, np.int64)
        names, starts, counts = list(self.pieces), self.starts[kept], self.counts[kept]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())]
        self._start_anew()
        self.pieces.update((names[k], i) for i, k in enumerate(kept.tolist()))
        self._hold(ids)
        self.starts, self.counts, self.uses = ends - counts, counts, uses[kept] >> 1

    def _hold(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        fresh = self.pieces.fresh
        if not fresh:
            return
        # a word with a mark is made of both; those met for the first time join the fresh ones
        marked = [k for k, p in enumerate(fresh) if _MARKED.fullmatch(p)]
        halves = np.array([(self.pieces[fresh[k][:-1]], self.pieces[fresh[k][-1]]) for k in marked], np.int64).reshape(-1, 2)
        self.pieces.fresh = []
        joined = np.fromiter((len(p) > 1 and p[0] in _SPACES and p[1] not in _SPACES for p in fresh), bool, len(fresh))
        joined[marked] = False
        alone = ~joined
        alone[marked] = False
        counts = np.zeros(len(fresh), np.int64)
        ids, counts[joined] = self._ids_of_words([fresh[k] for k in np.flatnonzero(joined)])
        rest, counts[alone] = self._whole([fresh[k] for k in np.flatnonzero(alone)])
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(alone)])
        starts = np.zeros(len(fresh), np.int64)
        starts[order] = self.used + np.cumsum(counts[order]) - counts[order]
        self._hold(np.concatenate([ids, rest]))
        starts, counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        sizes, firsts = counts[halves], starts[halves]
        of = len(self.starts) + np.array(marked, np.int64)
        counts[of] = sizes.sum(axis=1)
        starts[of] = self.used + np.cumsum(counts[of]) - counts[of]
        sizes, firsts = sizes.ravel(), firsts.ravel()
        ends = np.cumsum(sizes)
        self._hold(self.pool[np.repeat(firsts - (ends - sizes), sizes) + np.arange(sizes.sum())])
        self.starts, self.counts = starts, counts
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words that begin with one white-space character: such words can
        stand in one text without touching each other, and the ids' bytes tell where each one ends."""
        texts = ["".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        return flat, np.diff(np.searchsorted(np.cumsum(self.bytes_of[flat]), ends, "right"), prepend=0)

    def encode(self, texts: list[str], cache: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) one after another, and their number in each text. *cache*: pieces to hold, None: ``CACHE``."""
        if not self.by_piece:
            return self._whole(texts)
        whole = np.fromiter((any(a in t for a in self.added) for t in texts), bool, len(texts))
        if not whole.any():
            return self._by_piece(texts, cache)
        counts, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        cuts = [0, *(np.flatnonzero(whole[1:] != whole[:-1]) + 1).tolist(), len(texts)]
        for first, last in zip(cuts, cuts[1:]):
            flat, counts[first:last] = self._whole(texts[first:last]) if whole[first] else self._by_piece(texts[first:last], cache)
            parts.append(flat)
        return np.concatenate(parts), counts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _by_piece(self, texts: list[str], cache: int | None) -> tuple[np.ndarray, np.ndarray]:
        cache = cache or CACHE
        if len(self.pieces) > cache or self.used > 16 * cache:
            self._forget(max(1, cache // 4))
        found = [_PIECE.findall(t) for t in texts]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        number = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), np.int64, int(per_text.sum()))
        self._learn()
        self.uses += np.bincount(number, minlength=len(self.uses)).astype(np.int32)
        sizes = self.counts[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.starts[number] - (ends - sizes), sizes) + np.arange(total)]
        marks = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return flat, np.diff(marks)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def groups_of_texts(column: pa.Array, most_chars: int = 1 << 20):
    """(first, last, texts) of runs of texts with about *most_chars* characters; just these are Python strings."""
    first, held = 0, 0
    for i, size in enumerate(pc.utf8_length(column).to_pylist()):
        held += size
        if held >= most_chars or i + 1 == len(column):
            yield first, i + 1, column.slice(first, i + 1 - first).to_pylist()
            first, held = i + 1, 0
