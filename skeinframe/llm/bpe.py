"""Batch encoding with a byte-level BPE of the tokenizers library.

Byte-level BPE encodes each pre-token alone, so a text's ids are its pre-tokens'
ids in turn. The pre-tokens are found with numpy over a whole batch, and only
those not met before in this process go to the library. Texts that hold an added
token (such as `<|endoftext|>`) go to it whole. tests/llm compares the ids with the
library's own for whole texts.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from skeinframe.llm._common import Spans, mix, text_chunks

VOCAB = "byte_bpe_50k.json"
#: Distinct pre-tokens kept per process; the table starts anew when full.
CACHED = 700_000
#: Bytes of text worked on at a time.
CHUNK = 1 << 20
#: Characters of a run beyond which a text goes to the library as it is (a run's hash and cache entry would be large).
LONG_RUN = 4_000
#: Code points of the White_Space property.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)

_loaded: dict[str, BatchBpe] = {}


def vocab_path(vocab: str) -> str:
    """vocab itself if it is a path, else the public tokenizer file of that name."""
    if os.sep in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def load(vocab: str = VOCAB) -> BatchBpe:
    if vocab not in _loaded:
        _loaded[vocab] = BatchBpe(vocab_path(vocab))
    return _loaded[vocab]


def classes() -> np.ndarray:
    """Per code point: LETTER, NUMBER, SPACE, OTHER, or UNKNOWN if Python's Unicode tables lack it; the library's may be newer."""
    kinds = {"L": LETTER, "N": NUMBER}
    whole = {"Cn": UNKNOWN}
    out = np.fromiter((whole.get(c) or kinds.get(c[0], OTHER) for c in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    out[SPACES] = SPACE
    return out


class BatchBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these go to the library as they are: it cuts them out before it looks for pre-tokens.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = classes()
        self.clear()

    def clear(self) -> None:
        """Known hashes in order with their slots; a slot says where its ids begin in flat and how many they are."""
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def learn(self, tokens: list[str]) -> np.ndarray:
        """New slots for the tokens."""
        parts = [e.ids for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]
        count = np.fromiter(map(len, parts), np.int32, len(parts))
        upto, first = self.used + int(count.sum()), len(self.known)
        self.flat, self.begin, self.count = self._room(self.flat, upto), self._room(self.begin, first + len(parts)), self._room(self.count, first + len(parts))
        self.flat[self.used : upto] = np.fromiter(chain.from_iterable(parts), np.uint32, upto - self.used)
        slots = np.arange(first, first + len(parts), dtype=np.int32)
        self.count[slots] = count
        self.begin[slots] = self.used + np.cumsum(count) - count
        self.used = upto
        return slots

    def slots(self, hashes: np.ndarray, token) -> np.ndarray:
        """Slots of distinct hashes; token(i) gives the text of those that aren't known yet."""
        order = np.argsort(hashes)
        ordered = hashes[order]
        at = np.searchsorted(self.known, ordered)
        place = np.minimum(at, max(len(self.known) - 1, 0))
        known = self.known[place] == ordered if len(self.known) else np.zeros(len(ordered), bool)
        out = np.zeros(len(hashes), np.int32)
        out[order[known]] = self.slot[place[known]]
        lacking = ~known
        if lacking.any():
            new = self.learn([token(i) for i in order[lacking].tolist()])
            out[order[lacking]] = new
            self.known = np.insert(self.known, at[lacking], ordered[lacking])
            self.slot = np.insert(self.slot, at[lacking], new)
        return out

    def token_starts(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; each ends where the next begins."""
        n = len(cp)
        kind = self.kinds[cp]
        new = np.zeros(n + 1, bool)
        new[off] = True
        run = new.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        run[0], run[n] = True, True
        edge = np.flatnonzero(run)
        start, end = edge[:-1], edge[1:]
        space = kind[start] == SPACE
        final = new[end]  # the text ends with this run
        blank = cp[end - 1] == 0x20
        joins = np.zeros(len(start), bool)  # a blank before it belongs to it
        joins[1:] = (space & blank & ~final)[:-1]
        out = np.zeros(n + 1, bool)
        out[(start - joins)[~space]] = True
        out[start[space & ~((end - start == 1) & blank & ~final)]] = True
        out[(end - 1)[space & ~final & ~blank]] = True
        # contractions: a lone apostrophe before letters
        at = start[(kind[start] == OTHER) & (end - start == 1) & (cp[start] == 0x27) & ~joins & ~final]
        if len(at):
            at = at[kind[at + 1] == LETTER]
            one, two = cp[at + 1], cp[np.minimum(at + 2, n - 1)]
            inside = (at + 2 < n) & ~new[np.minimum(at + 2, n)]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            pair = inside & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            size = np.where(pair, 2, size)
            at, size = at[size > 0], size[size > 0]
            out[at + 1] = False
            after = at + 1 + size
            more = (after < n) & ~new[after]
            after = after[more]
            out[after[kind[after] == LETTER]] = True
        return np.flatnonzero(out[:n])

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def chunk(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in turn, and per text the number of ids."""
        text = buf.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        bytes_off, off = off, chars[off]
        starts = self.token_starts(cp, off)
        ends = np.append(starts[1:], len(cp))
        odd = np.zeros(len(off) - 1, bool)  # texts for the library
        if (ends - starts).max() > LONG_RUN:
            odd[np.searchsorted(off, starts[ends - starts > LONG_RUN], "right") - 1] = True
        if (unknown := self.kinds[cp] == UNKNOWN).any():
            odd[np.searchsorted(off, np.flatnonzero(unknown), "right") - 1] = True
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                odd[np.searchsorted(off, at, "right") - 1] = True
                at = text.find(token, at + 1)
        if odd.any():
            parts, counts, edge = [], [], np.flatnonzero(np.diff(odd)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(odd)], strict=True):
                if odd[i]:
                    alone = [self.plain(text[off[k] : off[k + 1]]) for k in range(i, j)]
                    parts += alone
                    counts.append(np.array([len(p) for p in alone], np.int64))
                else:
                    sub = np.frombuffer(text[off[i] : off[j]].encode(), np.uint8)
                    ids, n = self.chunk(sub, bytes_off[i : j + 1] - bytes_off[i])
                    parts.append(ids)
                    counts.append(n)
            return np.concatenate(parts), np.concatenate(counts)
        hashes = Spans(mix(cp.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))).hash(starts, ends)
        codes, distinct = pd.factorize(hashes)
        if len(self.known) + len(distinct) > CACHED:
            self.clear()
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        token = self.slots(distinct, lambda i: text[starts[first[i]] : ends[first[i]]])[codes]
        size = self.count[token]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.flat[np.repeat(self.begin[token] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, off)])

    def column(self, column: pa.Array):
        """(first row, end row, ids, ids per text) of runs of rows."""
        for i, j, buf, off in text_chunks(column, CHUNK):
            yield i, j, *self.chunk(buf, off)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text, and the offsets of the texts (one longer than the texts)."""
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=off[1:])
    out = np.full(off[-1], end_id, np.uint32)
    keep = np.ones(off[-1], bool)
    keep[off[1:] - 1] = False
    out[keep] = ids
    return out, off
