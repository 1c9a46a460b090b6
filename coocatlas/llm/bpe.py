"""Byte-level BPE ids of whole batches of texts.

The pre-tokenizer's pattern is applied to a batch as array operations on code points, and
only the distinct pieces of the batch go through the BPE merges. Texts with characters whose
class may differ between Unicode versions, or with a special token's string, are encoded by
the tokenizer library itself.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from coocatlas.llm.tables import single_threaded
from coocatlas.llm.words import span_hash

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)

# Code points with the Unicode White_Space property.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    """Class of each code point below U+30000; unassigned ones, and all above, are UNSURE."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x3000)),
        np.uint8, 0x3000)
    out = np.full(0x110000, UNSURE, np.uint8)
    out[:0x3000] = table
    out[0x3400:0x4DB6] = out[0x4E00:0x9FA6] = out[0xAC00:0xD7A4] = LETTER
    out[list(WHITE)] = SPACE
    return out


class BatchEncoder:
    """``encode`` gives the ids of an Arrow array of texts and how many belong to each."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        single_threaded()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.classes = _classes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        strings = ["" if t is None else t for t in texts.to_pylist()]
        joined = "".join(strings)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths)
        kind = self.classes[points]
        own = set()
        if (unsure := np.flatnonzero(kind == UNSURE)).size:
            own.update(np.searchsorted(ends, np.unique(unsure), side="right").tolist())
        for token in self.special:
            if token in joined:
                own.update(i for i, s in enumerate(strings) if token in s)
        ids, counts = self._pieces(joined, points, kind, ends, lengths)
        if not own:
            return ids, counts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        parts = []
        for i in range(len(strings)):
            if i in own:
                part = np.array(self.tokenizer.encode(strings[i], add_special_tokens=False).ids, np.uint32)
                counts[i] = len(part)
            else:
                part = ids[bounds[i]:bounds[i + 1]]
            parts.append(part)
        return np.concatenate(parts), counts

    def _pieces(self, joined, points, kind, ends, lengths):
        start, stop = piece_spans(points, kind, ends[lengths > 0])
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        _, at, which = np.unique(span_hash(points, start, stop), return_index=True, return_inverse=True)
        single, merge, ranks = [], self.merge.encode_single_piece, self.ranks
        for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True):
            piece = joined[a:b].encode()
            known = ranks.get(piece)
            single.append(merge(piece) if known is None else (known,))
        sizes = np.fromiter(map(len, single), np.int64, len(single))
        flat = np.fromiter((i for ids in single for i in ids), np.uint32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        taken = sizes[which]
        total = np.cumsum(taken)
        ids = flat[np.repeat(first[which] - (total - taken), taken) + np.arange(total[-1])]
        done = np.concatenate([[0], total])
        upto = done[np.searchsorted(start, ends)]
        return ids, np.diff(upto, prepend=0)


def piece_spans(points: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of the byte-level pattern; ``ends`` closes each non-empty text.

    A piece is a run of one class, led by a space if one stands before it. White space
    before a run keeps its last character for that run or alone. The contractions after a
    letter or number are pieces of their own.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(n + 1, bool)
    head[0] = True
    head[ends] = True
    run = head.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run[:n])
    after = np.append(at[1:], n)
    blank = kind[at] == SPACE
    opens = np.zeros(n + 1, bool)
    opens[at[blank]] = True
    followed = blank & ~head[after]
    opens[after[followed] - 1] = True
    word = at[~blank]
    led = (word > 0) & ~head[word] & (points[word - 1] == 0x20)
    opens[word[~led]] = True
    _contractions(points, kind, head, opens, at, after)
    start = np.flatnonzero(opens[:n])
    return start, np.append(start[1:], n)


def _contractions(points, kind, head, opens, at, after) -> None:
    quote = at[(points[at] == 0x27) & (after - at == 1) & opens[at]]
    n = len(points)
    quote = quote[(quote + 1 < n) & ~head[np.minimum(quote + 1, n)]]
    quote = quote[kind[quote + 1] == LETTER]
    second = points[quote + 1]
    more = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)]
    third = np.where(more, points[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(second, [ord(c) for c in "stmd"])
    long = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e")))
    long |= (second == ord("l")) & (third == ord("l"))
    for chosen, size in ((short, 2), (long, 3)):
        begin = quote[chosen]
        opens[begin + 1] = False
        rest = begin + size
        rest = rest[(rest < n) & ~head[np.minimum(rest, n)]]
        opens[rest[kind[rest] == LETTER]] = True
