"""Ids of many texts at once: a batch's unseen words are merged together, as rows of one array.

Each row holds a word's symbols and the ranks of its adjacent pairs. A step finds every row's smallest
rank (the leftmost of equals), deletes that boundary and looks the neighbouring ranks up again; rows without a pair leave.
Words of letters that Unicode versions treat alike (below U+0300) are merged this way, all others, long
ones and those that may hold a special token by the tokenizers library, so that ids are the library's.
Two generations of words are remembered: when the younger is full the older one goes, so frequent words stay.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from tallyloom.llm.bpe import PIECES, byte_letters
from tallyloom.llm.common import once_a_worker

#: Words merged together; letters of the longest that are; entries of a generation; bytes of text that are looked up together.
ROWS, LONGEST, YOUNG, TOGETHER = 4096, 40, 300_000, 1 << 23
NO_RANK = np.iinfo(np.int32).max


class Generations:
    """A bounded memory that forgets what was not asked for lately."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def unknown(self, keys) -> list[str]:
        """Keys to be learned; those of the older generation come back to the younger."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        return new


class BatchEncoder:
    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.n_ids = max(ids.values()) + 1
        keys = np.array([ids[a] * self.n_ids + ids[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.inner, self.last = (np.array([ids[c + e] for c in byte_letters()], dtype=np.int32) for e in ("", end))
        self.pieces = regex.compile(PIECES)
        self.chunks, self.words = Generations(YOUNG), Generations(YOUNG)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; an id below 0 pairs with nothing."""
        key = a.astype(np.int64) * self.n_ids + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of about the same length."""
        n, sizes = len(words), np.array([len(w) for w in words])
        wide = int(sizes.max())
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = np.full((n, wide + 1), -1, dtype=np.int32)
        symbols[np.arange(wide + 1) < sizes[:, None]] = self.inner[flat]
        symbols[np.arange(n), sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        ranks, rows = self.ranks(symbols[:, :-1], symbols[:, 1:]), np.arange(n)
        done = np.empty_like(symbols)
        columns = np.arange(wide)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            stop = best == NO_RANK
            if stop.any():
                done[rows[stop]] = symbols[stop]
                rows, symbols, ranks, at, best = rows[~stop], symbols[~stop], ranks[~stop], at[~stop], best[~stop]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            symbols[here, at] = self.merged[best]
            # what follows the deleted boundary moves up
            symbols[:, :-1] = np.take_along_axis(symbols, columns + (columns > at[:, None]), axis=1)
            symbols[:, -1] = -1
            ranks[:, :-1] = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), axis=1)
            ranks[:, -1] = NO_RANK
            before = np.maximum(at - 1, 0)
            ranks[here, before] = np.where(at > 0, self.ranks(symbols[here, before], symbols[here, at]), ranks[here, before])
            ranks[here, at] = self.ranks(symbols[here, at], symbols[here, at + 1])
        left = done >= 0
        content, ends = done[left].astype("<u4").tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
        return [content[a:b] for a, b in zip([0, *ends], ends)]

    def learn_words(self, words: list[str]) -> None:
        short = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        for k in range(0, len(short), ROWS):
            part = short[k : k + ROWS]
            self.words.young.update(zip([w for _, w in part], self.merge([b for b, _ in part])))

    def learn(self, chunks: list[str]) -> None:
        asked, single, split = self.chunks.young, [], []
        for c in chunks:
            if len(c) <= LONGEST and "<|" not in c and (c.isascii() or max(c) < "\u0300"):
                if c.isalpha():
                    single.append(c)
                else:
                    split.append((c, self.pieces.findall(c.lower())))
            else:
                asked[c] = array("I", self.library.encode(c, add_special_tokens=False).ids).tobytes()
        lowered = [c.lower() for c in single]
        wanted = set(lowered)
        for _, found in split:
            wanted.update(found)
        self.learn_words(self.words.unknown(wanted))
        known = self.words.young
        asked.update(zip(single, map(known.__getitem__, lowered)))
        for c, found in split:
            asked[c] = b"".join([known[w] for w in found])  # an empty chunk has none

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow array one after another, and where each text's begin (and the last's end)."""
        import pyarrow.compute as pc

        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = self.chunks.unknown(distinct)
        self.learn(new)
        known = self.chunks.young
        parts = [known[c] for c in distinct]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        ids, starts = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        number = sizes[at]
        ends = np.cumsum(number)
        where = np.repeat(starts[at] - (ends - number), number) + np.arange(ends[-1] if len(ends) else 0)
        first = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))])
        return ids[where], np.concatenate([[0], ends])[first]

    def encode_each(self, texts):
        """Ids of each text of an Arrow array, as little-endian unsigned 32-bit integers; some of the texts at a time."""
        import pyarrow.compute as pc

        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TOGETHER, side="right")))
            ids, first = self.encode(texts.slice(k, end - k))
            content, first = ids.tobytes(), (4 * first).tolist()
            for a, b in zip(first, first[1:]):
                yield content[a:b]
            k = end


@once_a_worker
def batch_encoder(content: str) -> BatchEncoder:
    """One encoder per worker process and vocabulary; its words stay for the worker's next task."""
    return BatchEncoder(content)
