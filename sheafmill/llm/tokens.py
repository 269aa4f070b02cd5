"""Token ids by the tokenizers library, once for each distinct piece of text that a worker meets.

Byte-level pre-tokenizing never joins text across a single space or line feed between two other characters: the space
goes to what follows it, a line feed is a token of its own. A text whose only white space is such single characters is the
run of its pieces' ids, so a worker asks the library for each distinct piece once and gathers the rest from a bounded
cache; Arrow splits a group of texts and numbers its distinct pieces. Punctuation at the end of a word is a token run of its own, so a
word is asked for without it. Any other text (runs of white space, tabs, special tokens: it has a piece with white space inside or an empty one)
goes to the library whole. tests/llm holds both ways equal.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker keeps, about 200 bytes each.
CACHE_PIECES = 1_000_000
#: Characters of texts taken at a time (and always whole texts).
GROUP_CHARS = 2_000_000
#: Never part of a word, a number or a contraction.
PUNCTUATION = ".,;:!?$&%*#)"
_ENCODERS: dict[tuple[str, int], TokenEncoder] = {}


class TokenEncoder:
    """encode(texts) -> one bytes of little-endian unsigned 16-bit (or 32-bit, by vocabulary) ids a text."""

    def __init__(self, path: str, max_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.max_pieces = max_pieces
        self.pieces: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Pieces in groups, a line feed between two. A piece that starts with a line feed stands at a line's start."""
        bare, ended = [], []
        for p in pieces:
            q = p.rstrip(PUNCTUATION)
            if len(q) < len(p) and q[-1:].isalpha():
                ended.append((p, q, p[len(q) :]))
            else:
                bare.append(p)
        asked = list(dict.fromkeys(bare + [q for _, q, _ in ended if q not in self.pieces]))
        groups = [asked[i : i + 512] for i in range(0, len(asked), 512)]
        joined = ["\n".join([p[1:] if p[0] == "\n" else " " + p for p in g]) for g in groups]
        feed, size = self._bytes([self.feed]), self.dtype.itemsize
        for group, found in zip(groups, self._encode(joined), strict=True):
            ids = np.array(found.ids, dtype=self.dtype)
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.feed) * size).tolist()
            begins = [0, *[e + size for e in ends]]
            runs = [raw[b:e] for b, e in zip(begins, [*ends, len(raw)], strict=True)]
            self.pieces.update(zip(group, [feed + r if p[0] == "\n" else r for p, r in zip(group, runs, strict=True)], strict=True))
        for p, q, tail in ended:
            if tail not in self.tails:
                self.tails[tail] = self._bytes(self.tokenizer.encode(tail, add_special_tokens=False).ids)
            self.pieces[p] = self.pieces[q] + self.tails[tail]

    def _encode(self, texts: list[str]) -> list:
        """Encodings; without offsets where the library can leave them out."""
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return batch(texts, add_special_tokens=False)

    @staticmethod
    def _regular(piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return "<|" not in body and body.split() == [body]

    def _odd(self, pieces: set[str]) -> set[str]:
        """Pieces with white space, a special token or nothing in them; one look at all of them where there is none."""
        bodies = [p[1:] if p[:1] == "\n" else p for p in pieces]
        joined = " ".join(bodies)
        if "<|" not in joined and joined.split() == bodies:
            return set()
        return {p for p in pieces if not self._regular(p)}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        held, size = [], 0
        for i, t in enumerate(texts):
            if t and self.feed is None:
                whole.append(i)
            elif t:
                held.append(i)
                size += len(t)
            if held and (size >= GROUP_CHARS or i + 1 == len(texts)):
                whole += self._gather(held, [texts[k] for k in held], out)
                held, size = [], 0
        if held:
            whole += self._gather(held, [texts[k] for k in held], out)
        for at in range(0, len(whole), 64):
            group = whole[at : at + 64]
            for i, e in zip(group, self._encode([texts[i] for i in group]), strict=True):
                out[i] = self._bytes(e.ids)
        return out


    def _gather(self, places: list[int], texts: list[str], out: list[bytes]) -> list[int]:
        """Puts the ids of the texts into ``out``; returns the places of those that have an odd piece."""
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), pa.array(texts, pa.string()), pa.scalar("")), "\n", " \n")
        split = pc.split_pattern(lines, " ")  # an empty piece first, then those of the text
        coded = split.values.dictionary_encode()
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.pieces.get, found))
        new = {p for p, v in zip(found, values, strict=True) if v is None} - {""} if None in values else set()
        odd: set[str] = set()
        if new:
            if len(self.pieces) + len(new) > self.max_pieces:  # a full cache starts anew with this group's pieces
                self.pieces.clear()
                new = set(found) - {""}
            odd = self._odd(new)
            self._learn(list(new - odd))
            values = [self.pieces.get(p) if v is None else v for p, v in zip(found, values, strict=True)]
        values = [v or b"" for v in values]
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        table, starts = np.frombuffer(b"".join(values), dtype=self.dtype), np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        first = split.offsets.to_numpy()
        own = lengths[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        stream = table[np.repeat(starts[at] - ends[:-1], own) + np.arange(ends[-1])]
        strange = (lengths == 0)[at]  # odd or empty pieces
        strange[first[:-1]] = False
        skip = np.add.reduceat(strange, first[:-1], dtype=np.int64) > 0
        bounds = ends[first]
        for k, (i, a, b) in enumerate(zip(places, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if not skip[k]:
                out[i] = stream[a + 1 : b].tobytes()  # without the line feed put before the text
        return [i for i, s in zip(places, skip.tolist(), strict=True) if s]


def encoder(path: str, max_pieces: int = CACHE_PIECES) -> TokenEncoder:
    """The worker's encoder for a tokenizer file; it and its cache last as long as the worker."""
    if (path, max_pieces) not in _ENCODERS:
        _ENCODERS[path, max_pieces] = TokenEncoder(path, max_pieces)
    return _ENCODERS[path, max_pieces]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
