"""Exact byte-level BPE over memoised chunks of text, and the token counts of all prefixes.

A text falls into chunks at single spaces between two characters that are not white space: the pre-tokenizer always
starts a piece there and looks no further back, so chunks encode independently and their ids or counts concatenate.
Chunks repeat (words do), so each worker keeps a bounded memo of the short ones.

The counts of a text's prefixes are kept as steps: a signed byte for each code point, by how much the count of the prefix
that ends with it differs from the one before. A step is below the longest token's length, so a byte holds it.
"""

from __future__ import annotations

import json
from array import array
from functools import cache
from operator import sub

import numpy as np
import public_tokenizers
import regex
import tiktoken

from sylva.llm.common import Memo

#: Chunks, pieces or pairs that a worker remembers, each kind; chunks and pieces of fewer characters than SHORT, so that
#: their number bounds the bytes.
MEMO, SHORT = 800_000, 64


@cache
def codec(name: str = "byte_bpe_50k.json") -> "Codec":
    return Codec(public_tokenizers.path(name))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _differences(counts: list[int]) -> bytes:
    """Each count less the one before, the first as it is, as signed bytes."""
    return array("b", map(sub, counts, [0, *counts])).tobytes()


class Codec:
    """A byte-level BPE read from a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[bytes, int] = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.tokens = {v: k for k, v in self.vocab.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank[self.vocab[a], self.vocab[b]] = (i, self.vocab[a + b])
        self.byte = [self.vocab[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.vocab, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.longest = max(map(len, self.vocab))
        self.chunk_steps = Memo(self._steps, MEMO)
        # for the prefix programme: bytes that end some token, and which neighbours keep apart
        self.tails = {t[i:]: -1 for t in self.vocab for i in range(len(t))} | self.vocab
        self.apart = Memo(lambda pair: self.merge(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF]) == (pair >> 20, pair & 0xFFFFF), MEMO // 2)
        self.piece_steps = Memo(self._piece, MEMO // 4)
        self.whole = Memo(lambda t: self.merge(t) == (self.vocab[t],), MEMO // 4)

    # ---- encoding

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Apply merges to one piece, lowest rank first."""
        if (known := self.vocab.get(piece)) is not None and len(piece) == 1:
            return (known,)
        ids = [self.byte[b] for b in piece]
        if len(ids) > 256:
            return self._merge_long(ids)
        rank = self.rank
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges with a heap and links, for pieces of any length."""
        import heapq

        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def _parts(self, text: str) -> list[tuple[str, int | None]]:
        """Plain parts (None) and special tokens (their ids)."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(x, self.special.get(x)) for x in self.cut(text) if x]

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit values; the same vocabulary as ranks, by a native encoder."""
        none: set[str] = set()
        return b"".join(np.frombuffer(self.fast(part, none), "u4").astype("<u4").tobytes() if special is None else special.to_bytes(4, "little") for part, special in self._parts(text))

    # ---- the prefix programme

    def prefix_piece(self, piece: bytes) -> list[int]:
        """Exact token counts of every byte prefix of one piece.

        The encoding of a prefix is that of a shorter prefix and one more token: the only token that ends here, whose
        neighbour on its left does not merge with it. So last[i] and count[i] follow from smaller i alone.
        """
        last, count = [-1], [0]
        tail, apart, whole = self.tails.get, self.apart, self.whole
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, max(0, i - self.longest) - 1, -1):
                token = tail(piece[j:i])
                if token is None:
                    token = -1
                    break
                if token >= 0 and (apart[last[j] << 20 | token] if j else whole[piece[:i]]):
                    break
            else:
                token = -1
            if token < 0:  # no neighbour pair holds: encode this prefix as a whole
                ids = self.merge(piece[:i])
                last.append(ids[-1])
                count.append(len(ids))
            else:
                last.append(token)
                count.append(count[j] + 1)
        return count[1:]

    def _piece(self, piece: str) -> bytes:
        """The steps of one piece, a prefix ending within it being a piece as well."""
        counts = self.prefix_piece(piece.encode())
        if len(counts) != len(piece):
            byte, ends = -1, []
            for c in piece:
                byte += len(c.encode())
                ends.append(counts[byte])
            counts = ends
        return _differences(counts)

    def _piece_steps(self, piece: str) -> bytes:
        return self.piece_steps[piece] if len(piece) < SHORT else self._piece(piece)

    def _steps(self, chunk: str) -> bytes:
        """The steps of a chunk, piece by piece.

        Two kinds of piece are cut otherwise while a prefix ends within them. A run of white space is one piece so far; what
        follows it makes its last character part of the next piece, or one of its own. And a contraction is an apostrophe
        and letters until it is complete.
        """
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():  # letters, with at most a space before, are one piece
            return self._piece(chunk)
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return (self.chunk_steps[chunk[:-1]] if len(chunk) < SHORT else self._piece(chunk[:-1])) + b"\1"
        out: list[bytes] = []
        pieces = self.pieces(chunk)
        n = 0
        while n < len(pieces):
            piece = pieces[n]
            n += 1
            if piece.isspace():
                run, last = piece, n
                while last < len(pieces) and pieces[last].isspace():
                    run += pieces[last]
                    last += 1
                after = pieces[last] if last < len(pieces) else ""
                joined = after[:1].isspace()  # the run's last character begins the next piece
                run += after[:1] if joined else ""
                steps = self._piece_steps(run)
                out.append(steps)
                if after:
                    # from the count of the run as one piece to that of the pieces it is cut into
                    held = sum(sum(array("b", self._piece_steps(p))) for p in pieces[n - 1 : last])
                    own = array("b", self._piece_steps(after))
                    change = held - sum(array("b", steps))
                    if joined:
                        change += own.pop(0)
                    own[0] += change
                    out.append(own.tobytes())
                    last += 1
                n = last
            elif piece[0] == "'" and len(piece) > 1 and piece[1:].isalpha():
                counts = [sum(sum(array("b", self._piece_steps(p))) for p in self.pieces(piece[:k])) for k in range(1, len(piece) + 1)]
                out.append(_differences(counts))
            else:
                out.append(self._piece_steps(piece))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The steps of a text without special strings."""
        return b"".join([self.chunk_steps[c] if len(c) < SHORT else self._steps(c) for c in chunks(text)]) if text else b""

    def prefix_steps(self, text: str) -> bytes:
        """The steps of the exact token counts of all prefixes of a text, by code points.

        Special strings count as one token once complete; a prefix that ends inside one counts it as ordinary text.
        """
        parts = self._parts(text)
        if len(parts) == 1 and parts[0][1] is None:
            return self._plain(text)
        out, before = [], ""
        for part, special in parts:
            if special is None:
                out.append(self._plain(part))
                before = part
            else:
                tail = self._open_end(before)
                done = sum(array("b", self._plain(tail)))
                counts = [done, *[sum(array("b", self._plain(tail + part[:k]))) for k in range(1, len(part))], done + 1]
                out.append(array("b", map(sub, counts[1:], counts)).tobytes())
                before = ""
        return b"".join(out)

    def _open_end(self, text: str) -> str:
        """The last pieces of a text, which a special string's beginning may be cut together with; none after a letter or digit."""
        if not text or text[-1].isalnum():
            return ""
        pieces = self.pieces(chunks(text)[-1])
        k = len(pieces) - 1
        while k and pieces[k].isspace() and pieces[k - 1].isspace():
            k -= 1
        return "".join(pieces[k:])

    def count(self, text: str) -> int:
        """The count of the longest prefix."""
        return int(np.frombuffer(self.prefix_steps(text), np.int8).sum(dtype=np.int64))


def chunks(text: str) -> list[str]:
    """Cut before each space that stands between two characters that are not white space."""
    words = text.split(" ")
    if len(words) == 1:
        return words
    if "" not in words and not any(w[0].isspace() or w[-1].isspace() for w in words if w):
        return [words[0], *[" " + w for w in words[1:]]]
    out, held = [], words[0]
    for word in words[1:]:
        if word and not word[0].isspace() and held and not held[-1].isspace():
            out.append(held)
            held = " " + word
        else:
            held += " " + word
    out.append(held)
    return out
