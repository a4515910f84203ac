"""Byte-level BPE by the tokenizers library, with a cache of words in front of it.

A single space between two characters that are not white space, and a single newline
between two such characters, always start a pre-token of the byte-level pattern, so a
text may be cut there and each piece encoded alone.  A piece that was seen before costs
one dictionary lookup; new ones are encoded by the library, many in one call.
Texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
from tokenizers import Tokenizer

from tidelog.llm.common import cache, claim

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Stands for a piece whose ends are no safe cuts; joining or adding it fails.
BAD = ""
MARKS = (".", ",")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """Pieces of a text with a newline put before it: one for each space or newline, which
    is part of the piece if it is a newline and left out if it is a space."""
    return f"\n{text}".replace("\n", " \n").split(" ")[1:]


def is_bad(piece: str) -> bool:
    """Whether white space meets one of the cuts around a piece."""
    return piece in ("", "\n") or piece[-1].isspace() or piece[piece[0] == "\n"].isspace()


#: Pieces that are kept in each cache.
KEPT = 2_000_000


def cuts_hold(tok: Tokenizer) -> bool:
    """Whether a tokenizer's pre-tokens start at the cuts: the byte-level pre-tokenizer with its own
    pattern, alone, no space put before a text, no normaliser, no truncation or padding."""
    made = json.loads(tok.to_str())
    before = made.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain and (made.get("model") or {}).get("type") == "BPE" and not any(made.get(k) for k in ("normalizer", "truncation", "padding")))


class Bpe:
    """Piece caches over one tokenizer file.

    `limit` bounds the pieces of each cache, of about 200 bytes each; a full one keeps its short
    pieces, or starts anew from `base`, the first tier that it was given.  Pieces are only known to stand
    alone under the byte-level pattern without a normaliser; texts go to any other tokenizer whole."""

    def __init__(self, path: str, limit: int = KEPT):
        self.tok = Tokenizer.from_file(path)
        self.cuts = cuts_hold(self.tok)
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = limit
        self.sizes = np.zeros(max(self.tok.get_vocab().values()) + 1, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.sizes[i] = len(token)  # a byte-level token has one character for each byte
        self.newline = len(self.encode_whole("\n"))
        self.ids: dict[str, bytes | str] = {}
        self.counts: dict[str, int | str] = {}
        self.base: dict[str, int] = {}
        self.odd: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode_pieces(self, new: Iterable[str]) -> dict[str, bytes | str]:
        """Little-endian unsigned 32-bit ids of pieces; BAD for those that can't stand alone.

        Pieces are joined and encoded in one call; the ids are dealt back by the bytes
        that tokens stand for."""
        out: dict[str, bytes | str] = {}
        spaced, lined = [], []
        for p in new:
            if p and p.isprintable():  # no white space but for inner spaces, of which pieces have none
                spaced.append(p)
            elif is_bad(p):
                out[p] = BAD
            elif p[0] == "\n":
                lined.append(p)
            else:
                spaced.append(p)
        for some, glue, mark in ((spaced, " ", 32), (lined, "", 10)):
            for lo in range(0, len(some), 4096):
                part = some[lo : lo + 4096]
                text = glue + glue.join(part)
                data = np.frombuffer(text.encode(), np.uint8)
                ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.append(np.flatnonzero(data == mark)[1:], len(data))
                cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1) * 4
                raw = ids.tobytes()
                out.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist())), strict=True))
        return out

    def _odd(self, text: str) -> bytes:
        """Ids of a text where white space runs: cut at its safe spaces only."""
        cut = SAFE.split(text)
        cut[1:] = [" " + p for p in cut[1:]]
        for p in set(cut).difference(self.odd):
            self.odd[p] = np.array(self.encode_whole(p), np.uint32).tobytes()
        out = b"".join(map(self.odd.__getitem__, cut))
        if len(self.odd) > self.limit:
            self.odd.clear()
        return out

    def _room(self, name: str) -> None:
        """Empties a cache but for its short pieces, or for the base."""
        store = getattr(self, name)
        kept = (self.base if name == "counts" else {}) or {k: v for k, v in store.items() if len(k) < 7}
        store.clear()
        store.update(kept if len(kept) <= self.limit // 2 else {})

    def _made(self, new: set[str], cache: dict, put: Callable) -> dict:
        """Cache entries of new pieces.  A full stop or comma after a Latin letter is a
        pre-token of its own, so the piece is what stands before it, and that mark."""
        marked = {p: p[:-1] for p in new if p.endswith(MARKS) and p[-2:-1].isalpha() and p[-2] < "\u0250"}
        stems = {p for p in marked.values() if p not in cache}
        made = put(self.encode_pieces([*(p for p in new if p not in marked), *stems.difference(new)]))
        tails = put({m: np.array(self.encode_whole(m), np.uint32).tobytes() for m in MARKS})
        for p, stem in marked.items():
            head = made[stem] if stem in stems else cache[stem]
            made[p] = BAD if head is BAD else head + tails[p[-1]]
        return made

    def _all(self, texts: list[str], name: str, put: Callable, join: Callable, else_: Callable) -> list:
        gc.disable()  # lists of millions of texts, and no cycles: collections would only walk them
        try:
            return self._looked_up(texts, getattr(self, name), name, put, join, else_)
        finally:
            gc.enable()

    def _looked_up(self, texts: list[str], cache: dict, name: str, put: Callable, join: Callable, else_: Callable) -> list:
        plain = [bool(t) and self.cuts and not any(s in t for s in self.special) for t in texts]
        cut = [pieces(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        get = cache.get
        found = [list(map(get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {c[i] for c, g in zip(cut, gaps, strict=True) for i in g}
        if new:
            made = self._made(new, cache, put)
            for c, f, g in zip(cut, found, gaps, strict=True):
                for i in g:
                    f[i] = made[c[i]]
            if len(cache) + len(made) > self.limit:
                self._room(name)
            cache.update(made if len(cache) + len(made) <= self.limit else {})
        out = []
        for t, ok, f in zip(texts, plain, found, strict=True):
            try:
                out.append(join(f) if ok else else_(np.array(self.encode_whole(t), np.uint32).tobytes() if t else b""))
            except TypeError:  # a bad piece
                out.append(else_(self._odd(t)))
        return out

    def id_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        skip = 4 * self.newline
        return self._all(texts, "ids", lambda made: made, lambda f: b"".join(f)[skip:], lambda raw: raw)

    def n_tokens(self, texts: list[str]) -> list[int]:
        """Token counts only: lengths are kept instead of ids."""
        return self._all(texts, "counts", lambda made: {p: x if x is BAD else len(x) // 4 for p, x in made.items()}, lambda f: sum(f) - self.newline, lambda raw: len(raw) // 4)


_LOADED: dict[tuple[str, str, int], Bpe] = {}
cache(_LOADED.clear)


def loaded(path: str, tier: str = "", limit: int = KEPT) -> Bpe:
    """A worker's encoder for a tokenizer file and base tier; it keeps one."""
    claim("bpe")
    key = (path, tier, limit)
    if key not in _LOADED:
        _LOADED.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[key] = Bpe(path, limit)
    return _LOADED[key]
