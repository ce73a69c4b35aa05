"""Token ids of whole texts with a public tokenizer file, by runs that both kinds of vocabulary file part.

They part words before a blank that stands ahead of another sign, so a text's ids are those of its pieces between blanks
in a row; and in a piece of letters, digits, ASCII marks and single line ends they part the runs of each kind (a blank stays with the
run after it). Runs are found in whole batches of bytes. A worker keeps the ids of runs and of other pieces that it has seen, about
MEMO of them, in arrays that are looked up by a hash and compared by all their bytes. New runs are encoded many to a
string where the tokens themselves tell the runs apart: a vocabulary with blanks in its tokens has one such token for each blank, or one
for each line end put between runs; one with word ends has one for each run of letters or marks and for each digit. Other pieces
are encoded alone, as are all pieces of texts with a blank ahead of white space or the end, or with a special token.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import LOWER, mix

MEMO = 800_000
#: Runs encoded as one string.
JOINED = 512
_PIECE = re.compile(r"(?= \S)")
_BLANK, _LINE, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x20], _KIND[0x0A] = _BLANK, _LINE
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _MARK
_KIND[0x27] = _OTHER  # vocabularies may keep an apostrophe with the letters after it
#: First bytes of what may be white space.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer runs are kept in a dict.
_SHORT = 24
_encoders: dict[str, Encoder] = {}


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte. Letters are those of ASCII and Latin 1, which stay letters when composed and lower-cased."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Runs:
    """Runs and other pieces of texts, in order. `slow` texts have none: they are cut by _PIECE."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, special: list[bytes]):
        kind, n = kinds(data), len(data)
        blank = np.flatnonzero(kind == _BLANK)
        last = np.zeros(n + 1, bool)
        last[bounds[1:] - 1] = True
        loose = blank[_WHITE[data[np.minimum(blank + 1, n - 1)]] | last[blank]]
        self.slow = np.zeros(len(bounds) - 1, bool)
        self.slow[np.searchsorted(bounds, loose, "right") - 1] = True
        raw = data.tobytes()
        for token in special:
            at = raw.find(token)
            while at >= 0:
                self.slow[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        heads = bounds[:-1][np.diff(bounds) > 0]
        heads = heads[kind[heads] != _BLANK]
        begins = np.zeros(n + 1, bool)
        begins[heads] = True
        edge = begins.copy()  # first bytes of texts, and of the text after a last byte
        edge[bounds] = True
        begins[blank + 1] = True
        begins[n] = False
        # a line end beside another one, a blank or the end of a text makes a piece like no run
        line = np.flatnonzero(kind == _LINE)
        dull = lambda at: (kind[at] == _BLANK) | (kind[at] == _LINE)
        odd = edge[line] | edge[line + 1] | dull(np.maximum(line - 1, 0)) | dull(np.minimum(line + 1, n - 1))
        bad = np.concatenate([line[odd], np.flatnonzero(kind == _OTHER)])
        pieces = np.flatnonzero(begins)
        whole = np.zeros(len(pieces), bool)
        whole[np.searchsorted(pieces, bad, "right") - 1] = len(pieces) > 0
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        change = change[kind[change] != _BLANK]
        if whole.any():
            change = change[~whole[np.searchsorted(pieces, change, "right") - 1]]
        after_blank = np.zeros(n + 1, bool)
        after_blank[blank + 1] = True
        begins[change] = True
        self.starts = np.flatnonzero(begins)
        self.blank = after_blank[self.starts] & ~edge[self.starts]
        self.ends = np.append(self.starts[1:] - self.blank[1:], n)
        self.kind = kind[self.starts]
        self.kind[np.searchsorted(self.starts, pieces[whole])] = _OTHER
        keep = ~self.slow[np.searchsorted(bounds, self.starts, "right") - 1]
        if not keep.all():
            self.starts, self.ends, self.blank, self.kind = self.starts[keep], self.ends[keep], self.blank[keep], self.kind[keep]
        #: of each text, the number of its first run; one more than texts
        self.first = np.searchsorted(self.starts, bounds)
        self.raw = raw


class Memo:
    """Entries of up to _SHORT bytes and a flag, found by hash and comparison; the ids of an entry are a part of a pool."""

    def __init__(self):
        self.size, self.used = 0, 0
        self.keys = np.zeros((1 << 16, 4), np.uint64)
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.table = np.full(1 << 18, -1, np.int32)
        self.long: dict[tuple[bytes, bool], int] = {}

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = mix(keys[:, 0])
        for k in range(1, 4):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, k]) if k == 3 else h * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, k] + (h >> np.uint64(29))
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int32)
        slot = (self._hash(keys) & np.uint64(len(self.table) - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            e = self.table[slot[open_]]
            open_, e = open_[e >= 0], e[e >= 0]
            same = (self.keys[e] == keys[open_]).all(axis=1)
            out[open_[same]] = e[same]
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
        return out

    def _seat(self, entries: np.ndarray) -> None:
        slot = (self._hash(self.keys[entries]) & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(entries):
            free = self.table[slot] < 0
            self.table[slot[free]] = entries[free]
            lost = self.table[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def add(self, keys: np.ndarray | None, ids: list[bytes]) -> int:
        """Entries with other keys than all there are (none: they aren't found by key); the number of the first."""
        first, n = self.size, len(ids)
        counts = np.array([len(x) >> 2 for x in ids], np.int32)
        new = np.frombuffer(b"".join(ids), np.uint32)
        grow = lambda v, m: v if len(v) >= m else np.concatenate([v, np.zeros((max(len(v), m - len(v)), *v.shape[1:]), v.dtype)])
        self.keys, self.at, self.count = (grow(v, first + n) for v in (self.keys, self.at, self.count))
        self.pool = grow(self.pool, self.used + len(new))
        self.pool[self.used : self.used + len(new)] = new
        self.count[first : first + n] = counts
        self.at[first : first + n] = self.used + np.cumsum(counts) - counts
        self.size, self.used = first + n, self.used + len(new)
        if keys is None:
            self.keys[first : first + n] = ~np.uint64(0)
            return first
        self.keys[first : first + n] = keys
        if 3 * self.size > len(self.table):
            self.table = np.full(4 * len(self.table), -1, np.int32)
            every = np.arange(self.size, dtype=np.int32)
            self._seat(every[self.keys[: self.size, 3] != ~np.uint64(0)])
        else:
            self._seat(np.arange(first, first + n, dtype=np.int32))
        return first


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # runs of ASCII with a blank stand as they are for byte-level models: only the model has to see them
        made = json.loads(self.tokenizer.to_str())
        self.plain = None
        if made["normalizer"] is None and (made["pre_tokenizer"] or {}).get("type") == "ByteLevel":
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        blank, end = (self.tokenizer.id_to_token(int(self._run([" a"])[0][k])) for k in (0, -1))
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.largest = max(vocabulary.values())
        self.tells, self.line = np.zeros(self.largest + 1, bool), np.zeros(self.largest + 1, bool)
        self.by_blank, self.by_end = blank.startswith("Ġ"), end.endswith("</w>")
        for token, k in vocabulary.items():
            self.tells[k] = token.startswith("Ġ") if self.by_blank else token.endswith("</w>")
            self.line[k] = "Ċ" in token
        self.memo = Memo()

    def _run(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        tokenizer = tokenizer or self.tokenizer
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for e in run(texts, add_special_tokens=False)]

    def _alone(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as it stands."""
        return [ids.tobytes() for i in range(0, len(pieces), 10_000) for ids in self._run(pieces[i : i + 10_000])]

    def _many(self, runs: list[str], before: str) -> list[bytes]:
        """The ids of each run. before: what is put ahead of each, a token of its own or nothing of the run's."""
        out: list[bytes] = []
        for i in range(0, len(runs), JOINED):
            chunk = runs[i : i + JOINED]
            joined = before + before.join(chunk)
            if self.plain and not before and joined.isascii():
                ids = self._run([joined.replace(" ", " Ġ")], self.plain)[0]
            else:
                ids = self._run([joined])[0]
            if self.by_blank:
                at = np.flatnonzero(self.line[ids] if before else self.tells[ids])
                starts, ends = at + len(before), np.append(at[1:], len(ids))
            else:
                at = np.flatnonzero(self.tells[ids])
                last = np.cumsum([len(p) if p.isdigit() else 1 for p in chunk]) - 1
                if len(at) == last[-1] + 1:
                    ends = at[last] + 1
                    at = starts = np.concatenate([[0], ends[:-1]])
            if len(at) == len(chunk):
                raw = ids.tobytes()
                out += [raw[s:e] for s, e in zip((4 * starts).tolist(), (4 * ends).tolist())]
            else:
                out += self._alone(chunk)
        return out

    def _ids(self, texts: list[str], kind: np.ndarray, blank: np.ndarray) -> list[bytes]:
        """The ids of new runs and pieces, given with their blanks."""
        out: list[bytes] = [b""] * len(texts)
        known = self.by_blank or self.by_end
        runs = known & (kind >= _LETTER) & (kind <= _MARK)
        groups = [(~runs, self._alone)]
        if self.by_blank:
            ascii_ = np.array([t.isascii() for t in texts], bool)
            spaced = lambda own: self._many(own, "")
            groups += [(runs & blank & ascii_, spaced), (runs & blank & ~ascii_, spaced), (runs & ~blank, lambda own: self._many(own, "\n"))]
        elif self.by_end:
            groups.append((runs, lambda own: self._many([p.lstrip(" ") for p in own], " ")))
        for mask, how in groups:
            at = np.flatnonzero(mask).tolist()
            for k, ids in zip(at, how([texts[k] for k in at])):
                out[k] = ids
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts as UTF-8 bytes with bounds -> their ids (unsigned 32-bit) in a row, with bounds."""
        if self.memo.size > MEMO:
            self.memo = Memo()
        memo, n = self.memo, len(bounds) - 1
        runs = Runs(data, bounds, self.special)
        starts, sizes = runs.starts, runs.ends - runs.starts
        flag = runs.blank & self.by_blank
        own = data
        if self.by_end:  # such vocabularies are lower case; other pieces stay as they are
            own = LOWER[data]
            for k in np.flatnonzero(runs.kind == _OTHER).tolist():
                own[starts[k] : runs.ends[k]] = data[starts[k] : runs.ends[k]]
        eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([own, np.zeros(8, np.uint8)]), 0, (1,))
        keys = np.zeros((len(starts), 4), np.uint64)
        short = np.flatnonzero(sizes <= _SHORT)
        for k in range(3):
            at = short if k == 0 else short[sizes[short] > 8 * k]
            keys[at, k] = eight[starts[at] + 8 * k] & _MASK[np.minimum(sizes[at] - 8 * k, 8)]
        keys[:, 3] = (sizes * 2 + flag).astype(np.uint64)
        entry = np.empty(len(starts), np.int32)
        entry[short] = memo.find(keys[short])
        raw = own.tobytes()
        text = lambda k: " " * bool(runs.blank[k]) + raw[starts[k] : runs.ends[k]].decode()
        new = short[entry[short] < 0]
        odd = np.flatnonzero(sizes > _SHORT)
        if len(new):
            h = memo._hash(keys[new])
            order = np.argsort(h)
            first = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
            group = np.cumsum(first) - 1
            at = new[order[first]]
            same = (keys[new[order]] == keys[at[group]]).all(axis=1)
            odd = np.concatenate([odd, new[order[~same]]])  # the same hash, but another run
            lowest = memo.add(keys[at], self._ids([text(k) for k in at.tolist()], runs.kind[at], runs.blank[at]))
            entry[new[order]] = lowest + group
        for k in odd.tolist():
            key = (raw[starts[k] : runs.ends[k]], bool(flag[k]))
            if key not in memo.long:
                memo.long[key] = memo.add(None, self._ids([text(k)], runs.kind[k : k + 1], runs.blank[k : k + 1]))
            entry[k] = memo.long[key]
        count = memo.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        flat = memo.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(memo.at[entry] - ends + count, count)]
        at = np.concatenate([[0], ends])[runs.first]
        if not runs.slow.any():
            return flat, at
        parts = []
        for i in range(n):
            if runs.slow[i]:
                parts.append(np.frombuffer(b"".join(self._alone(_PIECE.split(runs.raw[bounds[i] : bounds[i + 1]].decode()))), np.uint32))
            else:
                parts.append(flat[at[i] : at[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str) -> Encoder:
    """One for each file in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
