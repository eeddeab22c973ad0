"""Byte-level BPE as finite-state machines that run over many texts at once.

Two deterministic machines are compiled from a public vocabulary file:

* the *splitter* reads character classes and marks where a pre-token starts. Its states are few, so a piece of
  text is a map from entry state to exit state. Such maps compose, and a parallel prefix scan over the pieces
  gives every piece its entry state: all pieces advance together, one column of characters at a time.
* the *merger* reads the bytes of a pre-token. A state holds, for each place where a vocabulary entry may still
  begin, the last token of the only valid tokenisation up to there and its count. Each transition is annotated
  with the tokens that it emits for certain and with the token that ends there. States are built when first met.
  A long pre-token is cut into chunks of bytes. Each chunk has a map from entry state to exit state, filled for the
  entry states that the chunk before may hand on; a prefix scan composes the maps and tells every chunk its entry.

The tokenisation of a prefix is unique because two neighbouring tokens either survive merging as they are or don't.
States live between texts up to KEPT_BYTES; past that the half that was met last stays, and a word that is not at
its end takes its state along.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import alone

#: Character classes: letters outside contractions, e, l, r and v, s t d m, digits, blank, other white space, apostrophe, the rest, end of text.
LETTER, E_, L_, RV, STDM, DIGIT, BLANK, SPACE, QUOTE, OTHER, END, ASK = range(12)
CLASSES = 11
#: States of the splitter: what the last character was part of. The four after QL are white space: one or several so far, the last a blank or not.
FRESH, IN_L, IN_N, IN_O, Q, QRV, QL, ONE_B, ONE_S, MANY_B, MANY_S = range(11)
STATES = 11
#: Pieces of the prefix scan, in characters.
PIECE = 128
#: Bytes of the merger's states and transitions after which the older half goes, and pairs of tokens after which they are built anew.
KEPT_BYTES = 48 << 20
PAIRS_KEPT = 60_000
STATE_BYTES = 160  # of a state besides its key: entries of a list and of a dict, numbers
#: Bytes of words walked between two looks at that size; words of more than CHUNKED bytes are walked as chunks of CHUNK.
PORTION = 1 << 18
CHUNKED, CHUNK = 4096, 256
#: Rounds in which every exit of a chunk is tried as an entry of the next; after that only the true ones are.
ROUNDS = 6
#: Texts are cut, where a pre-token starts for certain, into parts of about this many characters.
PART = 1 << 20
_SURE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
_HASH = np.uint64(0x9E3779B97F4A7C15)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (class, state). Output 1: a pre-token starts here; 2: one starts at the character before."""
    to, out = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)
    letters = (LETTER, E_, L_, RV, STDM)

    def kind(c: int) -> int:
        return IN_L if c in letters else {DIGIT: IN_N, BLANK: ONE_B, SPACE: ONE_S, QUOTE: Q, OTHER: IN_O}[c]

    for c in range(CLASSES):
        for s in range(STATES):
            before = 0
            if s in (QRV, QL):  # an apostrophe and a letter that may open a longer contraction
                if (s, c) in ((QRV, E_), (QL, L_)):
                    to[c, s] = FRESH
                    continue
                before, here = 2, IN_L
            else:
                here = s
            if c == END:
                to[c, s], out[c, s] = FRESH, before
            elif c in (BLANK, SPACE):
                if here in (ONE_B, ONE_S, MANY_B, MANY_S):
                    to[c, s] = MANY_B if c == BLANK else MANY_S
                else:
                    to[c, s], out[c, s] = kind(c), before | 1
            elif here in (ONE_B, MANY_B):  # the blank opens this token
                to[c, s], out[c, s] = (IN_O if c == QUOTE else kind(c)), 2 * (here == MANY_B)
            elif here in (ONE_S, MANY_S):
                to[c, s], out[c, s] = kind(c), 1 | 2 * (here == MANY_S)
            elif here == Q and c in (STDM, RV, L_):
                to[c, s] = {STDM: FRESH, RV: QRV, L_: QL}[c]
            elif here in (Q, IN_O) and c in (QUOTE, OTHER):
                to[c, s] = IN_O
            elif here in (IN_L, IN_N) and kind(c) == here:
                to[c, s], out[c, s] = here, before
            else:
                to[c, s], out[c, s] = kind(c), before | 1
    return to, out


class BpeTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        byte_of = self._bytes()
        as_id = spec["model"]["vocab"]
        vocab = {bytes(byte_of[c] for c in piece): i for piece, i in as_id.items()}
        count = max(vocab.values()) + 1
        self.sizes = np.zeros(count, np.int64)
        self.sizes[list(vocab.values())] = [len(b) for b in vocab]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merge: dict[int, int] = {}
        # what each token is merged from, and the rank of that merge
        self.first, self.second, self.rank = (array("i", [-1]) * count for _ in range(3))
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.merge[as_id[x] << 20 | as_id[y]] = rank
            whole = as_id[x + y]
            if self.rank[whole] < 0:
                self.first[whole], self.second[whole], self.rank[whole] = as_id[x], as_id[y], rank
        self.child: dict[int, int] = {}
        self.token, self.inner = array("i", [-1]), bytearray(1)
        for b, i in vocab.items():
            node = 0
            for x in b:
                key = node << 8 | x
                self.inner[node] = 1
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                node = self.child[key]
            self.token[node] = i
        self.to, self.out = splitter()
        self.classes = self._classes()
        self._fits: dict[int, bool] = {}
        self._reset()

    @staticmethod
    def _bytes() -> dict[str, int]:
        """The printable stand-ins that byte-level vocabularies use: bytes that print stand for themselves, others follow from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    @staticmethod
    def _classes() -> np.ndarray:
        out = np.full(0x110000, OTHER, np.uint8)
        cat = [unicodedata.category(chr(c)) for c in range(0x110000)]
        kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
        out[:] = [ASK if c == "Cn" else kinds.get(c[0], OTHER) for c in cat]
        out[[9, 10, 11, 12, 13, 0x85]] = SPACE
        for chars, c in (("e", E_), ("l", L_), ("rv", RV), ("stdm", STDM), (" ", BLANK), ("'", QUOTE)):
            out[[ord(x) for x in chars]] = c
        return out

    def _ask(self, points: np.ndarray) -> None:
        """Code points newer than Python's tables: the vocabulary's own library tells their class."""
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        for c in points.tolist():
            starts = {span[0] for _, span in split(f"a{chr(c)}1")}
            self.classes[c] = LETTER if 1 not in starts else DIGIT if 2 not in starts else OTHER

    # -- the splitter over many texts

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Flags of the code points at which a pre-token starts; ends: where each text ends."""
        cls = self.classes[points]
        if (cls == ASK).any():
            self._ask(np.unique(points[cls == ASK]))
            cls = self.classes[points]
        tape = np.insert(cls, ends, END)
        n = -(-(len(tape) + 1) // PIECE)
        wide = np.full(n * PIECE, END, np.uint8)
        wide[: len(tape)] = tape
        wide = np.ascontiguousarray(wide.reshape(n, PIECE).T)
        maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (n, STATES))
        flat, step = self.to.ravel(), wide.astype(np.uint16) * STATES
        for col in step:  # every piece from every state, a character at a time
            maps = flat[col[:, None] + maps]
        d = 1
        while d < n:  # inclusive scan: compose with the map of d pieces before
            maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], 1)])
            d *= 2
        state = np.empty(n, np.uint8)
        state[0] = FRESH
        state[1:] = maps[:-1, FRESH]
        outs, flat_out = np.empty((PIECE, n), np.uint8), self.out.ravel()
        for k, col in enumerate(step):
            at = col + state
            outs[k], state = flat_out[at], flat[at]
        marks = outs.T.ravel()[: len(tape)]
        flags = (marks & 1).astype(bool)
        flags[:-1] |= (marks[1:] & 2).astype(bool)
        return flags[tape != END]

    # -- the merger

    def _reset(self) -> None:
        """Only the state in which every word begins, number 0."""
        self.keys: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.final, self.ended, self.last = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.clock, self.bytes_kept = 0, 0
        self._table(1 << 14)
        self._intern(array("Q", [self._live(-1, 0, 0)]).tobytes(), 0, -1)

    def _table(self, size: int) -> None:
        """An empty table of transitions: state and byte, then the next state and the emitted tokens."""
        self.asked, self.given, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        self.shift = np.uint64(64 - size.bit_length() + 1)

    @staticmethod
    def _live(last: int, node: int, n: int) -> int:
        """A place where an entry may still begin: the last token before it (none: 0), the node reached since, tokens up to there."""
        return (last + 1) << 44 | node << 20 | n

    def _intern(self, key: bytes, final: int, ended: int) -> int:
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            if to >= len(self.final):
                self.final, self.ended, self.last = (np.concatenate([x, np.zeros_like(x)]) for x in (self.final, self.ended, self.last))
            self.final[to], self.ended[to], self.last[to] = final, ended, self.clock
            self.bytes_kept += len(key) + STATE_BYTES
        return to

    def _slots(self, asked: np.ndarray) -> np.ndarray:
        """Places of transitions in the table, -1 for those not built yet."""
        mask = len(self.asked) - 1
        slot = (asked.astype(np.uint64) * _HASH >> self.shift).astype(np.int64)
        held = self.asked[slot]
        off = np.flatnonzero(held != asked)
        while off.size:
            none = held[off] < 0
            slot[off[none]] = -1
            off = off[~none]
            slot[off] = (slot[off] + 1) & mask
            held[off] = self.asked[slot[off]]
            off = off[held[off] != asked[off]]
        return slot

    def _put(self, asked: np.ndarray, given: np.ndarray) -> None:
        if 2 * (self.filled + len(asked)) > len(self.asked):
            old = np.flatnonzero(self.asked >= 0)
            kept, size = (self.asked[old], self.given[old]), len(self.asked)
            while 2 * (len(old) + len(asked)) > size:
                size *= 2
            self._table(size)
            self._put(*kept)
        mask, slot = len(self.asked) - 1, (asked.astype(np.uint64) * _HASH >> self.shift).astype(np.int64)
        left = np.arange(len(asked))
        while left.size:
            _, one = np.unique(slot[left], return_index=True)  # one for each place
            one = left[one][self.asked[slot[left[one]]] < 0]
            self.asked[slot[one]], self.given[slot[one]] = asked[one], given[one]
            left = left[self.asked[slot[left]] != asked[left]]
            slot[left] = (slot[left] + 1) & mask
        self.filled += len(asked)

    def _spine(self, t: int, of: array) -> Iterator[tuple[int, float]]:
        """Symbols that stand at one end of t while it forms, with the rank of the merge that takes each in."""
        rank: float = float("inf")
        while t >= 0:
            yield t, rank
            rank, t = self.rank[t], of[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b stays as it is, or some merge across the border comes first (ties go to the left one)."""
        got = self._fits.get(a << 20 | b)
        if got is None:
            got, right = True, list(self._spine(b, self.first))
            for x, xr in self._spine(a, self.second):
                for y, yr in right:
                    m = self.merge.get(x << 20 | y)
                    if m is not None and m < xr and m <= yr:
                        got = False
            if len(self._fits) > PAIRS_KEPT:
                self._fits.clear()
            self._fits[a << 20 | b] = got
        return got

    def _transition(self, state: int, byte: int) -> int:
        """The state that byte leads to and the tokens emitted for certain on the way, as one number."""
        live, ended, at = [], -1, 0
        for packed in array("Q", self.keys[state]):
            last, node, n = (packed >> 44) - 1, packed >> 20 & 0xFFFFFF, packed & 0xFFFFF
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and ended < 0 and (last < 0 or self.fits(last, t)):
                ended, at = t, n + 1
            if self.inner[child]:
                live.append((last, child, n))
        live.append((ended, 0, at))
        base = min(n for _, _, n in live)
        key = array("Q", [self._live(last, node, n - base) for last, node, n in live]).tobytes()
        return self._intern(key, at - base, ended) << 20 | base

    def _run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, trace: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and emitted tokens of each piece data[begin : begin + size]; all advance together, a byte at a time."""
        order = np.argsort(-size, kind="stable")
        begin, left = begin[order], size[order]
        state, total = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
        for k, m in enumerate(active.tolist()):
            at = begin[:m] + k
            asked = state[:m] << 8 | data[at]
            slot = self._slots(asked)
            if (slot < 0).any():
                new = np.unique(asked[slot < 0])
                self._put(new, np.array([self._transition(x >> 8, x & 255) for x in new.tolist()], np.int64))
                slot = self._slots(asked)
            given = self.given[slot]
            total[:m] += given & 0xFFFFF
            state[:m] = given >> 20
            self.last[state[:m]] = self.clock
            if trace is not None:
                trace[at] = self.ended[state[:m]]
        exits, emitted = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        exits[order], emitted[order] = state, total
        return exits, emitted

    def _entries(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, head: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Entry states of chunks. head: the chunk begins a word, or goes on with one, in the state given.

        Chunks of equal bytes share a map. In a round each exit found becomes an entry of the next chunk; the maps
        are composed by a prefix scan until the chain from each head on is known.
        """
        n = len(begin)
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
        same = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode().indices.to_numpy().astype(np.int64)
        known = np.zeros(0, np.int64)  # (chunk's bytes, entry), sorted
        exits = np.zeros(0, np.int64)
        at = np.concatenate([np.arange(n), np.flatnonzero(head)])  # entries asked for, by chunk; state 0 is a first guess
        want = np.concatenate([np.where(head, given, 0), given[head]])
        entry, rounds = np.where(head, given, -1), 0
        asked = np.unique(at << 32 | want)
        while True:
            at, want = asked >> 32, asked & 0xFFFFFFFF
            pairs = np.unique(same[at] << 32 | want, return_index=True)
            new = ~np.isin(pairs[0], known)
            pick = pairs[1][new]
            got, _ = self._run(data, begin[at[pick]], size[at[pick]], want[pick])
            order = np.argsort(np.concatenate([known, pairs[0][new]]), kind="stable")
            known, exits = np.concatenate([known, pairs[0][new]])[order], np.concatenate([exits, got])[order]
            # the domain of each chunk in slots, and where each slot leads in the next chunk's domain
            chunk, state = asked >> 32, asked & 0xFFFFFFFF
            leads = exits[np.searchsorted(known, same[chunk] << 32 | state)]
            first = np.searchsorted(chunk, np.arange(n))
            wide = int(np.diff(np.append(first, len(chunk))).max())
            maps = np.full((n, wide + 1), wide, np.int64)
            goes = np.searchsorted(asked, (chunk + 1) << 32 | leads)
            there = (goes < len(asked)) & (asked[np.minimum(goes, len(asked) - 1)] == ((chunk + 1) << 32 | leads))
            last = np.append(head[1:], True)[chunk]  # the next chunk has its own entry
            slot = np.arange(len(chunk)) - first[chunk]
            maps[chunk, slot] = np.where(there & ~last, goes - first[np.minimum(chunk + 1, n - 1)], wide)
            opens = np.searchsorted(asked, np.arange(n) << 32 | np.where(head, given, 0)) - first
            closes = np.flatnonzero(np.append(head[1:], False))
            maps[closes] = opens[closes + 1][:, None]
            d = 1
            while d < n:
                maps = np.concatenate([maps[:d], np.take_along_axis(np.concatenate([maps[d:], np.full((n - d, 1), wide)], 1), maps[:-d], 1)])[:, : wide + 1]
                d *= 2
            into = np.append(opens[0], maps[:-1, opens[0]])
            sure = into < wide
            entry = np.where(sure, state[np.minimum(first + into, len(state) - 1)], -1)
            if sure.all():
                return entry
            rounds += 1
            if rounds < ROUNDS:
                some = ~last
                fresh = (chunk[some] + 1) << 32 | leads[some]
            else:  # the first chunk of each word whose entry isn't known
                edge = np.flatnonzero(~sure & np.append(False, sure[:-1]))
                before = exits[np.searchsorted(known, same[edge - 1] << 32 | entry[edge - 1])]
                fresh = edge << 32 | before
            asked = np.union1d(asked, fresh)

    def walk(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, trace: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each word data[begin : begin + size].

        trace, as long as data, gets the token that ends at each byte.
        """
        total = np.zeros(len(size), np.int64)
        short = np.flatnonzero(size <= CHUNKED)
        short = short[np.argsort(-size[short], kind="stable")]
        group = np.cumsum(size[short]) // PORTION
        for words in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
            exits, emitted = self._run(data, begin[words], size[words], np.zeros(len(words), np.int64), trace)
            total[words] = emitted + self.final[exits]
            self._bound()
        goes_on = None  # the state of a word that the last portion didn't finish
        portion: list[tuple[int, int, int]] = []
        room = PORTION
        for w in np.flatnonzero(size > CHUNKED).tolist():
            at, stop = int(begin[w]), int(begin[w] + size[w])
            while at < stop:
                n = min(room, stop - at)
                portion.append((w, at, n))
                at, room = at + n, room - n
                if not room:
                    goes_on = self._portion(data, portion, goes_on, stop if at == stop else None, total, trace)
                    portion, room = [], PORTION
        if portion:
            self._portion(data, portion, goes_on, portion[-1][1] + portion[-1][2], total, trace)
        return total

    def _bound(self) -> None:
        """Look at the size after a portion; of too many states the half that was met last stays."""
        self.clock += 1
        if self.bytes_kept + 16 * len(self.asked) <= KEPT_BYTES:
            return
        n = len(self.keys)
        stays = np.zeros(n, bool)
        stays[0] = True
        stays[np.argsort(self.last[:n], kind="stable")[n // 2 :]] = True
        number = np.where(stays, np.cumsum(stays) - 1, -1)
        old = np.flatnonzero(self.asked >= 0)
        asked, given = self.asked[old], self.given[old]
        both = stays[asked >> 8] & stays[given >> 20]
        asked, given = asked[both], given[both]
        self.keys = [self.keys[k] for k in np.flatnonzero(stays).tolist()]
        self.number = {key: k for k, key in enumerate(self.keys)}
        self.bytes_kept = sum(map(len, self.keys)) + STATE_BYTES * len(self.keys)
        self.final, self.ended, self.last = (x[:n][stays] for x in (self.final, self.ended, self.last))
        self._table(1 << 14)
        self._put(number[asked >> 8] << 8 | asked & 255, number[given >> 20] << 20 | given & 0xFFFFF)

    def _portion(self, data: np.ndarray, portion: list[tuple[int, int, int]], goes_on: bytes | None, stop: int | None, total: np.ndarray, trace: np.ndarray | None) -> bytes | None:
        """Walk parts (word, begin, size) of long words as chunks. stop: None if the last word isn't at its end; then its state is given back."""
        word, begin, size, head, given = [], [], [], [], []
        for k, (w, at, n) in enumerate(portion):
            starts = list(range(at, at + n, CHUNK))
            begin += starts
            size += [min(CHUNK, at + n - s) for s in starts]
            word += [w] * len(starts)
            head += [True] + [False] * (len(starts) - 1)
            carried = self.number[goes_on] if k == 0 and goes_on is not None else 0
            given += [carried] * len(starts)
        word, begin, size, given = (np.array(x, np.int64) for x in (word, begin, size, given))
        head = np.array(head)
        entry = self._entries(data, begin, size, head, given)
        exits, emitted = self._run(data, begin, size, entry, trace)
        np.add.at(total, word, emitted)
        ends = np.append(head[1:], stop is not None)
        total[word[ends]] += self.final[exits[ends]]
        rest = None if stop is not None else self.keys[exits[-1]]
        tail = None if rest is None else (int(self.final[exits[-1]]), int(self.ended[exits[-1]]))
        self._bound()
        if rest is not None:
            self._intern(rest, *tail)
        return rest

    def spell(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word, one after the other, and their number."""
        trace = np.full(len(data), -1, np.int32)
        n = self.walk(data, begin, size, trace)
        stop = np.cumsum(n)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        at, left, put = begin + size - 1, n.copy(), stop - 1
        while (go := np.flatnonzero(left)).size:  # back from the end: the last token tells where the one before ends
            at, left, put = at[go], left[go], put[go]
            ids[put] = t = trace[at]
            at, left, put = at - self.sizes[t], left - 1, put - 1
        return ids, n

    # -- whole texts

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens (bytes, begin, size), the number of each occurrence, and how many occurrences each text has."""
        raw = "".join(texts)
        points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.flatnonzero(self.starts(points, ends))
        utf8 = raw.encode()
        if len(utf8) == len(points):
            offsets = np.append(first, len(utf8)).astype(np.int32)
        else:
            offsets = np.append(np.flatnonzero((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)[first], len(utf8)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)])
        coded = words.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        bounds = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[: bounds[-1]] if data else np.zeros(0, np.uint8)
        return data, bounds[:-1], np.diff(bounds), coded.indices.to_numpy(), np.diff(np.searchsorted(first, ends), prepend=0)

    def _parts(self, texts: list[str]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """Texts cut at special strings: the parts, how many each text has, and (part, id) for a special token after that part."""
        parts, sizes, specials = [], [], []
        for t in texts:
            pieces, marks = [t], []
            for s, i in self.special.items():
                if s in t:
                    cut, kept = [], []
                    for k, p in enumerate(pieces):
                        q = p.split(s)
                        cut += q
                        kept += [i] * (len(q) - 1) + marks[k : k + 1]
                    pieces, marks = cut, kept
            specials += [(len(parts) + k, i) for k, i in enumerate(marks)]
            parts += pieces
            sizes.append(len(pieces))
        return parts, sizes, specials

    @staticmethod
    def _blocks(parts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Parts in blocks of about PART characters, with their numbers; a longer part is cut where a pre-token starts for certain."""
        numbers, held, size = [], [], 0
        for k, p in enumerate(parts):
            at = 0
            while at == 0 or at < len(p):
                cut = _SURE.search(p, at + PART) if len(p) - at > PART else None
                end = cut.start() if cut else len(p)
                if held and size + end - at > PART:
                    yield numbers, held
                    numbers, held, size = [], [], 0
                numbers.append(k)
                held.append(p[at:end])
                size += end - at
                if end == len(p):
                    break
                at = end
        if held:
            yield numbers, held

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, sizes, specials = self._parts(texts)
        by_part = np.zeros(len(parts), np.int64)
        for numbers, held in self._blocks(parts):
            data, begin, size, where, per = self._words(held)
            total = np.concatenate([[0], np.cumsum(self.walk(data, begin, size)[where])])
            stop = np.cumsum(per)
            np.add.at(by_part, numbers, total[stop] - total[stop - per])
        for k, _ in specials:
            by_part[k] += 1
        upto = np.concatenate([[0], np.cumsum(by_part)])
        last = np.cumsum(sizes)
        return upto[last] - upto[last - np.array(sizes, np.int64)]

    def id_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        parts, sizes, specials = self._parts(texts)
        of_part: list[list[np.ndarray]] = [[] for _ in parts]
        for numbers, held in self._blocks(parts):
            data, begin, size, where, per = self._words(held)
            flat, n = self.spell(data, begin, size)
            shift = (np.cumsum(n) - n)[where]
            n = n[where]
            stop = np.cumsum(n)
            ids = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(shift - (stop - n), n)]
            bound = np.concatenate([[0], stop])
            last = np.cumsum(per)
            for k, a, b in zip(numbers, bound[last - per].tolist(), bound[last].tolist(), strict=True):
                of_part[k].append(ids[a:b])
        for k, i in specials:
            of_part[k].append(np.array([i], np.int32))
        out, k = [], 0
        for s in sizes:
            pieces = [x for p in of_part[k : k + s] for x in p]
            out.append(pieces[0] if len(pieces) == 1 else np.concatenate(pieces))
            k += s
        return out


def transducer(path: str) -> BpeTransducer:
    """One machine for each worker process; its states stay for later tasks."""
    return alone(("transducer", path), lambda: BpeTransducer(path))
