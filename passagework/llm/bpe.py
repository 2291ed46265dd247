"""Byte-level BPE: encoding by a transducer, decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly when every neighbouring pair is
the encoding of its own bytes. Encoding is therefore regular: read a byte, keep every hypothesis (token
before, position in the token tree), close a token only behind one that it goes with. The
transducer is determinised lazily: a state is a set of hypotheses, built the first time it
is reached, and so are its moves.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from operator import itemgetter
from string import ascii_letters

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import sha

# What a worker remembers, and how much it reads at a time; no bound changes a result.
MOST_STATES = 80_000
MOST_PIECES = 50_000  # in each of two generations
MOST_CHAINS = 10_000
MOST_SINGLE = 50_000
LONGEST_KEPT = 64
LONGEST_LANE = 512
LANES = 1 << 15
ROWS_AT_ONCE = 1000
CHARS_AT_ONCE = 1 << 20
NODE_BITS = 32
NODES = (1 << NODE_BITS) - 1
TOKEN_BITS = 24
LAST_TOKEN = (1 << TOKEN_BITS) - 1
_LAST = itemgetter(-1)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank per line), by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Merges:
    """Plain pair merging by rank, used to decide which tokens go together."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {t: i for i, t in enumerate(tokens)}

    def __call__(self, data: bytes) -> list[int]:
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, data: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]


class Table:
    """Numbers by number, in two arrays with open addressing; gets and puts whole arrays."""

    def __init__(self, size: int = 1 << 12):
        self.count, self.keys, self.values = 0, np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def __len__(self) -> int:
        return self.count

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 where there is none."""
        found, slot = np.full(len(keys), -1, np.int64), self._slots(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not there yet."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            full = self.keys >= 0
            old_keys, old_values = self.keys[full], self.values[full]
            size = 1 << (3 * (self.count + len(keys))).bit_length()
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            self._place(old_keys, old_values)
        self._place(keys, values)
        self.count += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last one stays
            there = self.keys[slot] == keys
            self.values[slot[there]] = values[there]
            keys, values, slot = keys[~there], values[~there], (slot[~there] + 1) & (len(self.keys) - 1)


class Transducer:
    """Deterministic states over sets of hypotheses (token before, node of the token tree).

    A move gives, in one number, the next state and the token that the byte closes behind a token it goes
    with; at most one does. What is closed longer ago than the deepest open hypothesis is
    certain, so tokens are known after a lookahead of one token's length at most, and a
    state with a single hypothesis at the root lets everything before it go.

    Many pieces are read in lockstep, a byte of each at a time; moves that no piece made
    before are determined together. States, moves and pairs are kept as arrays.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.merge = tokens, Merges(tokens)
        child: dict[int, int] = {}  # node << 8 | byte -> node
        ends, inner = [-1], [False]  # the token that ends at a node; whether the tree goes on there
        for rank, token in enumerate(tokens):
            node = 0
            for byte in token:
                step = node << 8 | byte
                if step not in child:
                    child[step] = len(ends)
                    ends.append(-1)
                    inner.append(False)
                    inner[node] = True
                node = child[step]
            ends[node] = rank
        self.child = Table(1 << (2 * len(child)).bit_length())
        self.child.put(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        # One more entry for "no node", which index -1 finds.
        self.ends, self.inner = np.array([*ends, -1], np.int64), np.array([*inner, False])
        self.sizes = np.array([len(token) for token in tokens], np.int64)
        # The token that two tokens merge into, by both.
        ranks, joins = self.merge.ranks, {}
        for rank, token in enumerate(tokens):
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    joins[left << NODE_BITS | right] = rank
        self.joins = Table(1 << (2 * len(joins)).bit_length())
        self.joins.put(np.fromiter(joins, np.int64, len(joins)), np.fromiter(joins.values(), np.int64, len(joins)))
        self.regular = np.full(len(tokens), -2, np.int8)  # -2 for not looked at yet
        widest = int(self.sizes.max(initial=1)) + 1
        self.chain = [np.full((len(tokens), widest), len(tokens), np.int32) for _ in (0, 1)]
        self.chains: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.pairs, self.moves = Table(), Table()
        self.single: dict[int, int] = {}  # moves again, for reading one piece byte by byte
        self.numbers: dict[bytes, int] = {}
        # Hypotheses of all states one after the other, and where each state's begin.
        self.hypotheses, self.first = np.zeros(1 << 10, np.int64), np.zeros(1 << 8, np.int64)
        self.states = 0
        self._add([np.zeros(1, np.int64).tobytes()])

    def _add(self, states: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(states), np.int64)
        n, end = self.states, int(self.first[self.states])
        if n + len(states) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(n + len(states) + 1, np.int64)])
        if end + len(flat) > len(self.hypotheses):
            self.hypotheses = np.concatenate([self.hypotheses, np.zeros(end + len(flat), np.int64)])
        self.hypotheses[end:end + len(flat)] = flat
        self.first[n + 1:n + 1 + len(states)] = end + np.cumsum([len(s) >> 3 for s in states])
        for state in states:
            self.numbers[state] = self.states
            self.states += 1

    def _chains(self, token: int) -> tuple[list[int], list[int], bool | None]:
        """The parts at the left and at the right end of a token, smallest first, as tokens; and
        whether ranks grow with every merge (None when the token doesn't encode to itself)."""
        known = self.chains.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = [token], [token], True
            elif self.merge(data) != [token]:
                known = [token], [token], None
            else:
                left, right = (self.merge.ranks[half] for half in self.merge.halves(data))
                a, b = self._chains(left), self._chains(right)
                grows = all(part < token or len(self.tokens[part]) == 1 for part in (left, right))
                known = [*a[0], token], [*b[1], token], bool(a[2] and b[2] and grows)
            self.chains[token] = known
            for side in (0, 1):
                n = len(known[side])
                self.chain[side][token, :n] = known[side]
                self.chain[side][token, n:] = len(self.tokens)
            self.regular[token] = -1 if known[2] is None else int(known[2])
        return known

    def _follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the right token of each different pair may follow the left one: no merge
        across the border comes before both have grown to their ends."""
        left, right = (pairs >> NODE_BITS) - 1, pairs & NODES
        for token in np.unique(np.concatenate([left, right])).tolist():
            if token >= 0 and self.regular[token] == -2:
                self._chains(token)
        goes = self.regular[right] >= 0
        both = np.flatnonzero(goes & (left >= 0))
        odd = both[(self.regular[left[both]] != 1) | (self.regular[right[both]] != 1)]
        for i in odd.tolist():  # ranks of merges in no order: merge it
            a, b = int(left[i]), int(right[i])
            goes[i] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        open_ = both[(self.regular[left[both]] == 1) & (self.regular[right[both]] == 1)]
        never, (starts, ends) = len(self.tokens), self.chain
        x, y = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        while len(open_):
            # The parts that meet at the border, and the merges that end them.
            a, a_ends = ends[left[open_], x].astype(np.int64), ends[left[open_], x + 1]
            b, b_ends = starts[right[open_], y].astype(np.int64), starts[right[open_], y + 1]
            joint = self.joins.get(a << NODE_BITS | b)
            # Of equal ranks the leftmost merge comes first.
            broken = (joint >= 0) & (joint < a_ends) & (joint <= b_ends)
            goes[open_[broken]] = False
            on = ~broken & ((a_ends < never) | (b_ends < never))
            grow = a_ends <= b_ends
            x, y, open_ = (x + grow)[on], (y + ~grow)[on], open_[on]
        return goes

    def _closing(self, pairs: np.ndarray, owner: np.ndarray, steps: int) -> np.ndarray:
        """For each step the token that it closes, -1 for none: the right one of the pair that goes together."""
        goes = self.pairs.get(pairs)
        unknown = np.flatnonzero(goes < 0)
        if len(unknown):
            new, which = np.unique(pairs[unknown], return_inverse=True)
            answers = self._follow(new).astype(np.int64)
            self.pairs.put(new, answers)
            goes[unknown] = answers[which]
        closed = np.full(steps, -1, np.int64)
        closed[owner[goes > 0]] = pairs[goes > 0] & NODES
        return closed

    def _determine(self, steps: np.ndarray) -> np.ndarray:
        """The moves of different steps (state << 8 | byte) that were not made before; they are kept."""
        state, byte = steps >> 8, steps & 255
        begin = self.first[state]
        counts = self.first[state + 1] - begin
        owner = np.repeat(np.arange(len(steps)), counts)
        own = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        # A hypothesis is the token before, plus one, and the node, in one number.
        hypothesis = self.hypotheses[begin[owner] + own]
        node = hypothesis & NODES
        after = self.child.get(node << 8 | byte[owner])
        token = self.ends[after]
        ending = np.flatnonzero(token >= 0)
        closed = self._closing(hypothesis[ending] - node[ending] + token[ending], owner[ending], len(steps))
        alive = np.flatnonzero(self.inner[after])
        closing = np.flatnonzero(closed >= 0)
        # The hypotheses of each next state: those alive in their order, then the one behind a closed token.
        to = np.concatenate([owner[alive], closing])
        values = np.concatenate([hypothesis[alive] - node[alive] + after[alive], closed[closing] + 1 << NODE_BITS])
        packed = values[np.argsort(to, kind="stable")].tobytes()
        ends = 8 * np.cumsum(np.bincount(to, minlength=len(steps)))
        numbers, fresh, following, at = self.numbers, {}, [], 0
        for end in ends.tolist():
            key = packed[at:end]
            number = numbers.get(key)
            if number is None:
                number = fresh.setdefault(key, self.states + len(fresh))
            following.append(number)
            at = end
        if fresh:
            self._add(list(fresh))
        moves = np.array(following, np.int64) << TOKEN_BITS | closed + 1
        self.moves.put(steps, moves)
        return moves

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece of text, packed as native integers."""
        if self.states > MOST_STATES:
            self.reset()
        if len(self.chains) > MOST_CHAINS:
            self.chains.clear()
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONGEST_LANE).tolist():
            out[i] = np.array(self.encode(pieces[i]), np.intc).tobytes()
        short = np.flatnonzero(sizes <= LONGEST_LANE)
        for begin in range(0, len(short), LANES):
            some = short[begin:begin + LANES]
            some = some[np.argsort(-sizes[some], kind="stable")].tolist()
            for i, tokens in zip(some, self._in_lockstep([pieces[i] for i in some])):
                out[i] = tokens
        return out

    def _in_lockstep(self, pieces: list[bytes]) -> list[bytes]:
        """``encode_all`` of pieces sorted by falling length."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.array([len(piece) for piece in pieces], np.int64)
        begin = np.cumsum(sizes) - sizes
        closed = np.empty(len(data), np.int64)
        state = np.zeros(len(pieces), np.int64)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -at, "left"))  # pieces longer than ``at``
            place = begin[:active] + at
            step = state[:active] << 8 | data[place]
            move = self.moves.get(step)
            new = np.flatnonzero(move < 0)
            if len(new):
                different, which = np.unique(step[new], return_inverse=True)
                move[new] = self._determine(different)[which]
            state[:active] = move >> TOKEN_BITS
            closed[place] = (move & LAST_TOKEN) - 1
        # Follow the closed tokens back from the last byte of each piece.
        lane, end, found = np.flatnonzero(sizes > 0), (begin + sizes)[sizes > 0], []
        while len(lane):
            token = closed[end - 1]
            found.append((lane, token))
            end = end - self.sizes[token]
            on = end > begin[lane]
            lane, end = lane[on], end[on]
        if not found:
            return [b""] * len(pieces)
        owner = np.concatenate([lane for lane, _ in found[::-1]])
        packed = np.concatenate([token for _, token in found[::-1]]).astype(np.intc)[np.argsort(owner, kind="stable")].tobytes()
        ends = (np.intc().itemsize * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one piece of text of any length, emitted while it is read."""
        out: list[int] = []
        closed: list[int] = []
        state, moves = 0, self.single
        if len(moves) > MOST_SINGLE:
            moves.clear()
        for byte in data:
            step = state << 8 | byte
            move = moves.get(step)
            if move is None:
                key = np.array([step], np.int64)
                kept = self.moves.get(key)
                move = moves[step] = int(kept[0] if kept[0] >= 0 else self._determine(key)[0])
            state = move >> TOKEN_BITS
            closed.append((move & LAST_TOKEN) - 1)
            if len(closed) > LONGEST_KEPT and closed[-1] >= 0 and self.first[state + 1] - self.first[state] == 1:
                self._let_go(closed, out)
        self._let_go(closed, out)
        return out

    def _let_go(self, closed: list[int], out: list[int]) -> None:
        """Follow the closed tokens back from the last byte and emit them."""
        at, found = len(closed), []
        while at:
            token = closed[at - 1]
            found.append(token)
            at -= len(self.tokens[token])
        out += found[::-1]
        closed.clear()


class Utf8:
    """Incremental decoder over tokens: the state is the unfinished character's bytes.

    Bytes that can't belong to a character become U+FFFD, one for each maximal prefix.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        alone = [self.step(b"", token) for token in tokens]
        self.whole = [None if rest else text for text, rest in alone]

    @staticmethod
    def step(rest: bytes, data: bytes) -> tuple[str, bytes]:
        """Characters completed by ``data`` after the unfinished ``rest``, and what is unfinished then."""
        out = []
        for byte in data:
            if rest:
                first, low, high = rest[0], 0x80, 0xBF
                if len(rest) == 1:  # no overlong forms, surrogates or code points past the last
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
                if low <= byte <= high:
                    rest += bytes([byte])
                    if len(rest) == (2 if first < 0xE0 else 3 if first < 0xF0 else 4):
                        out.append(rest.decode("utf-8"))
                        rest = b""
                    continue
                out.append("�")
                rest = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                rest = bytes([byte])
            else:
                out.append("�")
        return "".join(out), rest

    def decode(self, ids: list[int]) -> str:
        whole = [self.whole[i] for i in ids]
        if None not in whole:  # every token starts and ends with a character
            return "".join(whole)
        out, rest, moves = [], b"", self.moves
        for token, text in zip(ids, whole):
            if rest or text is None:
                move = moves.get((rest, token))
                if move is None:
                    move = moves[rest, token] = self.step(rest, self.tokens[token])
                text, rest = move
            out.append(text)
        if len(moves) > MOST_PIECES:
            moves.clear()
        return "".join(out) + ("�" if rest else "")


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], names=[*kept, name])


class Pieces(dict):
    """Token ids of the stretches between two spaces, as packed bytes, for a block of texts at a time.

    A space behind a character that isn't white space always starts a match of the usual
    patterns, so a text may be cut there. A stretch stands here with the space before it.
    Where the pattern takes a space and Latin letters as one match and a mark after them as
    another, words need no matching. Stretches met lately are remembered in two generations.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.machine, self.split = Transducer(tokens), regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}
        word = " " + ascii_letters + "\u00e9\u00df\u00f1\u00e7" * 4
        self.plain = self.split(word) == [word]
        self.marks = {mark for mark in ".,;:!?|" if self.split(word + mark) == [word, mark]}

    def _matches(self, stretch: str) -> list[str]:
        """What the pattern makes of a space and a stretch."""
        if self.plain and stretch and max(stretch) < "\u0250":
            if stretch.isalpha():
                return [" " + stretch]
            if stretch[-1] in self.marks and stretch[:-1].isalpha():
                return [" " + stretch[:-1], stretch[-1]]
        return self.split(" " + stretch)

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """A text as its first match-closed part and the stretches behind it, each cut at a space."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and "" not in rest and not any(map(str.isspace, map(_LAST, rest))):
            return first, rest
        out, held = [], first
        for stretch in rest:
            if held and not held[-1].isspace():
                out.append(held)
                held = stretch
            else:  # the next space isn't a place to cut
                held += " " + stretch
        out.append(held)
        return out[0], out[1:]

    def learn(self, stretches: set[str], wholes: set[str]) -> dict[str, bytes]:
        """Remember the ids of stretches; returns those of parts that start a text."""
        again = stretches & self.old.keys()
        for stretch in again:
            self[stretch] = self.old[stretch]
        new = list(stretches - again)
        matches = [*map(self._matches, new), *map(self.split, wholes)]
        ids = self.machine.encode_all([match.encode("utf-8") for row in matches for match in row])
        found, at = [], 0
        for row in matches:
            n = len(row)
            found.append(ids[at] if n == 1 else b"".join(ids[at:at + n]))
            at += n
        self.update(zip(new, found))
        return dict(zip(wholes, found[len(new):]))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of texts."""
        if len(self) > MOST_PIECES:
            self.old = dict(self)
            self.clear()
        cuts = [self._cut(text) if text else ("", []) for text in texts]
        different: set[str] = set()
        for _, rest in cuts:
            different.update(rest)
        wholes = self.learn(different - self.keys(), {first for first, _ in cuts if first})
        out = []
        for first, rest in cuts:
            packed = wholes.get(first, b"") + b"".join(map(self.__getitem__, rest))
            out.append(np.frombuffer(packed, np.intc))
        for stretch in different:
            if len(stretch) > LONGEST_KEPT:
                del self[stretch]
        return out

    def ids(self, text: str) -> np.ndarray:
        """The token ids of one text."""
        return self.block([text])[0]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > CHARS_AT_ONCE:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _encoded(
    batches: Iterator[pa.RecordBatch], tokens: list[bytes], pattern: str, text: str, name: str
) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(tokens, pattern)
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(begin, ROWS_AT_ONCE)
            rows: list[np.ndarray] = []
            collecting = gc.isenabled()
            gc.disable()  # many small objects and no cycles among them
            try:
                for block in _blocks([value.as_py() or "" for value in batch.column(text)]):
                    rows += pieces.block(block)
            finally:
                if collecting:
                    gc.enable()
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))
            yield _with(batch, name, lists)


def _decoded(batches: Iterator[pa.RecordBatch], tokens: list[bytes], ids: str, name: str) -> Iterator[pa.RecordBatch]:
    machine = Utf8(tokens)
    for batch in batches:
        rows = (row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else [] for row in batch.column(ids))
        yield _with(batch, name, pa.array(map(machine.decode, rows), pa.string()))


def encode(df: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add ``name``: the token ids of a text, every match of ``pattern`` encoded by itself.

    A null or empty text has no tokens. Rows are independent: repeated rows, empty tables
    and other columns are kept as they are; a column called ``name`` is replaced. What a
    worker remembers (states, frequent pieces) is bounded and never changes a result.
    ``pattern`` must start a match at every space behind a character that isn't white space.
    """
    sent = df.sparkSession.sparkContext.broadcast(tokens)
    return df.mapInArrow(
        lambda batches: _encoded(batches, sent.value, pattern, text, name), _added(df, name, T.ArrayType(T.IntegerType()))
    )


def decode(df: DataFrame, tokens: list[bytes], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add ``name``: the text of token ids; a null array reads as empty."""
    sent = df.sparkSession.sparkContext.broadcast(tokens)
    return df.mapInArrow(lambda batches: _decoded(batches, sent.value, ids, name), _added(df, name, T.StringType()))


def round_trip(df: DataFrame, tokens: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: (the other columns, ids, decoded)."""
    sent = df.sparkSession.sparkContext.broadcast(tokens)
    kind = _added(df, "ids", T.ArrayType(T.IntegerType()))
    kind = T.StructType([*(f for f in kind.fields if f.name not in (text, "decoded")), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _encoded(batches, sent.value, pattern, text, "ids")
        for batch in _decoded(coded, sent.value, "ids", "decoded"):
            yield batch.select(kind.fieldNames())

    return df.mapInArrow(run, kind)


def digest(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """The contract's columns: encode every text, decode the ids again."""
    done = round_trip(docs.select("doc_id", "text"), tokens, pattern)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )
