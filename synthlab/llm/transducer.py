"""Byte-level BPE as a deterministic finite-state transducer that counts tokens.

The machine reads one byte at a time.  Its state is all that the future can depend on: the last
token of the encoding of what was read, and for every place where a longer token may have begun,
the node reached in the vocabulary's trie, the token before that place and the tokens saved or lost
against it.  A transition carries the change in the number of tokens, so the count of a chunk is
the sum along its path.  It rests on one property of BPE: a sequence of tokens is the encoding of
its bytes exactly if every two neighbours are, and whether two are follows from the ranks of the
merges along their edges.

States are determinised as texts need them and kept in arrays, up to a bound; a full table is
emptied and built anew, which costs time and changes no count.
"""
from __future__ import annotations

import json

import numpy as np

NONE = -1            # "no token before": the begin of a chunk
ROOT = 0


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of a byte-level BPE file, its trie, and which neighbours are stable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair = (ids[left], ids[right])
            self.rank[pair] = r
            if made.setdefault(ids[left + right], pair) != pair:
                raise ValueError("two merges make one token; the transducer needs one derivation each")
        # edges of a token while it is built: (symbol, rank at which it is merged away)
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        names = {i: t for t, i in ids.items() if t not in self.added}
        usable = set()
        for token in [i for i, t in names.items() if i not in made and len(t) == 1] + sorted(made, key=lambda i: self.rank[made[i]]):
            if token not in made:
                self.right_edge[token] = self.left_edge[token] = [(token, np.inf)]
                usable.add(token)
                continue
            left, right = made[token]
            at = self.rank[left, right]
            self.right_edge[token] = [(token, np.inf), (right, at), *self.right_edge.get(right, [])[1:]]
            self.left_edge[token] = [(token, np.inf), (left, at), *self.left_edge.get(left, [])[1:]]
            if left in usable and right in usable and self._crossing(left, right, (left, right)) is None:
                usable.add(token)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [NONE]
        for token in usable:
            node = ROOT
            for c in names[token]:
                b = alphabet[c]
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(NONE)
                node = self.children[node][b]
            self.token_at[node] = token
        self._stable: dict[tuple[int, int], bool] = {}
        self._below: dict[int, list[int] | None] = {}

    def _crossing(self, left: int, right: int, but: tuple[int, int] | None = None) -> int | None:
        """Rank of a merge across the border of two tokens that BPE makes before both are built."""
        for a, a_gone in self.right_edge[left]:
            for b, b_gone in self.left_edge[right]:
                r = self.rank.get((a, b))
                # of equal merges the leftmost goes first
                if r is not None and r < a_gone and r <= b_gone and (a, b) != but:
                    return r
        return None

    def stable(self, left: int, right: int) -> bool:
        """The two tokens stay side by side in an encoding."""
        if left == NONE:
            return True
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) > 1_000_000:
                self._stable.clear()
            known = self._stable[left, right] = self._crossing(left, right) is None
        return known

    def below(self, node: int, most: int = 24) -> list[int] | None:
        """Tokens strictly below a node of the trie; None if there are more than ``most``."""
        if node not in self._below:
            found: list[int] | None = []
            todo = list(self.children[node].values())
            while todo and found is not None:
                n = todo.pop()
                if self.token_at[n] != NONE:
                    found.append(self.token_at[n])
                    if len(found) > most:
                        found = None
                todo += self.children[n].values()
            self._below[node] = found
        return self._below[node]


class Transducer:
    """Lazily determinised machine over a vocabulary.

    State ``START`` is the begin of a chunk; ``IDLE`` waits for one and emits nothing.  A cell of
    the table holds ``target * 256 + change + 128``, or -1 where it is not filled in yet.  Columns
    are given to bytes as they occur.
    """

    START, IDLE = 0, 1

    def __init__(self, vocabulary: Vocabulary, most_states: int = 150_000):
        self.vocabulary, self.most_states = vocabulary, most_states
        self.column = np.full(256, -1, np.int64)
        self.width = 0
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.table = np.full((4096, max(self.width, 32)), -1, np.int32)
        self._intern((NONE, ()))
        self._intern("idle")
        self.table[self.IDLE] = self.IDLE * 256 + 128

    def _intern(self, key) -> int:
        state = self.index.get(key)
        if state is None:
            state = self.index[key] = len(self.keys)
            self.keys.append(key)
            if state >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return state

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table column of every byte."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = self.width
                self.width += 1
        if self.width > self.table.shape[1]:
            wider = np.full((len(self.table), min(256, max(self.width, 2 * self.table.shape[1]))), -1, np.int32)
            wider[:, :self.table.shape[1]] = self.table
            wider[self.IDLE] = self.IDLE * 256 + 128
            self.table = wider
        self.byte_of = np.argsort(np.where(self.column < 0, 999, self.column))
        return self.column.astype(np.uint8)[data]

    def compact(self, states: np.ndarray) -> np.ndarray:
        """Empty a full table but for the states in use, and return their new numbers."""
        held, place = np.unique(states, return_inverse=True)
        keys = [self.keys[s] for s in held]
        self.reset()
        return np.array([self._intern(k) for k in keys], np.int64)[place]

    def read(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of all lanes: (their new states, changes of their counts)."""
        cells = self.table[states, columns]
        while len(missing := np.flatnonzero(cells < 0)):
            if len(self.keys) > self.most_states:
                states = self.compact(states)
                cells = self.table[states, columns]
                missing = np.flatnonzero(cells < 0)
            for pair in np.unique(states[missing] * 256 + columns[missing]).tolist():
                self._fill(*divmod(pair, 256))
            cells = self.table[states, columns]
        return cells >> 8, (cells & 255) - 128

    def _begun(self, node: int, before: int, saved: int) -> tuple | None:
        """A place where a token may have begun, with the token before it named by what it allows:
        where few tokens lie below the node, the set of those that it can precede."""
        tokens = self.vocabulary.below(node)
        if tokens is None or before == NONE:
            return (node, before, saved) if tokens is None or tokens else None
        allowed = tuple(t for t in tokens if self.vocabulary.stable(before, t))
        return (node, allowed, saved) if allowed else None

    def _allows(self, before, token: int) -> bool:
        return token in before if isinstance(before, tuple) else self.vocabulary.stable(before, token)

    def _fill(self, state: int, column: int) -> None:
        """Determinise one transition."""
        v = self.vocabulary
        last, begun = self.keys[state]
        byte = int(self.byte_of[column])
        reached, token, gain = [], NONE, 0
        for node, before, saved in (*begun, (ROOT, last, 0)):
            child = v.children[node].get(byte)
            if child is None:
                continue
            t = v.token_at[child]
            if t != NONE and self._allows(before, t):
                token, gain = t, saved + 1
            reached.append((child, before, saved))
        if token == NONE:
            raise ValueError("no token ends here; the vocabulary lacks a byte")
        rest = []
        for child, before, saved in reached:
            if isinstance(before, tuple):
                allowed = tuple(t for t in v.below(child) if t in before)
                place = (child, allowed, saved - gain) if allowed else None
            else:
                place = self._begun(child, before, saved - gain)
            if place is not None:
                rest.append(place)
        target = self._intern((token, tuple(rest)))
        self.table[state, column] = target * 256 + gain + 128
