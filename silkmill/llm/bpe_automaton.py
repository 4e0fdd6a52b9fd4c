"""BPE as a deterministic automaton over tokens, compiled into a transition table.

Start: one state, every base unit loops.  The merges then add one gadget each, in order:
after ``u`` the arc ``v`` is cut, and a new arc ``uv`` runs beside it.  The state behind
``uv`` is a copy of the one behind ``v`` as it is at that moment (it inherits the cuts made
so far), and ``uv`` leaves every state that ``u`` leaves at that moment.  A state is thus
known by the token that leads to it.

Copies form two forests: of states (a token below its right part) and of arcs (a token below
its left part).  Numbered from the top, the youngest copies first, the states that a cut
reaches are one run of numbers, and so are the arcs: a gadget closes a rectangle of the
table.  States with equal rows are one state in the end, arcs with equal columns one class.

Every prefix of a word has exactly one path.  Encoding finds the one arc by which a prefix is
reached; the path is then read from the end.  The arc depends on the prefix alone, so short words
ask only for the prefixes that their ends need, and share what was found for them; in long words
all prefixes are gone through from left to right.
"""

from __future__ import annotations

import json

import numpy as np

#: Letters of a short word.
SHORT = 64
#: Beginnings of short words whose last arc is kept (some 200 bytes each); a full table starts anew.
PLACES = 60_000


class _Forest:
    """Tokens below the part they copy, numbered from the top with the youngest copies first."""

    def __init__(self, size: int, made: dict[int, tuple[int, int, int]], side: int):
        self.copies: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for token, parts in made.items():  # in order of time
            self.copies[parts[side]].append((parts[2], token))
        self.number, self.end, count = [0] * size, [0] * size, 0
        stack = [(token, False) for token in range(size - 1, -1, -1) if token not in made]
        while stack:
            token, done = stack.pop()
            if done:
                self.end[token] = count
                continue
            self.number[token] = count
            count += 1
            stack.append((token, True))
            stack += [(below, False) for _, below in self.copies[token]]

    def run(self, token: int, since: int) -> tuple[int, int]:
        """Numbers of the token and of all that copies it from time ``since`` on."""
        begin = self.number[token]
        late = next((below for time, below in self.copies[token] if time >= since), None)
        return begin, begin + 1 if late is None else self.end[late]


def _reachable(merges: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Merged token to its parts and time, less merges whose parts never meet."""
    made: dict[int, tuple[int, int, int]] = {}
    cut: dict[tuple[int, int], int] = {}

    def edge(token: int, side: int) -> list[tuple[int, int, int]]:
        out, until = [], len(merges)
        while token in made:
            out.append((token, made[token][2], until))
            until, token = made[token][2], made[token][side]
        return [*out, (token, -1, until)]

    dead = set()
    for time, (u, v, merged) in enumerate(merges):
        if merged in made:
            raise ValueError("a token is the result of two merges")
        met = not {u, v} & dead and not any(
            a_from < cut.get((a, b), -1) < a_until and b_from < cut[a, b] <= b_until
            for a, a_from, a_until in edge(u, 1) for b, b_from, b_until in edge(v, 0)
        )
        if met:
            cut[u, v], made[merged] = time, (u, v, time)
        else:
            dead.add(merged)
    return made


class MergeAutomaton:
    """The compiled automaton; its size is bounded by the vocabulary's, so it may be broadcast."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>"):
        units = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        made = _reachable(units)
        self._compile(max(vocab.values(), default=-1) + 1, made)
        made_by_merge = {x for *_, x in units}
        live = {x: i for x, i in vocab.items() if i in made or i not in made_by_merge}
        #: Ends of arc labels, inside a word and at its end: the arc's number, or -1 for an end alone.
        self.inner = self._ends({x: i for x, i in live.items() if not x.endswith(suffix)})
        self.final = self._ends({x.removesuffix(suffix): i for x, i in live.items() if x.endswith(suffix)})
        #: Beginnings of words with the arc that reaches their end, and from where.
        self.places: dict[str, tuple[int, int]] = {}

    @staticmethod
    def _ends(labels: dict[str, int]) -> dict[str, int]:
        out = {x[k:]: -1 for x in labels for k in range(1, len(x))}
        return out | labels

    def _compile(self, size: int, made: dict[int, tuple[int, int, int]]) -> None:
        states, arcs = _Forest(size, made, 1), _Forest(size, made, 0)
        # The new token itself takes the cut arc along (if u = v), but not the state's cut.
        closed = [(*states.run(u, time + 1), *arcs.run(v, time)) for u, v, time in made.values()]
        box = np.array(closed, np.int64).reshape(-1, 4)
        rows, columns = (np.unique(np.concatenate([[0], box[:, k], box[:, k + 1]])) for k in (0, 2))
        change = np.searchsorted(rows, box[:, :2]), np.searchsorted(columns, box[:, 2:])
        begin, end = (np.argsort(change[0][:, k], kind="stable") for k in (0, 1))
        at = [np.searchsorted(change[0][order, k], np.arange(len(rows) + 1)) for k, order in ((0, begin), (1, end))]
        depth = np.zeros(len(columns) + 1, np.int32)
        found: dict[bytes, int] = {}
        state_of_run = []
        for r in range(len(rows)):
            for order, cuts, sign in ((begin, at[0], 1), (end, at[1], -1)):
                for k in order[cuts[r] : cuts[r + 1]]:
                    depth[change[1][k, 0]] += sign
                    depth[change[1][k, 1]] -= sign
            row = np.packbits(np.cumsum(depth[:-1]) == 0, bitorder="little").tobytes()
            state_of_run.append(found.setdefault(row, len(found)))
        width = len(next(iter(found)))
        #: One bit for each state and class of arcs: is the arc there?
        self.table = b"".join(found)
        run = np.searchsorted(rows, np.array(states.number, np.int64), "right") - 1
        #: Where the row of the state behind a token begins, and a token's class as an arc.
        self.row = (np.array(state_of_run, np.int64)[run] * width).tolist() if size else []
        self.column = (np.searchsorted(columns, np.array(arcs.number, np.int64), "right") - 1).tolist() if size else []

    def is_open(self, last: int, label: int) -> bool:
        """Does the state behind ``last`` have an arc ``label``?"""
        column = self.column[label]
        return bool(self.table[self.row[last] + (column >> 3)] >> (column & 7) & 1)

    def _last(self, word: str, ends: dict[str, int]) -> tuple[int, int]:
        """The arc that reaches the end of a short word or beginning, and from where."""
        labels, at = [], len(word) - 1
        while at >= 0 and (label := ends.get(word[at:])) is not None:
            if label >= 0:
                labels.append((label, at))
            at -= 1
        while labels:  # the longest first: most often it is the one
            label, at = found = labels.pop()
            if not at:
                return found
            c = self.column[label]
            if self.table[self.row[self._place(word[:at])[0]] + (c >> 3)] >> (c & 7) & 1:
                return found
        raise ValueError(f"no path for {word!r}")

    def _place(self, begin: str) -> tuple[int, int]:
        found = self.places.get(begin)
        if found is None:
            found = self._last(begin, self.inner)
            if len(self.places) >= PLACES:
                self.places.clear()
            self.places[begin] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Token numbers of the word's path."""
        if not 0 < len(word) <= SHORT:
            return self._encode_long(word)
        label, at = self._last(word, self.final)
        path = [label]
        while at:
            label, at = self._place(word[:at])
            path.append(label)
        return path[::-1]

    def _encode_long(self, word: str) -> list[int]:
        table, row, column = self.table, self.row, self.column
        n = len(word)
        reached, came = [-1] * (n + 1), [0] * (n + 1)  # the arc that reaches each place, and from where
        ends = self.inner
        for end in range(1, n + 1):
            if end == n:
                ends = self.final
            labels, at = [], end - 1
            while at >= 0 and (label := ends.get(word[at:end])) is not None:
                if label >= 0:
                    labels.append((label, at))
                at -= 1
            while labels:  # the longest first: most often it is the one
                label, at = labels.pop()
                if at:
                    c = column[label]
                    if not table[row[reached[at]] + (c >> 3)] >> (c & 7) & 1:
                        continue
                reached[end], came[end] = label, at
                break
            else:
                raise ValueError(f"no path for {word!r}")
        path = []
        while n:
            path.append(reached[n])
            n = came[n]
        return path[::-1]


def load(path: str) -> tuple[MergeAutomaton, list[tuple[str, int]], list[str | None]]:
    """The automaton of a tokenizer file, its special tokens, and the label of each id."""
    with open(path, "rb") as f:
        return compiled(f.read())


def compiled(file: bytes) -> tuple[MergeAutomaton, list[tuple[str, int]], list[str | None]]:
    """Like :func:`load`, from the file's bytes."""
    data = json.loads(file)
    model = data["model"]
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    special = [(x["content"], x["id"]) for x in data["added_tokens"]]
    every = model["vocab"] | dict(special)
    labels: list[str | None] = [None] * (max(every.values(), default=-1) + 1)
    for x, i in every.items():
        labels[i] = x
    return MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"]), special, labels
