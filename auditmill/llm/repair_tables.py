"""Block tables for the cheapest repair of a sequence of roles (Four Russians).

A repaired conversation reads `(s?(ua)+)?` in role initials. An automaton with four states stands for what was given out
so far: START, after the system row, after a user row, after an assistant row. For the rows to the right of a place the
cost to go is a vector of one number a state; less its least number it is one of a few dozen vectors. A table says, for
each such vector and each block of BLOCK row symbols, which vector stands left of the block, what the block adds, and in
which state the cheapest edits leave it. Sequences are worked through by look-ups; blocks are only expanded, from their
right-hand vector backward, to spell out the edits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

BLOCK = 4
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5  # cost of an edit
CUT = 5                                    # on top, for a truncated row that is not deleted

START, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = ("u", "u", "a", "u")              # the role that rerole and insert give in a state
AFTER = (USER, USER, ASSISTANT, USER)      # and the state it leads to
ROLE_NAMES = {"u": "user", "a": "assistant"}
INITIALS = "sua"                           # any other initial is one more class
MUST_GO = 8                                # symbol of a row that has to be deleted
SYMBOLS = 9


def symbol(initial: str, cut: bool, must_go: bool) -> int:
    """The symbol of a row; nothing else of it counts for the edits."""
    return MUST_GO if must_go else 2 * (INITIALS.find(initial) if initial and initial in INITIALS else 3) + bool(cut)


def _choices(state: int, sign: int, right: Sequence[int]) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits of a row itself, by letter."""
    found = [("D", DELETE + right[state], state)]
    if sign != MUST_GO:
        initial, extra = (INITIALS + "?")[sign // 2], CUT * (sign % 2)
        if initial == "s" and state == START:
            found.append(("K", KEEP + extra + right[SYSTEM], SYSTEM))
        elif initial == NEEDED[state]:
            found.append(("K", KEEP + extra + right[AFTER[state]], AFTER[state]))
        found.append(("R", REROLE + extra + right[AFTER[state]], AFTER[state]))
    return found


def _with_inserts(plain: Sequence[int]) -> list[int]:
    """Costs when rows may be put in first; more than two bring no state that fewer do not."""
    return [min(plain[q], INSERT + plain[AFTER[q]], 2 * INSERT + plain[AFTER[AFTER[q]]]) for q in range(4)]


def _left_of(sign: int, right: Sequence[int]) -> list[int]:
    return _with_inserts([min(c for _, c, _ in _choices(q, sign, right)) for q in range(4)])


@lru_cache(maxsize=1 << 16)
def _row_edits(state: int, sign: int, right: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to a row's own, and the state they lead to."""
    left, letters = _left_of(sign, right), ""
    while True:
        best = left[state]
        own = {letter: (cost, after) for letter, cost, after in _choices(state, sign, right)}
        if own["D"][0] == best:
            return letters + "D", own["D"][1]
        if INSERT + left[AFTER[state]] == best:
            letters, state = letters + "I", AFTER[state]
            continue
        letter = "K" if own.get("K", (None,))[0] == best else "R"
        return letters + letter, own[letter][1]


FAR = 10 ** 6
LAST = tuple(_with_inserts([0, FAR, FAR, 0]))  # right of the last row


class BlockTables:
    """Vectors (normalised, LAST is number 0) and their transitions by symbol and by block of symbols."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors = [LAST]
        number, links = {LAST: 0}, []
        for v in self.vectors:  # grows while it is walked
            for sign in range(SYMBOLS):
                left = _left_of(sign, v)
                least = min(left)
                norm = tuple(c - least for c in left)
                if norm not in number:
                    number[norm] = len(self.vectors)
                    self.vectors.append(norm)
                links.append((number[norm], least, [_row_edits(q, sign, v)[1] for q in range(4)]))
        n = len(self.vectors)
        one_next = np.array([x[0] for x in links]).reshape(n, SYMBOLS)
        one_add = np.array([x[1] for x in links]).reshape(n, SYMBOLS)
        one_exit = np.array([x[2] for x in links], dtype=np.uint8).reshape(n, SYMBOLS, 4)
        #: by block length: next vector, cost added, exit state by entry state; a block is a number in base SYMBOLS
        self.tables = {1: (one_next, one_add, one_exit)}
        nxt, add, out = one_next, one_add, one_exit
        for length in range(2, block + 1):  # a symbol put to the left of every shorter block
            code = np.arange(SYMBOLS ** length)
            first, rest = code // SYMBOLS ** (length - 1), code % SYMBOLS ** (length - 1)
            middle = nxt[:, rest]
            add = add[:, rest] + one_add[middle, first]
            entered = one_exit[middle, first]
            out = np.take_along_axis(out[:, rest], entered.astype(np.int64), axis=2)
            nxt = one_next[middle, first]
            self.tables[length] = (nxt, add, out)

    def cut(self, signs: Sequence[int]) -> list[tuple[int, int]]:
        """(length, number) of the blocks of a sequence, a shorter one last."""
        found = []
        for at in range(0, len(signs), self.block):
            code = 0
            for sign in signs[at:at + self.block]:
                code = code * SYMBOLS + sign
            found.append((min(self.block, len(signs) - at), code))
        return found

    def repair(self, signs: Sequence[int]) -> tuple[int, list[str]]:
        """(cost, letters of each row); inserts after the last row follow its letter."""
        blocks, vector, cost, rights = self.cut(signs), 0, 0, []
        for length, code in reversed(blocks):
            rights.append(vector)
            nxt, add, _ = self.tables[length]
            cost, vector = cost + int(add[vector, code]), int(nxt[vector, code])
        letters, state = self.spell(blocks, rights[::-1], START)
        return cost + self.vectors[vector][START], self.close(letters, state)

    def through(self, signs: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stretch of a longer sequence, for every vector right of it: vector left of it, cost added, exit states."""
        vector, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), dtype=np.int64)
        out = np.tile(np.arange(4), (len(self.vectors), 1))
        for length, code in reversed(self.cut(signs)):
            nxt, add, leave = self.tables[length]
            out = np.take_along_axis(out, leave[vector, code].astype(np.int64), axis=1)
            cost, vector = cost + add[vector, code], nxt[vector, code]
        return vector, cost, out

    def spell_stretch(self, signs: Sequence[int], right: int, state: int) -> list[str]:
        """Letters of the rows of a stretch between a state on its left and a vector on its right."""
        blocks, rights = self.cut(signs), []
        for length, code in reversed(blocks):
            rights.append(right)
            right = int(self.tables[length][0][right, code])
        return self.spell(blocks, rights[::-1], state)[0]

    def spell(self, blocks: list[tuple[int, int]], rights: list[int], state: int) -> tuple[list[str], int]:
        letters: list[str] = []
        for (length, code), right in zip(blocks, rights):
            of_rows, state = self._expand(length, code, right, state)
            letters += of_rows
        return letters, state

    @lru_cache(maxsize=1 << 18)
    def _expand(self, length: int, code: int, right: int, state: int) -> tuple[tuple[str, ...], int]:
        signs = [code // SYMBOLS ** k % SYMBOLS for k in range(length)]  # from the last row to the first
        vectors = [right]
        for sign in signs[:-1]:
            vectors.append(int(self.tables[1][0][vectors[-1], sign]))
        letters = []
        for sign, vector in zip(signs[::-1], vectors[::-1]):
            own, state = _row_edits(state, sign, self.vectors[vector])
            letters.append(own)
        return tuple(letters), state

    @staticmethod
    def close(letters: list[str], state: int) -> list[str]:
        """Rows put in after the last one."""
        while letters and LAST[state]:
            letters[-1], state = letters[-1] + "I", AFTER[state]
        return letters


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()
