"""Conversation repair against brute force: block tables by all paths, whole conversations with pieces of any size."""

import hashlib
import random
import re
import zlib

import pytest

from auditmill.llm import repair, repair_tables as R

BLANK = "\x20\t\n\x0b\x0c\r"


def cheapest(signs):
    """(cost, audit) over all edits: per state the least cost, of these the ASCII-least letters."""
    def with_inserts(best):
        for _ in range(3):
            for q, (cost, letters) in list(best.items()):
                new = (cost + 5, letters + "I")
                best[R.AFTER[q]] = min(best.get(R.AFTER[q], new), new)
        return best

    best = {0: (0, "")}
    for sign in signs:
        found = {}
        for q, (cost, letters) in with_inserts(dict(best)).items():
            options = [(q, 2, "D")]
            if sign != R.MUST_GO:
                initial, extra = "sua?"[sign // 2], 5 * (sign % 2)
                if initial == "s" and q == 0:
                    options.append((1, extra, "K"))
                elif initial == R.NEEDED[q]:
                    options.append((R.AFTER[q], extra, "K"))
                options.append((R.AFTER[q], 1 + extra, "R"))
            for state, price, letter in options:
                new = (cost + price, letters + letter)
                found[state] = min(found.get(state, new), new)
        best = found
    return min(x for q, x in with_inserts(best).items() if q in (0, 3))


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables(block):
    rng, tables = random.Random(block), R.BlockTables(block)
    for _ in range(1500):
        signs = rng.choices(rng.choice([range(9), [0, 2, 4], [2, 4, 8], [2, 3, 4, 5, 6, 8]]), k=rng.randint(0, 14))
        cost, letters = tables.repair(signs)
        assert (cost, "".join(letters)) == cheapest(signs)
        at = rng.randint(0, len(signs))
        _, _, out = tables.through(signs[at:])
        vector, added, before = tables.through(signs[:at])
        right = tables.through(signs[at:])
        assert right[1][0] + added[right[0][0]] + tables.vectors[vector[right[0][0]]][0] == cost
        state = int(before[right[0][0], 0])
        both = tables.spell_stretch(signs[:at], int(right[0][0]), 0) + tables.spell_stretch(signs[at:], 0, state)
        assert tables.close(both, int(out[0][state])) == letters


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in damaged([r for r in rows if r[0] == conv])]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signs, blank, again, cut = set(), [], 0, 0, 0
        for _, role, text in mine:
            b, a = not text.strip(BLANK), (role, text) in seen
            c = not b and text.rstrip(BLANK)[-1] not in ".!?"
            seen.add((role, text))
            blank, again, cut = blank + b, again + (a and not b), cut + (c and not a)
            signs.append(R.symbol(role[:1], c, b or a))
        turns = [r[0] for r in mine if r[0] is not None]
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(mine, mine[1:]))
        cost, audit = cheapest(signs)
        left, out, state = list(mine), [], 0
        for letter in audit:
            row = None if letter == "I" else left.pop(0)
            if letter == "D":
                continue
            if letter == "K" and row[1][:1] == "s":
                out.append((row[1], row[2]))
                state = 1
                continue
            out.append((row[1] if letter == "K" else R.ROLE_NAMES[R.NEEDED[state]], "" if letter == "I" else row[2]))
            state = R.AFTER[state]
        text = "\n".join(f"{r}:{t}" for r, t in out)
        found[conv] = ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), blank, again, cut, illegal, cost, audit,
                       hashlib.sha256(text.encode()).hexdigest()), out
    return found


def talks(rng, count, most):
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]),
                         rng.choice(["Yes.", "no", "Why?", "", " \n", None, f"word {turn}.", "end. ", "end. \t\n"])))
    return rows


@pytest.mark.parametrize("piece_rows", [2, 7, 4096])
def test_conversations(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = talks(rng, 60, 12) + [(1000, t, "user" if t % 2 == 0 else "assistant", f"t {t % 50}.") for t in range(600)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Oh."), (2000, 5, "user", "same.")] + [(2000, 5, "user", "same.")] * 300
    rows += [(3000, 1, "user", "x" * 300_000 + "."), (3000, 2, "assistant", "y" * 300_000), (3001, 2 ** 60, "user", "a."), (3001, 2 ** 60 + 1, "assistant", "b.")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, gaps int").repartition(5)
    done = repair.repair(repair.damage(table), there_column="there", piece_rows=piece_rows)
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in done.conversations.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()}
    assert got == {k: v[0] for k, v in want.items()}
    messages = {}
    for r in sorted(done.messages().collect(), key=lambda r: r.position):
        messages.setdefault(r.conv_id, []).append((r.role, r.text))
    assert messages == {k: v[1] for k, v in want.items() if v[1]}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.repair(repair.damage(none), there_column="there")
    assert done.conversations.collect() == [] and done.messages().collect() == []
