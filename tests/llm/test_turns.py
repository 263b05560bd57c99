"""Conversation repair against a plain search over edits."""

import hashlib
import random
import zlib

import pytest

from stowage.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, copies string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best(symbols):
    """Least (cost, edits, lines), by trying all edits from the last row on; symbols: (role, text, fault)."""
    step = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    now = {0: (0, "", []), 3: (0, "", [])}

    def insertions(found):
        for _ in range(4):
            for q, (role, to) in step.items():
                if to in found:
                    cost, edits, lines = found[to]
                    new = (cost + 5, "I" + edits, [f"{role}:", *lines])
                    found[q] = min(found.get(q, new), new)
        return found

    now = insertions(now)
    for role, text, fault in reversed(symbols):
        before = {}
        for q, (to_role, to) in step.items():
            cost, edits, lines = now[q]
            options = [(cost + 2, "D" + edits, lines)]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                cost, edits, lines = now[to]
                options.append((cost + cut + 1, "R" + edits, [f"{to_role}:{text}", *lines]))
                if (q, role[:1]) in keep:
                    cost, edits, lines = now[keep[q, role[:1]]]
                    options.append((cost + cut, "K" + edits, [f"{role}:{text}", *lines]))
            before[q] = min(options)
        now = insertions(before)
    return now[0]


def brute(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted(
            [r for r in after if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
        )
        seen, symbols = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None
            fault = fault or ("truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
            symbols.append((role, text, fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, edits, lines = best(symbols)
        faults = [sum(s[2] == f for s in symbols) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, edits, digest))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut off", "one more? \n", " \t", "", None, "x" * 40 + ".", "x" * 40 + "?", "end. "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)))
    rows += [(70, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(300)]
    rows += [(71, t % 7, rng.choice(roles), rng.choice(texts)) for t in range(120)]
    rows += [(72, 3, "user", "Same.")] * 50 + [(73, None, "user", "a" * 200_000 + ".")]
    return rows


@pytest.mark.parametrize("range_rows", [500_000, 40])
def test_repair_like_brute_force(spark, range_rows):
    rows = conversations()
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    found = turns.summaries(turns.damage(turns.prepare(table)), range_rows=range_rows)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows)


def test_repaired_lines_have_the_form_and_the_digest(spark):
    rows = conversations()
    table = turns.prepare(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    digest = {r.conv_id: r.repaired_sha256 for r in turns.summaries(table).collect()}
    lines: dict = {}
    for r in sorted(turns.repaired(table, range_rows=40).collect(), key=lambda r: r.line):
        lines.setdefault(r.conv_id, []).append(r)
    for conv, own in lines.items():
        initials = "".join(r.role[0] for r in own).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and initials
        text = "\n".join(f"{r.role}:{r.text}" for r in own)
        assert digest[conv] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_whole_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.summaries(turns.damage(turns.prepare(empty))).count() == 0
    good = [(1, 0, "system", "S."), (1, 1, "user", "U?"), (1, 2, "assistant", "A!")]
    table = spark.createDataFrame([(*r, "") for r in good], SCHEMA)
    row = turns.summaries(turns.prepare(table)).collect()[0]
    assert (row.cost, row.audit) == (0, "KKK")


def test_blocks_lead_where_single_symbols_lead():
    table, rng = turns.tables(), random.Random(1)
    assert table.block.shape == (len(table.vectors), 10**turns.BLOCK)
    for _ in range(200):
        symbols = [rng.randrange(10) for _ in range(turns.BLOCK)]
        vector = start = rng.randrange(len(table.vectors))
        for s in reversed(symbols):
            vector = table.step[vector, s]
        assert table.block[start, int("".join(map(str, symbols)))] == vector
