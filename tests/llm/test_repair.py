import hashlib
import random
import re
import zlib

import pytest

from slotwise.llm.repair import INSERT, NOTHING, combined, damage, edits_of, parse, repair, repair_text, row_cell

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}
ROLE = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """(cost, audit, lines) of (role, text) rows by an automaton that carries the best of each state."""
    seen, states = set(), {"0": (0, "", ())}

    def inserted(states):
        todo = list(states.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            for role in "ua":
                if (to := NEXT.get((state, role))) and ((new := (cost + 3, audit + "I", (*lines, f"{ROLE[role]}:"))) < states.get(to, (1 << 60,))):
                    states[to] = new
                    todo.append((to, new))
        return states

    states, faults = inserted(states), []
    for role, text in rows:
        inner = text.strip(WHITE)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        after = {s: (c + 4, a + "D", x) for s, (c, a, x) in states.items()}
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault else 0
            for s, (c, a, x) in states.items():
                for symbol, price, edit, name in [(role[:1], 0, "K", role), ("u", 3, "R", "user"), ("a", 3, "R", "assistant")]:
                    if to := NEXT.get((s, symbol)):
                        new = (c + price + extra, a + edit, (*x, f"{name}:{text}"))
                        after[to] = min(new, after.get(to, (1 << 60,)))
        states = inserted(after)
    cost, audit, lines = min(states[s] for s in "03" if s in states)
    return cost, audit, lines, faults


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, role, text) for c, t, role, text in after if c == conv])
        turns = [t for some, t, _, _ in own if some]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines, faults = plain_repair([(role, text) for _, _, role, text in own])
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        kinds = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    random.seed(11)
    rows = []
    for c in range(60):
        for t in range(random.choice([1, 2, 3, 5, 8])):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = random.choice(["Yes.", "No!", "what", "", " \t", None, "ok. ", "end.  \n", "Why?"])
            rows.append((c, random.choice([t, t, t, t + 3, None]), role, text))
    rows += [(100, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(150)]
    rows += [(101, t, random.choice(["user", "assistant", "system"]), random.choice(["A.", "B", f"C{t}."])) for t in range(90)]
    rows += [(None, 1, "user", "Lost."), (None, 2, "assistant", "x" * 200_000 + "."), (102, None, None, None), (103, 5, "assistant", "same."), (103, 5, "assistant", "same.")]
    drop = next(t for t in range(1000) if zlib.crc32(f"104:{t}".encode()) % 20 == 0)
    return rows + [(104, drop, "user", "Gone.")]


@pytest.mark.parametrize("portion", [3, 256])
def test_repair_equals_a_plain_automaton(spark, portion):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(5)
    got = repair(damage(turns), turns, portion)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain(rows)
    assert repair(damage(turns.limit(0)), turns.limit(0)).count() == 0


def test_charts_of_any_cut_agree():
    random.seed(2)
    kinds = [(r, f) for r in ("s", "u", "a", "x") for f in ("", "truncated", "blank", "duplicate")]
    for _ in range(30):
        cells = [row_cell(*random.choice(kinds)) for _ in range(random.randrange(1, 40))]
        whole = combined(cells)
        cut = random.randrange(len(cells))
        assert whole == combined([c for c in (combined(cells[:cut]), combined(cells[cut:]))])
        assert len(cells) > 12 or whole == parse(cells)
    assert combined([]) == NOTHING and NOTHING["03"] == (2 * INSERT, "II")


def test_edits_name_roles():
    assert list(edits_of("KKK")) == [("", "", ""), ("", "", ""), ("", "", "")]
    assert list(edits_of("IKRI")) == [("user:", "", ""), ("", "user", "assistant:")]
    assert list(edits_of("KDRI")) == [("", "", ""), ("", None, ""), ("", "user", "assistant:")]
    assert list(edits_of("DD")) == [("", None, ""), ("", None, "")]


def test_repaired_turns_are_well_formed(spark):
    rows = [r for r in conversations() if r[0] in (100, 101)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = {}
    for r in repair_text(damage(turns)).orderBy("conv_id", "pos").collect():
        lines.setdefault(r["conv_id"], []).extend(r["lines"].split("\n"))
    for got in lines.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in got))
