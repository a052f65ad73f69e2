"""Conversation repair against all edits on short conversations, and against a plain search on long ones."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import conversations
from tagloom.llm.conversations import Rope, digests, repair, rule_matrices
from tagloom.llm.queries import LLM_QUERIES

FORM = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault of each (role, text): blank, duplicate, truncated or none."""
    seen, out = set(), []
    for role, text in rows:
        solid = BLANK.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, audit, row or nothing) of everything that can be done to a row."""
    role, text = row
    stays = 3 if fault == "truncated" else 0
    out = [(4, "D", None)]
    if fault not in ("blank", "duplicate"):
        out += [(stays, "K", row)] + [(stays + 3, "R", (r, text)) for r in ("user", "assistant")]
    return out


def every_edit(rows):
    marks = faults(rows)
    put_in = [(3 * len(x), "I" * len(x), [({"u": "user", "a": "assistant"}[c], "") for c in x]) for x in ("", "u", "a", "ua", "au")]
    best = None
    for gaps in itertools.product(put_in, repeat=len(rows) + 1):
        for picks in itertools.product(*[choices(r, m) for r, m in zip(rows, marks)]):
            cost = sum(g[0] for g in gaps) + sum(p[0] for p in picks)
            if best and cost > best[0]:
                continue
            lines = list(gaps[0][2])
            for p, g in zip(picks, gaps[1:]):
                lines += ([p[2]] if p[2] else []) + g[2]
            if FORM.fullmatch("".join((r[0][:1] or "x") if r[0][:1] in "sua" else "x" for r in lines)):
                found = (cost, gaps[0][1] + "".join(p[1] + g[1] for p, g in zip(picks, gaps[1:])), lines)
                best = found if best is None or found[:2] < best[:2] else best
    return best


def searched(rows):
    """The same by dynamic programming over prefixes, with whole audits."""
    marks, step = faults(rows), {"0s": "S", "0u": "U", "Su": "U", "Au": "U", "Ua": "A"}
    held = {"0": (0, "", ())}

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for state, (c, a, lines) in list(table.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if state + r in step:
                        put(table, step[state + r], (c + 3, a + "I", (lines, (name, ""))))
        return table

    for row, mark in zip(rows, marks):
        after = {}
        for state, (c, a, lines) in inserted(held).items():
            for cost, audit, kept in choices(row, mark):
                if kept is None:
                    put(after, state, (c + cost, a + audit, lines))
                elif state + kept[0][:1] in step:
                    put(after, step[state + kept[0][:1]], (c + cost, a + audit, (lines, kept)))
        held = after
    cost, audit, lines = min((held[s] for s in inserted(held) if s in "0A"), key=lambda e: e[:2])
    out = []
    while lines:
        lines, line = lines
        out.append(line)
    return cost, audit, out[::-1]


def summary(conv):
    """What the report must say of rows (turn, role, text) in order."""
    rows = [(r, t) for _, r, t in conv]
    marks, turns = faults(rows), [t for t, _, _ in conv if t is not None]
    initial = [r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in rows]
    cost, audit, lines = searched(rows)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": marks.count("blank"), "duplicate": marks.count("duplicate"),
            "truncated": marks.count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:])),
            "cost": cost, "audit": audit, "lines": lines}


def in_order(rows):
    """Rows (conv_id, turn, role, text) by conversation, nulls as one space, each in its stated order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rs, key=key) for c, rs in out.items()}


def compared(spark, rows, block, fan=conversations.FAN):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit(1)).withColumn("pos", F.lit("x"))
    report, lines = repair(df, block, fan)
    got = {r["conv_id"]: r.asDict() for r in report.collect()}
    texts = {}
    for r in lines.orderBy("conv_id", "pos", "sub").collect():
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    sums = {r["conv_id"]: r["sha256"] for r in digests(lines).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for conv, expected in want.items():
        said = summary(expected)
        assert texts.get(conv, []) == said.pop("lines"), conv
        assert {k: got[conv][k] for k in said} == said, conv
        if conv in texts:
            assert sums[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts[conv]).encode()).hexdigest()


ROLES = ["system", "user", "assistant", "tool", "", "agent", "user", "assistant"]
TEXTS = ["Yes.", "No!", "And then", "", "  \t", "Why? ", "x", "Ünd?\n", " "]


def test_plain_search_equals_all_edits():
    draw = random.Random(5)
    for n in (0, 1, 2, 3, 3, 3, 3, 3):
        for _ in range(4):
            rows = [(draw.choice(ROLES), draw.choice(TEXTS)) for _ in range(n)]
            assert searched(rows) == every_edit(rows), rows


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations(spark, block):
    draw = random.Random(7)
    rows = []
    for conv in range(60):
        for k in range(draw.choice([1, 2, 3, 5, 8, 13])):
            rows.append((conv, k + (k > 3), draw.choice(ROLES + [None]), draw.choice(TEXTS + [None] + [f"Say {k}.", f"Say {k}!", f"say {k}"] * 4)))
    rows += [(100, None, "user", "Hello."), (100, None, "assistant", "Hi."), (100, 3, "user", "So"), (None, 1, "user", "a."), (None, 1, "user", "a."), (101, 1, None, None)]
    rows += [(102, 5, "user", "Again.")] * 40  # one row repeated
    rows += [(103, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(700)] + [(103, 900, "user", "é" * 30_000)]
    draw.shuffle(rows)
    compared(spark, rows, block)


def test_deep_tree_of_blocks(spark):
    draw = random.Random(9)
    compared(spark, [(c, k, draw.choice(ROLES), draw.choice([f"{k}.", f"{k}", ""])) for c in (1, 2) for k in range(50)], 2, 2)


def test_empty_table(spark):
    report, lines = repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == lines.count() == digests(lines).count() == 0


def test_rules_share_matrices():
    rules = [("ua", ""), ("", ""), ("U", "")]
    m = rule_matrices(rules)
    flat = conversations._roped(m["u"])
    for c in "auaU":
        flat = conversations.product(flat, conversations._roped(m[c]))
    assert [[e and (e[0], str(e[1])) for e in r] for r in flat] == m[""]


def test_ropes_compare_as_text():
    draw = random.Random(3)
    made = []
    for _ in range(60):
        text = "".join(draw.choice("DIK") for _ in range(draw.choice([0, 1, 40, 90]))) + "K" * draw.choice([0, 50])
        rope, k = Rope(), 0
        while k < len(text):
            n = draw.randint(1, 45)
            rope, k = rope + Rope(text[k : k + n]), k + n
        assert str(rope) == text and rope.size == len(text)
        made.append((text, rope))
    for a, x in made:
        for b, y in made:
            assert (x < y) == (a < b), (a, b)


def test_query_equals_plain_rules(spark, sf):
    got = {r["conv_id"]: r for r in LLM_QUERIES["op13_conversations"](spark, sf).collect()}
    rows = []
    convs = set()
    for conv, turn, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        convs.add(conv)
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    want = in_order(rows)
    assert set(got) == convs
    for conv in convs:
        said = summary(want.get(conv, []))
        said["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said.pop("lines")).encode()).hexdigest()
        assert {k: got[conv][k] for k in said} == said, conv
