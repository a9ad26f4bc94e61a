"""Conversation repair against trying every edit."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from lexloom.llm import conversation_repair as C

NON_BLANK = re.compile("[^\x20\x09-\x0d]")


def all_edits(flags):
    """(cost, audit) of the best of all edits, insertions up to two at each place."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = (1 << 30, "")

    def go(i, state, cost, audit, run):
        nonlocal best
        if i == len(flags) and state in ("", "a"):
            best = min(best, (cost, audit))
        if run < 2:
            go(i, "a" if state == "u" else "u", cost + 5, audit + "I", run + 1)
        if i < len(flags):
            role, fault = "sua?"[flags[i] // 4], flags[i] % 4
            go(i + 1, state, cost + 2, audit + "D", 0)
            if fault < 2:
                if (state, role) in after:
                    go(i + 1, after[state, role], cost + 5 * fault, audit + "K", 0)
                go(i + 1, "a" if state == "u" else "u", cost + 1 + 5 * fault, audit + "R", 0)
    go(0, "", 0, "", 0)
    return best


def cost_of(flags, audit):
    cost, i = 0, 0
    for edit in audit:
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[edit]
        if edit != "I":
            cost += 5 * (flags[i] % 4 == C.CUT and edit != "D")
            i += 1
    assert i == len(flags)
    return cost


def in_segments(flags, cuts):
    parts = [flags[a:b] for a, b in itertools.pairwise([0, *cuts, len(flags)])]
    moves = [C._unpacked(C._packed([C.Rows(p).forward(0, len(p), x) for x in C.STATES])) for p in parts]
    chain = C.Segments(moves)
    end = C.last_state(chain)
    ways = C.hirschberg(chain, C.START, end)
    return "".join("".join(C.hirschberg(C.Rows(p), x, y)) for p, (x, y) in zip(parts, ways)) + C.ENDS[end][1]


def test_least_edits():
    codes = [4 * r + f for r in range(4) for f in range(4)]
    for n in range(1, 3):
        for flags in itertools.product(codes, repeat=n):
            assert C.whole_audit(bytes(flags)) == all_edits(flags)[1], flags
    rng = random.Random(1)
    for _ in range(150):
        flags = bytes(rng.choices(codes, [6, 3, 1, 1] * 2 + [6, 3, 1, 1] + [2, 1, 1, 1], k=rng.randint(3, 5)))
        assert C.whole_audit(flags) == all_edits(flags)[1]


def test_segments_change_nothing():
    rng = random.Random(2)
    for _ in range(200):
        flags = bytes(rng.choices(range(16), k=rng.randint(2, 60)))
        cuts = sorted(rng.sample(range(1, len(flags)), rng.randint(1, min(5, len(flags) - 1))))
        assert in_segments(flags, cuts) == C.whole_audit(flags)


def test_long_chain():
    rng = random.Random(3)
    flags = bytes(rng.choices(range(16), k=50_000))
    audit = C.whole_audit(flags)
    state = C.last_state(C.Rows(flags))
    assert cost_of(flags, audit) == C.Rows(flags).forward(0, len(flags), C.START)[state][0] + C.ENDS[state][0]


def brute(rows, audit_of=None):
    """Report rows of damaged conversations, from (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0,
                                 hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        flags, seen = [], set()
        for _, role, text in kept:
            chars = NON_BLANK.findall(text)
            fault = 2 if not chars else 3 if (role, text) in seen else 0 if chars[-1] in ".!?" else 1
            seen.add((role, text))
            flags.append(4 * "sua".find(role[:1] or "?") + fault if role[:1] in "sua" and role else 12 + fault)
        audit = (audit_of or (lambda f: all_edits(f)[1]))(bytes(flags)) if flags else ""
        state, lines, left = "", [], iter(kept)
        for edit in audit:
            need = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{need}:")
            else:
                _, role, text = next(left)
                if edit == "D":
                    continue
                lines.append(f"{need if edit == 'R' else role}:{text}")
            state = lines[-1][0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        turns = {t for t, _, _ in kept if t is not None}
        pairs = ["sua?"[a // 4] + "sua?"[b // 4] for a, b in itertools.pairwise(flags)]
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                 *[sum(f % 4 == k for f in flags) for k in (2, 3, 1)], sum(p not in ("su", "ua", "au") for p in pairs),
                 cost_of(flags, audit), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("mark", "kind", "nth", "flags", "audit", "times")])


def report(spark, rows, **more):
    got = C.repair_report(C.damage(table(spark, rows)), **more)
    assert got.columns == list(C.REPORT)
    got = got.collect()
    assert len(got) == len({r[0] for r in got})
    return {tuple(r) for r in got}


def random_rows(rng, convs, longest):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], [
        "Yes.", "No!", "What now", " \t\n", "", None, "Fine? ", "ends\x0b", "a.b", "é…", "Sure. "]
    rows = []
    for c in convs:
        turns = [rng.choice([None, *range(8)]) for _ in range(rng.randint(1, longest))]
        rows += [(c, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return rows


def test_report(spark):
    rng = random.Random(4)
    rows = random_rows(rng, [*range(60), None, -5], 4)
    assert report(spark, rows) == brute(rows)


@pytest.mark.parametrize("segment", [1, 3, C.SEGMENT])
def test_long_conversation(spark, segment):
    """One conversation with a third of all rows, equal rows among them, in segments."""
    rng = random.Random(5)
    rows = random_rows(rng, range(30), 8)
    rows += [(99, rng.randrange(60), rng.choice(["user", "assistant"]), rng.choice(["Hi.", "So", "Ok.", "No!"]))
             for _ in range(80)] + [(99, 7, "user", "Same.")] * 20
    assert report(spark, rows, segment=segment) == brute(rows, C.whole_audit)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.")]
    assert report(spark, rows) == {(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair_report(C.damage(table(spark, rows).limit(0))).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "No."),
            (1, 3, "assistant", "")]
    got = C.repair_conversations(table(spark, rows)).orderBy("place").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in got] == [
        ("system", "Be kind.", "K"), ("user", "Hi.", "K"), ("assistant", "No.", "R")]
    assert [r["place"] for r in got] == [0, 1, 2]


def test_registered_table(spark):
    from lexloom.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == brute(rows, C.whole_audit)
