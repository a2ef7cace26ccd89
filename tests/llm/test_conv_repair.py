"""Conversation repair against a plain program over single rows."""

import hashlib
import random
import re
import zlib

import pytest

from relcast.llm import conv_repair
from relcast.llm.common import prepare

DDL = "conv_id long, turn long, role string, text string, part string, kind int"
TO = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def best(rows):
    """Cheapest, then least edits; (cost, audit, lines) for every last initial written, row by row."""
    def inserted(at):
        for _ in range(4):
            for q, (c, a, out) in list(at.items()):
                to = "a" if q == "u" else "u"
                new = (c + 5, a + "I", out + [{"a": "assistant:", "u": "user:"}[to]])
                if to not in at or new[:2] < at[to][:2]:
                    at[to] = new
        return at

    at = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        nxt = {}

        def offer(q, c, letter, line):
            for state, (c0, a0, out) in [(q[0], at[q[0]])]:
                new = (c0 + c, a0 + letter, out + ([line] if line is not None else []))
                if q[1] not in nxt or new[:2] < nxt[q[1]][:2]:
                    nxt[q[1]] = new

        for q in at:
            offer((q, q), 2, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if (q, role[:1]) in TO:
                offer((q, role[:1]), extra, "K", f"{role}:{text}")
            to = "a" if q == "u" else "u"
            offer((q, to), extra + 1, "R", {"a": "assistant:", "u": "user:"}[to] + text)
        at = inserted(nxt)
    return min((at[q] for q in ("", "a") if q in at), key=lambda x: x[:2])


def expected(rows):
    convs = {}
    for i, (conv, turn, role, text) in enumerate(rows):
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, [])
        kind = zlib.crc32(name.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        n, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for turn, role, text in mine:
            words = re.findall("[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, *_ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = best(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(sp, rows):
    df = sp.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(3)
    got = conv_repair.repair_conversations(conv_repair.damage(df)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def talk(rng, conv, n):
    texts = ["Fine.", "Go on", "Well then!", " \t", "", None, "Really? ", "Yes\n"]
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"])
    return [(conv, t, role(), (rng.choice(texts) or "") + (f" {rng.randrange(9)}." if rng.random() < 0.6 else "")) for t in rng.sample(range(3 * n), n)]


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_matches_the_plain_program(sp, monkeypatch, limit):
    monkeypatch.setattr(conv_repair, "SEGMENT_ROWS", limit)
    rng = random.Random(limit)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.choice([1, 2, 4, 8, 13]))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"Turn {t}." + "x" * (t == 7)) for t in range(150)]
    rows += [(101, None, "user", "Same."), (102, None, None, None), (None, 3, "user", "Hm."), (None, 4, "assistant", "Hm.")]
    rows += [(103, 5, "system", "One.")] * 40 + [(104, t, "user", "Over and over.") for t in range(90)]
    got, want = results(sp, rows), expected(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)))
    assert got == want


def test_every_short_sequence(sp):
    """All sequences of up to four symbols: costs and letters of the run-length program."""
    import itertools
    kinds = [(r, f) for r in ("s", "u", "a", "") for f in ("", "t")] + [("", "x")]
    name = {"s": "system", "u": "user", "a": "assistant", "": "tool"}
    for n in range(4):
        for seq in itertools.product(kinds, repeat=n):
            rows = [(name[r], "", {"x": "blank", "t": "truncated", "": ""}[f]) for r, f in seq]
            cost, audit, _ = best(rows)
            runs = conv_repair.collapse(list(seq))
            got, _ = conv_repair.unroll(runs, conv_repair.EMPTY, conv_repair.LAST, True)
            v = conv_repair.LAST
            for run in reversed(runs):
                v = conv_repair.before(run, v)
            assert (got, v[conv_repair.EMPTY]) == (audit, cost)


def test_long_runs_use_powers():
    for symbol in [("u", ""), ("a", "t"), ("s", ""), ("", "x"), ("", "")]:
        steps = conv_repair.LAST
        for n in range(1, 40):
            steps = conv_repair.before((symbol, 1), steps)
            assert conv_repair.before((symbol, n), conv_repair.LAST) == steps
    assert conv_repair.before((("", "x"), 10**12), conv_repair.LAST)[0] == 2 * 10**12


def test_empty_table(sp):
    assert conv_repair.repair_conversations(conv_repair.damage(sp.createDataFrame([], DDL))).count() == 0


def test_long_text(sp):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "Ok.")]
    assert results(sp, rows) == expected(rows)
