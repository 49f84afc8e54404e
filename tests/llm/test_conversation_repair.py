"""Conversation repair against a plain shortest path over (row, state) and, for short ones, over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from tideline.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by a search over (row, roles so far as a state), whole audits compared."""
    best, order = {(0, ""): (0, "", [])}, ["", "s", "u", "a"]

    def after(state, letter):
        return letter if (state, letter) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    def offer(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value
            return True
        return False

    for i in range(len(rows) + 1):
        for _ in range(4):  # insertions at this place
            for state in order:
                if (i, state) in best:
                    cost, audit, made = best[i, state]
                    for role in ("user", "assistant"):
                        if after(state, role[0]):
                            offer((i, role[0]), (cost + 3, audit + "I", [*made, (role, "")]))
        if i == len(rows):
            break
        _, _, role, text = rows[i]
        more = 3 if found[i] == "truncated" else 0
        for state in order:
            if (i, state) not in best:
                continue
            cost, audit, made = best[i, state]
            offer((i + 1, state), (cost + 4, audit + "D", made))
            if found[i] in ("blank", "duplicate"):
                continue
            if after(state, role[:1]):
                offer((i + 1, role[0]), (cost + more, audit + "K", [*made, (role, text)]))
            for new in ("user", "assistant"):
                if after(state, new[0]):
                    offer((i + 1, new[0]), (cost + 3 + more, audit + "R", [*made, (new, text)]))
    return min((best[len(rows), s] for s in ("", "a") if (len(rows), s) in best), key=lambda b: b[:2])


def expected(rows):
    out, by_conv = {}, {}
    for r in rows:
        by_conv.setdefault(r[0], [])
    for r in damage(rows):
        by_conv[r[0]].append(r)
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, made = cheapest(mine, found)
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in made))
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def drawn(seed, conversations=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = rng.choice([0, 0, 5, -3])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "half", "", " \t\n", "é?  ", None, "same.", f"text {rng.random()}.", "漢字。"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
            turn += rng.choice([1, 1, 1, 1, 2, 0, 7])
    rows += [(None, 0, "user", "no conversation."), (None, 1, "assistant", "id."), (None, None, None, None)]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(700)]
    return rows


def got(frame):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def test_counts_audits_and_hashes(spark):
    rows = drawn(4)
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA).repartition(5)
    found = repair.repair(repair.damaged(frame), frame)
    assert got(found) == expected(rows)
    assert found.count() == len({r[0] for r in rows})


def test_conversation_without_rows_after_damage_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "x.", "", 0)], SCHEMA)
    assert got(repair.repair(repair.damaged(frame), frame)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repair(repair.damaged(frame.where("false")), frame.where("false")).count() == 0


def test_every_short_signature_against_all_edits():
    """Cost and audit of all signatures of up to three rows from enumeration of every edit sequence with up to two insertions a gap."""
    def ways(signature):
        states = [(0, "", "")]
        for mark in [*signature, None]:
            states = [(c + 3 * len(extra), a + "I" * len(extra), r + extra) for c, a, r in states for extra in ("", "u", "a", "ua", "au")]
            if mark is None:
                return states
            more, role = 3 * mark.isupper(), mark.lower()
            states = [(c + 4, a + "D", r) for c, a, r in states] + ([] if mark == "x" else [
                *((c + more, a + "K", r + role) for c, a, r in states), *((c + 3 + more, a + "R", r + to) for c, a, r in states for to in "ua")])

    endings = repair.Endings()
    for n in range(4):
        for marks in itertools.product("suaoSUAOx" if n < 3 else "suoUx", repeat=n):
            signature = "".join(marks)
            assert endings.audit(signature) == min((c, a) for c, a, r in ways(signature) if GRAMMAR.fullmatch(r)), signature


def test_shared_endings_are_built_once():
    rng = random.Random(9)
    tails = ["".join(rng.choice("suaUAx") for _ in range(40)) for _ in range(5)]
    signatures = sorted({rng.choice("ua") * rng.randint(0, 3) + rng.choice(tails) for _ in range(300)}, key=lambda s: s[::-1])
    endings = repair.Endings()
    for s in signatures:
        fresh = repair.Endings()
        assert endings.audit(s) == fresh.audit(s)
    assert endings.built == len({s[k:] for s in signatures for k in range(len(s))})
    assert len(endings.forms) < 60
