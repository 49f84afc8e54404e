"""Cheapest repairs of conversations, worked out once for each distinct ending.

A conversation's rows, in turn order, become a signature of one character a row: the first letter of the role (s, u, a, or o for any
other), in capitals if the text is cut short, or x if the row has to go (blank, or role and text seen before in the conversation).
The repaired roles must read (s?(ua)+)?; keeping a row is free, a new role costs 3, an inserted row 3, a deleted row 4, and a row cut
short 3 more unless deleted.

Signatures are joined from their ends: a node of the automaton is an ending, held once whatever the number of conversations that end
so, and has for each state of the grammar the least cost to go, the edit it begins with, and the state after it, which leads on to the
rest of its audit in the node that follows. Edits of equal cost differ in their first letter, so the ASCII-least audit is chosen on the
spot. Endings whose nodes differ only by what all four states cost more share one minimised form, and a mark before a form is worked
out once. Distinct signatures are dealt by ranges of their reversed text and sorted; then the endings that neighbours share are
exactly the common prefix, and a task keeps only the path of the signature at hand (a form and a cost a row): an ending that the sorted order
has left is never needed again. Each signature's audit is read off its path and goes back to its conversations by an equi-join.

Rows move twice, dealt by conversation and sorted inside: to be told apart and signed, and to be rewritten under their audit, which
comes first in its conversation as a row of its own. Both read in order and hold one row, so a conversation of any length streams; what
it has in one piece is its signature and its audit, a character a turn.

Defined results: null role, text, conv_id or turn count as one space where text is made of them; null turn sorts first; rows of equal
turn are ordered by role and text (as damaged), copies next to each other, so repeated rows are duplicates of the first; null conv_id is
a conversation of its own; an empty table gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import slices, stage, width

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a; what a role leads to in each. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("user", "user", "assistant", "user")
NEVER = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
SIGNED = ["conv_id", "place", "role", "text", "fault", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage by crc32 of `conv_id:turn` modulo 20: 0 drops, 1 empties the text, 2 removes its closing marks, 3 repeats the row, 4 makes the role user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, "user").otherwise(word("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def signs(role: Column, text: Column, again: Column) -> Column:
    """Fault of a row: 1 blank, 2 seen before, 3 cut short, 0 none."""
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def signed(rows: DataFrame) -> DataFrame:
    """Rows as (conv_id, place, role, text, fault), place counting from 0, and at place -1 of each conversation its (signature, gaps, blank,
    duplicate, truncated, illegal)."""
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    dealt = rows.repartition(width(rows.sparkSession), "conv_id").withColumn("fault", signs(F.col("role"), F.col("text"), seen))
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held, out, id_type = None, [], None

        def flush():
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], SIGNED)
            out.clear()
            return made

        def close():
            name, marks, faults, illegal, low, high, turns, _ = held
            out.append((name, -1, None, None, None, bytes(marks).decode(), high - low + 1 - turns if turns else 0, *faults[1:], illegal))

        for b in slices(batches, 1000):
            id_type = b.schema.field("conv_id").type
            for name, turn, role, text, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if held is None or name != held[0]:
                    if held is not None:
                        close()
                    held = [name, bytearray(), [0, 0, 0, 0], 0, 0, 0, 0, None]
                out.append((name, len(held[1]), role, text, fault, None, None, None, None, None, None))
                letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
                held[1] += ("x" if fault in (1, 2) else letter.upper() if fault == 3 else letter).encode()
                held[2][fault] += 1
                if held[7] is not None and held[7] + letter not in ("su", "ua", "au"):
                    held[3] += 1
                if turn is not None:
                    if not held[6]:
                        held[4:7] = [turn, turn, 1]
                    elif turn != held[5]:
                        held[5], held[6] = turn, held[6] + 1
                held[7] = letter
            yield flush()
        if held is not None:
            close()
            yield flush()

    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(
        run, f"conv_id {kind}, place long, role string, text string, fault int, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


class Endings:
    """The path of endings of one signature, the shortest first; a form is a node less what all its states cost."""

    def __init__(self):
        self.signature, self.known, self.forms, self.steps = "", {}, [], {}
        base, form = self.form([(0, "", s, 0) if s in (START, ASSISTANT) else (NEVER, "", s, 0) for s in range(4)])
        self.path, self.costs, self.built = array("H", [form]), array("q", [base]), 0

    def form(self, spend: list[tuple[int, str, int, int]]) -> tuple[int, int]:
        """(least cost, form) of a node from its ways that use up a row: (cost, edit, state after it, 1); insertions are tried here."""
        node = list(spend)
        for state in (ASSISTANT, USER, SYSTEM, START):
            to = NEXT[state][MADE[state][0]]
            ahead = spend[to] if state in (ASSISTANT, USER) else node[to]  # two insertions in a row lead back, so one is enough there
            node[state] = min(spend[state], (INSERT + ahead[0], "I", to, 0))
        base = min(w[0] for w in node)
        shape = tuple((w[0] - base, *w[1:]) for w in node)
        if shape not in self.known:
            self.known[shape] = len(self.forms)
            self.forms.append(shape)
        return base, self.known[shape]

    def before(self, mark: str, form: int) -> tuple[int, int]:
        """(further cost, form) of an ending from its first mark and the form of the rest."""
        if (mark, form) not in self.steps:
            rest, spend = self.forms[form], []
            role, more = mark.lower(), CUT_SHORT if mark.isupper() else 0
            for state in range(4):
                ways = [(DELETE + rest[state][0], "D", state, 1)]
                if mark != "x":
                    if role in NEXT[state]:
                        to = NEXT[state][role]
                        ways.append((KEEP + more + rest[to][0], "K", to, 1))
                    to = NEXT[state][MADE[state][0]]
                    ways.append((REROLE + more + rest[to][0], "R", to, 1))
                spend.append(min(ways))
            self.steps[mark, form] = self.form(spend)
        return self.steps[mark, form]

    def audit(self, signature: str) -> tuple[int, str]:
        """(cost, audit); endings shared with the signature before are used again."""
        back, same = signature[::-1], 0
        for a, b in zip(self.signature, back, strict=False):
            if a != b:
                break
            same += 1
        del self.path[same + 1 :], self.costs[same + 1 :]
        for mark in back[same:]:
            more, form = self.before(mark, self.path[-1])
            self.path.append(form)
            self.costs.append(self.costs[-1] + more)
        self.built += len(back) - same
        self.signature = back
        at, state, edits = len(back), START, []
        while True:
            _, edit, to, used = self.forms[self.path[at]][state]
            if not edit:
                return self.costs[-1] + self.forms[self.path[-1]][START][0], "".join(edits)
            edits.append(edit)
            at, state = at - used, to


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""
    names = ["signature", "cost", "audit"]

    def run(batches):
        endings = Endings()
        for b in slices(batches, 5000):
            text = b.column("signature").to_pylist()
            done = [endings.audit(s) for s in text]
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names)

    back = signatures.select("signature", F.reverse("signature").alias("back"))
    ordered = back.repartitionByRange(width(signatures.sparkSession), "back").sortWithinPartitions("back")
    return ordered.select("signature").mapInArrow(run, "signature string, cost long, audit string")


def rewritten(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan, which has a row with an audit for each conv_id, with repaired_sha256 of the rows (conv_id, place, role, text) rewritten by it."""
    keep = [c for c in plan.columns if c != "conv_id"]
    head = plan.withColumns({"place": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    dealt = head.unionByName(rows.select("conv_id", "place", "role", "text"), allowMissingColumns=True)
    ordered = dealt.repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches):
        about, digest, audit, at, state = None, None, "", 0, START

        def put(role: str, text: str):
            digest.update(f"{about['_break']}{role}:{text}".encode("utf-8", "surrogatepass"))
            about["_break"] = "\n"

        def inserts():
            nonlocal at, state
            while audit[at : at + 1] == "I":
                put(MADE[state], "")
                at, state = at + 1, NEXT[state][MADE[state][0]]

        def flush():
            columns = [pa.array([d[c] for d in done], kinds[c]) for c in ("conv_id", *keep)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d["repaired_sha256"] for d in done], pa.string())], ["conv_id", *keep, "repaired_sha256"])

        done, kinds = [], {}
        for b in slices(batches):
            kinds = {f.name: f.type for f in b.schema}
            heads = b.select(["conv_id", *keep]).filter(pc.equal(b.column("place"), -1)).to_pylist()
            turn = iter(heads)
            for place, role, text in zip(*(b.column(c).to_pylist() for c in ("place", "role", "text")), strict=True):
                if place < 0:
                    if about is not None:
                        done.append(about | {"repaired_sha256": digest.hexdigest()})
                    about = next(turn) | {"_break": ""}
                    digest, audit, at, state = hashlib.sha256(), about["audit"], 0, START
                    inserts()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text)
                    state = NEXT[state][role[0]]
                elif edit == "R":
                    put(MADE[state], text)
                    state = NEXT[state][MADE[state][0]]
                inserts()
            if done:
                yield flush()
                done = []
        if about is not None:
            done.append(about | {"repaired_sha256": digest.hexdigest()})
            yield flush()

    schema = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in ("conv_id", *keep))
    return ordered.select("conv_id", "place", "role", "text", *keep).mapInArrow(run, f"{schema}, repaired_sha256 string")


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role,
    text), and of those of `originals` (conv_id) that have no rows."""
    word = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    told = stage(signed(rows.select("conv_id", "turn", word("role"), word("text"))), "turns")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    about = told.where("place = -1").select("conv_id", "signature", *counts)
    plans = stage(audits(about.select("signature").distinct()), "audits")
    named = about.join(plans, "signature").select("conv_id", *counts, "cost", "audit")
    found = rewritten(told.where("place >= 0"), named)
    if originals is None:
        return found
    every = originals.select(F.col("conv_id").alias("_conv")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(F.col("_conv").alias("conv_id"), *[c for c in found.columns if c != "conv_id"])
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (*counts, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _after(x: str, cost: str, edit: str) -> str:
    """SQL of a way: x, a padded cost and its audit in one string, after an edit."""
    return f"lpad((substr({x}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{edit}' || substr({x}, 13)"


def _spend(state: int) -> str:
    to = NEXT[state][MADE[state][0]]
    keep = " ".join(f"WHEN ok AND l = '{role}' THEN {_after(f'r{t}', 'm', 'K')}" for role, t in NEXT[state].items())
    return f"LEAST({_after(f'r{state}', DELETE, 'D')}, CASE WHEN ok THEN {_after(f'r{to}', f'{REROLE} + m', 'R')} END, CASE {keep} END) AS s{state}"


ORACLE = f"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce([n::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT k.*, xor(list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM k, tbl),
e AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE how <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM e),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, substr(role, 1, 1) AS l,
  CASE WHEN last = '' THEN 1 WHEN again THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
q AS (SELECT *, fault NOT IN (1, 2) AS ok, CASE fault WHEN 3 THEN {CUT_SHORT} ELSE 0 END AS m, lag(l) OVER (PARTITION BY g ORDER BY i) || l AS pair FROM o),
c AS (SELECT g, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY g),
b(g, i, r0, r1, r2, r3) AS (SELECT g, n, '000000000000', '000000000006II', '000000000003I', '000000000000' FROM c
  UNION ALL SELECT g, i - 1, {', '.join(f"LEAST(s{z}, {_after(x, INSERT, 'I')})" for z, x in ((0, f"LEAST(s2, {_after('s3', INSERT, 'I')})"), (1, f"LEAST(s2, {_after('s3', INSERT, 'I')})"), (2, 's3'), (3, 's2')))}
  FROM (SELECT b.g, b.i, {', '.join(map(_spend, range(4)))} FROM b JOIN q ON q.g = b.g AND q.i = b.i)),
a AS (SELECT g, substr(r0, 1, 12)::BIGINT AS cost, substr(r0, 13) AS audit FROM b WHERE i = 0),
w(g, p, i, state, made, audit) AS (SELECT g, 1, 1, 0, '', audit FROM a
  UNION ALL SELECT w.g, p + 1, w.i + (e <> 'I')::INT,
    CASE e WHEN 'D' THEN state WHEN 'K' THEN CASE l WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    CASE e WHEN 'D' THEN made ELSE made || chr(10) || CASE e WHEN 'K' THEN role ELSE CASE state WHEN 2 THEN 'assistant' ELSE 'user' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END, audit
  FROM (SELECT w.*, substr(audit, p, 1) AS e FROM w WHERE p <= length(audit)) w LEFT JOIN o ON o.g = w.g AND o.i = w.i),
r AS (SELECT g, sha256(substr(made, 2)) AS repaired_sha256 FROM w WHERE p > length(audit)),
z AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM c JOIN a USING (g) JOIN r USING (g))
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN z ON v.conv_id IS NOT DISTINCT FROM z.conv_id
"""
