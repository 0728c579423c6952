"""Repair of the structure of conversations over a suffix-shared automaton.

A conversation is a line of turns, each with a signature sign: its role's
initial and its first fault. The cheapest edits that give roles of the form
``(s?(ua)+)?`` depend on the signature alone. Distinct signatures are sorted
from their end, so that walking them in this order is a depth-first walk of
the automaton whose nodes are the suffixes that signatures share; a node's
cost-to-go and first edit of the best audit suffix, per grammar state, are
computed once when the walk enters it. Nodes at the edges between partitions
are computed in both.

Edits: Keep (0), Rerole to the role that the grammar expects (1), Delete (2;
the only one for blank and repeated turns), Insert of an empty turn of the
expected role (5). A truncated turn that is not deleted costs 5 more. From a
node and state each edit leads to one other node and state, so of equally
cheap audits the least is found by the least first letter.

Faults need no group of a conversation: a repeated turn is found by a sort of
hashes. Signatures and repaired turns are streamed in the order of turns;
memory holds one byte per turn of the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch

SPACES = " \t\n\x0b\x0c\r"
#: Signs: s, u, a, o (another role), upper case if truncated, x must go.
SIGNS = "suaoSUAOx"
#: The role expected in each grammar state (start, after s, after a, after u) and the state after it.
EXPECTED = (("user", 3), ("user", 3), ("user", 3), ("assistant", 2))
ENDS = (0, 2)  # states in which a conversation may end
NEVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage chosen by ``crc32(conv_id:turn) % 20``: 0 drops
    the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its
    role user. Nulls in the key, role and text are one blank."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def keyed(rows: DataFrame) -> DataFrame:
    """With the hash that orders turns of one number and role."""
    return rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("sha"))


#: Ascending, nulls first.
ORDER = ["conv_id", "turn", "role", "sha"]


def sign_of(role: Column, blank: Column, repeated: Column, truncated: Column) -> Column:
    initial = F.substring(role, 1, 1)
    small = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(blank | repeated, "x").when(truncated, F.upper(small)).otherwise(small)


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, sha, initial, fault (0 none, 1 blank, 2 repeated,
    3 truncated), sign of every row, without its text."""
    end = F.expr(r"rtrim(' \t\n\u000b\u000c\r', text)")
    base = keyed(rows).select("conv_id", "turn", "role", "sha", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    # one shuffle by conversation serves this window and the sorts after it
    base = base.repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "sha").orderBy(F.col("turn").asc_nulls_first()))
    base = base.withColumn("repeated", nth > 1)
    fault = F.when(F.col("blank"), 1).when(F.col("repeated"), 2).when(F.col("truncated"), 3).otherwise(0)
    return base.select("conv_id", "turn", "role", "sha", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), sign_of(F.col("role"), F.col("blank"), F.col("repeated"), F.col("truncated")).alias("sign"))


class Runs:
    """Sorted batches as runs of one conv_id; a run may go on in the next."""

    def __init__(self, column: str = "conv_id"):
        self.column, self.last, self.any = column, None, False

    def cut(self, batch: pa.RecordBatch) -> list[tuple[bool, object, int, int]]:
        """(goes on, conv_id, from, to) of each run of the batch."""
        ids = batch.column(self.column)
        coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        at = [0, *(np.flatnonzero(coded[1:] != coded[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            conv = ids[a].as_py()
            out.append((self.any and conv == self.last, conv, a, b))
            self.last, self.any = conv, True
        return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal"]
LEGAL = ("su", "ua", "au")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of each
    conversation of ``signed`` rows."""
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_type), ("signature", pa.string()), *[(c, pa.int64()) for c in REPORT]])
        runs, state = Runs(), None

        def row():
            conv, signs, faults, illegal, _, turns = state
            least, most, n = turns
            gaps = most - least + 1 - n if n else 0
            return {"conv_id": conv, "signature": "".join(signs), "gaps": gaps, "blank": faults[1], "duplicate": faults[2], "truncated": faults[3], "illegal": illegal}

        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            initials, signs, faults, turns = (batch.column(c).to_pylist() for c in ("initial", "sign", "fault", "turn"))
            for goes_on, conv, a, b in runs.cut(batch):
                if not goes_on:
                    if state is not None:
                        done.append(row())
                    state = [conv, [], [0] * 4, 0, None, [0, 0, 0]]
                state[1].append("".join(signs[a:b]))
                for f in faults[a:b]:
                    state[2][f] += 1
                before = state[4]
                for i in initials[a:b]:
                    state[3] += before is not None and before + i not in LEGAL
                    before = i
                state[4] = before
                least, most, n = state[5]
                for t in turns[a:b]:
                    if t is not None and (not n or t != most):  # in order: distinct ones differ from the last
                        least, most, n = (least if n else t), t, n + 1
                state[5] = [least, most, n]
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    conv_type = arrow_type(rows, "conv_id")
    # of equal turns the first one is the one that is not repeated
    return rows.sortWithinPartitions(*ORDER, F.col("fault") == 2).select("conv_id", "turn", "initial", "fault", "sign").mapInArrow(run, f"conv_id {kind['conv_id']}, signature string, " + ", ".join(f"{c} long" for c in REPORT))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class Automaton:
    """Costs-to-go and first edits along the suffixes of the current signature,
    from its end: entry d belongs to the suffix of d signs. ``step`` remembers
    what a sign does to a row of costs, which only depends on their
    differences, so it is worked out a few dozen times in all."""

    def __init__(self, costs: Costs):
        self.c, self.steps = costs, {}
        self.floor, self.costs, self.edits = [], [], []  # least cost; costs above it; edits, per state
        self.last = ""
        self.push(self.settled([0 if q in ENDS else NEVER for q in range(4)], ["" if q in ENDS else "?" for q in range(4)]), 0)

    def settled(self, cost: list[int], edit: list[str]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
        """Inserts within a node: at most one round through the grammar."""
        for _ in range(len(EXPECTED)):
            for q, (_, to) in enumerate(EXPECTED):
                least = self.c.insert + cost[to]
                if (least, "I") < (cost[q], edit[q]):
                    cost[q], edit[q] = least, "I"
        least = min(cost)
        return least, tuple(c - least for c in cost), tuple(edit)

    def step(self, sign: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
        if (sign, after) not in self.steps:
            cost, edit = [], []
            for q, (role, to) in enumerate(EXPECTED):
                choices = [(self.c.delete + after[q], "D")]
                if sign != "x":
                    more = self.c.truncated if sign.isupper() else 0
                    choices.append((self.c.rerole + more + after[to], "R"))
                    kept = self.kept(sign, q)
                    if kept is not None:
                        choices.append((more + after[kept], "K"))
                least = min(choices)
                cost.append(least[0])
                edit.append(least[1])
            self.steps[sign, after] = self.settled(cost, edit)
        return self.steps[sign, after]

    @staticmethod
    def kept(sign: str, q: int) -> int | None:
        """The state after a kept turn, if the grammar allows it."""
        if sign.lower() == "s":
            return 1 if q == 0 else None
        role, to = EXPECTED[q]
        return to if sign.lower() == role[0] else None

    def push(self, node: tuple[int, tuple[int, ...], tuple[str, ...]], below: int) -> None:
        self.floor.append(below + node[0])
        self.costs.append(node[1])
        self.edits.append(node[2])

    def solve(self, signature: str) -> tuple[str, int]:
        """(audit, cost); signatures should come sorted by their reverse."""
        same, n = 0, min(len(signature), len(self.last))
        while same < n and signature[-1 - same] == self.last[-1 - same]:
            same += 1
        del self.floor[same + 1 :], self.costs[same + 1 :], self.edits[same + 1 :]
        for d in range(same, len(signature)):
            self.push(self.step(signature[-1 - d], self.costs[-1]), self.floor[-1])
        self.last = signature
        audit, q, d = [], 0, len(signature)
        while True:
            edit = self.edits[d][q]
            if not edit:
                return "".join(audit), self.floor[-1] + self.costs[-1][0]
            audit.append(edit)
            if edit in "IR":
                q = EXPECTED[q][1]
            elif edit == "K":
                q = self.kept(signature[-d], q)
            d -= edit != "I"


def audits(distinct: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(signature, ...) with distinct signatures -> signature, audit, cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(costs)
        for batch in batches:
            found = batch.column("signature").to_pylist()
            solved = [auto.solve(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([a for a, _ in solved], pa.string()), pa.array([c for _, c in solved], pa.int64())], ["signature", "audit", "cost"])

    back = distinct.select("signature").withColumn("back", F.reverse("signature"))
    return back.repartitionByRange("back").sortWithinPartitions("back").select("signature").mapInArrow(run, "signature string, audit string, cost long")


#: A signature of more than this share of all conversations is joined by a
#: broadcast: at most its inverse of them exist.
HOT_SHARE = 1 / 256
HOT_BYTES = 16 << 20  # beyond this size of their rows the join is by merge alone


def with_audits(signed_convs: DataFrame, costs: Costs, scratch: Scratch) -> DataFrame:
    """Adds audit and cost, solved once per distinct signature."""
    counted = signed_convs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.table(counted, "signatures")
    solved = scratch.table(audits(counted, costs).join(counted, "signature"), "audits")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = solved.where(F.col("n") > total * HOT_SHARE)
    size = hot.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
    if size > HOT_BYTES:
        return signed_convs.join(solved.drop("n").hint("merge"), "signature")
    often = signed_convs.join(F.broadcast(hot.drop("n")), "signature")
    rest = signed_convs.join(F.broadcast(hot.select("signature")), "signature", "left_anti")
    return often.unionByName(rest.join(solved.where(F.col("n") <= total * HOT_SHARE).drop("n").hint("merge"), "signature"))


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R, I), role, text of the repaired turns, in
    order within a partition that holds the whole conversation."""
    kind = dict(rows.dtypes)["conv_id"]
    conv_type = arrow_type(rows, "conv_id")
    lines = audited.where("audit <> ''").selectExpr("conv_id", "0 as kind", "null as turn", "audit as role", "'' as text", "cast(null as binary) as sha")
    turns = keyed(rows).selectExpr("conv_id", "1 as kind", "turn", "role", "text", "sha")
    stream = lines.unionByName(turns).repartition("conv_id").sortWithinPartitions(ORDER[0], "kind", *ORDER[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        runs, audit, k, q, place, conv_now, open_ = Runs(), "", 0, 0, 0, None, False

        def inserts(out):
            nonlocal k, q, place
            while k < len(audit) and audit[k] == "I":
                role, q = EXPECTED[q]
                out.append((conv_now, place, "I", role, ""))
                k, place = k + 1, place + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
            for goes_on, conv, a, b in runs.cut(batch):
                if not goes_on:
                    if open_:
                        inserts(out)
                    audit, k, q, place, conv_now, open_ = "", 0, 0, 0, conv, True
                for n in range(a, b):
                    if not kinds[n]:
                        audit = roles[n]
                        continue
                    inserts(out)
                    edit, role = audit[k], roles[n]
                    k += 1
                    if edit == "D":
                        continue
                    if edit == "K":
                        q = Automaton.kept(role[:1], q)
                    else:
                        role, q = EXPECTED[q]
                    out.append((conv, place, edit, role, texts[n]))
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)
        out = []
        if open_:
            inserts(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return stream.select("conv_id", "kind", "role", "text").mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 (of ``role:text`` by line) of the turns of
    ``repaired_turns``, as they lie."""
    kind = dict(turns.dtypes)["conv_id"]
    conv_type = arrow_type(turns, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_type), ("repaired_sha256", pa.string())])
        runs, sha, now = Runs(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            for goes_on, conv, a, b in runs.cut(batch):
                lines = "\n".join([f"{r}:{t}" for r, t in zip(roles[a:b], texts[a:b], strict=True)]).encode("utf-8", "surrogatepass")
                if goes_on:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        done.append({"conv_id": now, "repaired_sha256": sha.hexdigest()})
                    sha, now = hashlib.sha256(), conv
                sha.update(lines)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": sha.hexdigest()}], schema=schema)

    return turns.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations (conv_id, turn, role, text).

    ``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit of each conversation that has rows. ``turns``: see
    ``repaired_turns``. Rows are taken by turn (nulls first); rows of one turn
    by role, then by the SHA-256 of their text. Null conv_ids are one
    conversation; a role whose first letter is not s, u or a (an empty one
    too) can be reroled or deleted, not kept. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    convs = scratch.table(signatures(signed(rows)), "convs")
    report = scratch.table(with_audits(convs, costs, scratch).drop("signature"), "report")
    return report, repaired_turns(rows, report.select("conv_id", "audit"))


def damage_report(conversations: DataFrame) -> DataFrame:
    """The repair of ``damaged`` conversations, for every conv_id of the input:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. One without rows after the damage has zeros, an empty
    audit and the hash of an empty string."""
    report, turns = repair(damaged(conversations))
    found = report.join(digests(turns).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    numbers = [F.coalesce(c, zero).alias(c) for c in [*REPORT, "cost"]]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
