"""Conversation structure repair by dynamic programming over a grammar of roles (operator 13).

A conversation's roles should read ``(s?(ua)+)?`` by their initials.  Rows may be kept, given another role, deleted, and
empty turns inserted; a forward Viterbi pass over four states (nothing yet, after system, after user, after assistant)
carries the least (cost, audit string) of each, and after every row the layer is closed under insertions: user from any
state, then assistant, which is all that can pay.  The audit names the state, as each letter leads to one state only, so
repaired texts have one reading, and each state carries the running digest of what it has repaired.

Conversations go as a sorted stream.  Audits of the four states are kept as a shared past and a short tail; at each
``TAIL`` rows tails are frozen into linked pieces and only their order is remembered, so work per row is constant and a
conversation of any length needs its audit's letters only.  Its digest is a chain, which no split could shorten.
Duplicates are found beforehand by a grouped minimum over digests, which combines before its shuffle.

Defined results: null roles and texts are one space; null ids and turns are one space in the damage's checksum, and a
null id is a conversation of its own; rows of one turn go by role, then text; a role's initial is its first
character, and an empty role has none; repeated rows are rows (and duplicates); gaps are held to a long's range; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table

#: What counts as white space, and what ends a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Letters of an audit's tail before it is frozen.
TAIL = 512
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Path:
    """The cheapest way into one state: cost, audit (frozen past, tail) and the digest of the rows it has made."""

    __slots__ = ("cost", "digest", "past", "tail")

    def __init__(self, cost: int, past: int, tail: str, digest) -> None:
        self.cost, self.past, self.tail, self.digest = cost, past, tail, digest


class Audits:
    """Frozen pasts, one for each state at the last freeze, and how they compare as strings."""

    def __init__(self) -> None:
        self.chains: list[tuple | None] = [None] * 4
        #: Of two pasts: (-1 or 1, "", ""), or, where one begins with the other, (0, rest of the first, rest of the second).
        self.order: dict[tuple[int, int], tuple[int, str, str]] = {}

    def compare(self, x: Path, y: Path) -> tuple[int, str, str]:
        sign, a, b = self.order[x.past, y.past] if x.past != y.past else (0, "", "")
        if sign:
            return sign, "", ""
        a, b = a + x.tail, b + y.tail
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return 0, a[n:], b[n:]
        return (-1 if a < b else 1), "", ""

    def better(self, x: Path | None, y: Path | None) -> Path | None:
        """The one of less cost; of equal costs, the one whose audit comes first (a beginning comes before its longer string)."""
        if x is None or y is None:
            return x or y
        if x.cost != y.cost:
            return x if x.cost < y.cost else y
        sign, a, _ = self.compare(x, y)
        return x if sign < 0 or not sign and not a else y

    def freeze(self, paths: list[Path | None]) -> None:
        """Each path's audit becomes a past, with an empty tail."""
        order = {(i, j): self.compare(x, y) for i, x in enumerate(paths) for j, y in enumerate(paths) if x and y and i != j}
        self.chains = [x and (self.chains[x.past], x.tail) for x in paths]
        self.order = order
        for i, x in enumerate(paths):
            if x:
                x.past, x.tail = i, ""

    def text(self, x: Path) -> str:
        parts, at = [x.tail], self.chains[x.past]
        while at:
            parts.append(at[1])
            at = at[0]
        return "".join(reversed(parts))


#: What a row that is kept, or given the role user or assistant, leads to; from which states.
INTO = {"s": (SYSTEM, (NOTHING,)), "u": (USER, (NOTHING, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}


class Repair:
    """One conversation's forward pass; ``add`` its rows in order, then read ``row``."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.audits = conv, Audits()
        self.paths: list[Path | None] = [Path(0, 0, "", hashlib.sha256()), None, None, None]
        self.close()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last, self.turns = 0, None, None, 0
        self.before: tuple | None = None

    def step(self, x: Path, state: int, cost: int, letter: str, made: tuple[str, str] | None) -> Path:
        """``x`` in ``state`` with one more edit, which makes the row ``made`` or none."""
        digest = x.digest
        if made:
            digest = digest.copy()
            digest.update(f"{'' if state == NOTHING else chr(10)}{made[0]}:{made[1]}".encode())
        return Path(x.cost + cost, x.past, x.tail + letter, digest)

    def best(self, into: Path | None, sources: tuple[int, ...], cost: int, letter: str, made: tuple[str, str]) -> Path | None:
        """``into`` or the best way from ``sources`` by one edit; only that one's row is digested."""
        found = None
        for s in sources:
            found = self.audits.better(found, x) if (x := self.paths[s]) else found
        if found is None:
            return into
        tried = Path(found.cost + cost, found.past, found.tail + letter, None)
        if self.audits.better(into, tried) is not tried:
            return into
        return self.step(found, self.paths.index(found), cost, letter, made)

    def close(self) -> None:
        """Close the layer under insertions: from an assistant, user again; nothing longer can pay."""
        self.paths[USER] = self.best(self.paths[USER], (NOTHING, SYSTEM, ASSISTANT), INSERT, "I", ("user", ""))
        self.paths[ASSISTANT] = self.best(self.paths[ASSISTANT], (USER,), INSERT, "I", ("assistant", ""))

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(BLANKS)
        same = self.before is not None and self.before == (turn, role, text)
        fault = "blank" if not bare else "duplicate" if again or same else "truncated" if bare[-1] not in ENDS else None
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.before = (turn, role, text)
        new = [x and self.step(x, i, DELETE, "D", None) for i, x in enumerate(self.paths)]
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            for initial, (state, sources) in INTO.items():
                if role[:1] == initial:
                    new[state] = self.best(new[state], sources, KEEP + extra, "K", (role, text))
                elif initial != "s":
                    new[state] = self.best(new[state], sources, REROLE + extra, "R", ("user" if initial == "u" else "assistant", text))
        self.paths = new
        self.close()
        if max(len(x.tail) for x in self.paths if x) >= TAIL:
            self.audits.freeze(self.paths)

    def row(self) -> tuple:
        end = self.audits.better(self.paths[NOTHING], self.paths[ASSISTANT])
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return self.conv, gaps, *self.faults.values(), self.illegal, end.cost, self.audits.text(end), end.digest.hexdigest()


def stream_order(rows: DataFrame) -> DataFrame:
    """Conversations whole and in order within partitions."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def seen_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: the same role and text stand on an earlier turn of the conversation.

    Only texts on two or more turns are joined back, and blank ones (which need no such mark) never."""
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), F.concat("role", "text")), 256)
    keyed = rows.withColumn("_at", at).withColumn("_key", F.when(~F.col("gone") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(key)))
    firsts = keyed.filter("_key is not null").groupBy("_key").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).filter("_first < _last")
    joined = keyed.join(firsts.select("_key", "_first"), "_key", "left")
    return joined.withColumn("again", F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))).select(*rows.columns, "again")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) to a row per conversation: faults, the cheapest repair's cost and audit, its digest.

    Rows that are ``gone`` only name their conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Repair | None = None
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [c.split()[0] for c in REPAIRED.split(", ")]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            done = []
            for conv, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = Repair(conv)
                if not gone:
                    state.add(turn, role, text, again)
            yield batch_of(done)
        if state is not None:
            yield batch_of([state.row()])

    marked = seen_earlier(rows.select("conv_id", "turn", "role", "text", "gone"))
    return stream_order(marked).mapInArrow(run, REPAIRED)


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): each conversation's rows after its audit; what is deleted is left out.

    The grammar fixes each place's role: a system row first where the repair is of odd length, then user and assistant in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, shift, now = "", 0, 0, 0, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]

            def put(edit: str, role: str | None, text: str, out=out) -> None:
                nonlocal place
                named = role if edit == "K" else ("user", "assistant")[(place + shift) % 2]
                for column, v in zip(out, (now, place, edit, named, text), strict=True):
                    column.append(v)
                place += 1

            def insert() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put("I", None, "")
                    at += 1

            for conv, role, text, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if letters is not None:
                    now, audit, at, place = conv, letters, 0, 0
                    shift = (len(audit) - audit.count("D")) % 2
                elif at < len(audit):
                    if audit[at] != "D":
                        put(audit[at], role, text)
                    at += 1
                insert()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])

    there = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    audits = repaired.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = audits.unionByName(there).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return both.select("conv_id", "role", "text", "audit").mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of their id and turn: dropped (``gone``), emptied, without sentence ends, repeated, or a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    marked = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return marked.drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, after damage."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
