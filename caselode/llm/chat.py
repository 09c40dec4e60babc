"""Chat formatting by schema fingerprints (operator 7).

A record's nested field paths, sorted and hashed, are its fingerprint; the fingerprint selects a declarative mapping
that says where roles and texts lie.  Prompt, instruction and message layouts all become canonical turns (role, text).
Turns are then formatted one by one: markers around texts in which every control string is escaped reversibly.  Turns
are formatted where they lie; only reading back needs a conversation's turns in order, as a stream, so that a
conversation of any length never has to fit in memory.

Defined results: a null text is empty; a null role is ``user``; turns with the same number go by role, then text; an
unknown fingerprint, a record that isn't a JSON object or an empty one gives no turns (``unmapped`` lists them);
extra fields change the fingerprint unless the mapping names them optional.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written

#: Layouts: where turns are found, as (list path or None, role path or fixed role, text path), optional extra fields.
LAYOUTS: dict[str, dict] = {
    "turn": {"turns": [(None, ".role", ".text")]},
    "role_content": {"turns": [(None, ".role", ".content")]},
    "messages": {"roles": "named", "turns": [("messages", ".role", ".content")]},
    "messages_text": {"roles": "named", "turns": [("messages", ".role", ".text")]},
    "from_value": {"roles": "named", "turns": [("conversations", ".from", ".value")]},
    "prompt_completion": {"turns": [(None, "user", ".prompt"), (None, "assistant", ".completion")]},
    "prompt_response": {"turns": [(None, "user", ".prompt"), (None, "assistant", ".response")]},
    "system_prompt_response": {"turns": [(None, "system", ".system"), (None, "user", ".prompt"), (None, "assistant", ".response")]},
    "question_answer": {"turns": [(None, "user", ".question"), (None, "assistant", ".answer")]},
    "instruction_output": {"turns": [(None, "user", ".instruction"), (None, "assistant", ".output")]},
    "instruction_input_output": {"turns": [(None, "user", ".instruction+.input"), (None, "assistant", ".output")]},
}
#: Other names of roles, in the layouts whose roles are "named"; the rest keep roles as given.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
OPTIONAL = ("id", "source", "metadata")
#: Strings that act as control in this or other chat templates; a backslash goes after their first character.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
TURNS = "conv_id long, turn long, part int, role string, text string"


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths; the items of a list share the path ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if not (at == "" and k in OPTIONAL) for p in field_paths(v, f"{at}.{k}")}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def _layout_paths(layout: dict) -> set[str]:
    return {(f".{where}[]" if where else "") + p for where, role, text in layout["turns"] for path in (role, text) if path.startswith(".") for p in path.split("+")}


MAPPINGS = {fingerprint(_layout_paths(x)): x for x in LAYOUTS.values()}


def canonical_turns(record: dict) -> list[tuple[str, str]] | None:
    """The record's turns by the mapping its fingerprint selects; None where there is none."""
    layout = MAPPINGS.get(fingerprint(field_paths(record)))
    if layout is None:
        return None

    def value(item: dict, path: str) -> str:
        if not path.startswith("."):
            return path
        found = [item.get(p[1:]) for p in path.split("+")]
        return "\n".join(str(v) for i, v in enumerate(found) if i == 0 and v is not None or v)

    out = []
    for where, role, text in layout["turns"]:
        for item in record[where] if where else [record]:
            name = "user" if role.startswith(".") and item.get(role[1:]) is None else value(item, role)
            out.append((ROLES.get(name, name) if layout.get("roles") else name, value(item, text)))
    return out


def to_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, record as JSON) to canonical turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, turn, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    parsed = json.loads(record.as_py() or "null")
                except ValueError:
                    parsed = None
                for i, (role, text) in enumerate((canonical_turns(parsed) if isinstance(parsed, dict) else None) or []):
                    for column, v in zip(out, (conv, turn, i, role, text), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["conv_id", "turn", "part", "role", "text"])

    return records.select("conv_id", "turn", "record").mapInArrow(run, TURNS)


def unmapped(records: DataFrame) -> DataFrame:
    """Records that give no turns."""
    return records.join(to_turns(records).select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the part of it that holds the escaped text."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    head, _, rest = formatted.partition("|>\n")
    return unescape(head.removeprefix("<|")), unescape(rest.removesuffix("<|end|>\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, formatted, loss_start, loss_end): the loss covers assistant texts; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t) + (r,) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            loss = [[m[i] if m[3] == "assistant" else None for m in made] for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([m[0] for m in made], pa.string()), *(pa.array(x, pa.int64()) for x in loss)], names=["conv_id", "turn", "part", "formatted", "loss_start", "loss_end"])

    return turns.mapInArrow(run, "conv_id long, turn long, part int, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns read back as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def row() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            out = []
            for conv, text, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = text.as_py()
                role, said = parse_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if lo is not None:
                    part = unescape(formatted[lo:hi])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(formatted)
            yield batch_of(out)
        if state is not None:
            yield batch_of([row()])

    # Turns of one number go by role and text as they were, before escapes.
    plain = lambda c: F.regexp_replace(c, _UNESCAPE.pattern, "")
    role = plain(F.substring(F.substring_index("formatted", "|>\n", 1), 3, 1 << 30))
    text = plain(F.regexp_extract("formatted", r"(?s)^.*?\|>\n(.*)<\|end\|>\n$", 1))
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", role, text)
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the conversation -1 of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    records = rows.select("conv_id", "turn", F.to_json(F.struct(F.coalesce("role", F.lit("user")).alias("role"), "text")).alias("record"))
    # A record of another layout: both turns in one.
    more = spark.sql("select -1L conv_id, 0L turn, to_json(struct(t.said as prompt, t.said as completion)) record from values ('</s>[INST] ok [/INST]') as t(said)")
    records = records.unionByName(more)
    return digests(written(format_turns(to_turns(records)), "chat"))
