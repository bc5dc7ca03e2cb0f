"""Chat formatting with schema fingerprints.

1. Every record is JSON text (or columns turned into it). The set of its nested field paths, `messages[].role` say, is
   hashed to a fingerprint; nulls, empty lists and empty objects count as absent. The fingerprint selects a declared
   layout, a plain table of where roles and texts are, and so records of prompt, instruction and message layouts become
   canonical turns (role, text). Each layout is listed under the fingerprints of all its optional fields.
2. Every turn is written as one piece of the template, `<s>[INST] role [/INST] text </s>` and a line feed. A backslash
   is put behind every backslash in a role or text, and behind the first character of every control string there, so no
   control string of a text survives and removing them gives the text back exactly.
3. The loss mask is a span of code points in the piece: the text of an assistant's turn.

Pieces are ordered by (id, order, record, at) and never gathered: a conversation of any length is a run of sorted rows,
and whoever reads it back streams them. Only its digests are made by one task, in memory that doesn't grow.

A null text or role is empty, null ids make one conversation, null orders come first, equal orders are ordered by the
record's content, repeated rows stay. An empty table has no conversations. Other columns, whatever their names, are not
read. A record of an unknown layout keeps its row with null layout and turns; `unmapped` counts them by fingerprint.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map

# Layouts. A turn's role is a path, or a fixed role after "="; its text is a path or several, joined by a blank line.
# "each" repeats the turn for the items of a list. "roles" renames roles. Optional paths may be absent.
LAYOUTS = [
    {
        "name": "turn",
        "required": [],
        "optional": ["turn", "role", "text"],
        "turns": [{"role": "role", "text": ["text"]}],
    },
    {
        "name": "prompt",
        "required": ["prompt", "response"],
        "optional": ["system"],
        "turns": [
            {"role": "=system", "text": ["system"], "if": "system"},
            {"role": "=user", "text": ["prompt"]},
            {"role": "=assistant", "text": ["response"]},
        ],
    },
    {
        "name": "completion",
        "required": ["prompt", "completion"],
        "optional": ["system"],
        "turns": [
            {"role": "=system", "text": ["system"], "if": "system"},
            {"role": "=user", "text": ["prompt"]},
            {"role": "=assistant", "text": ["completion"]},
        ],
    },
    {
        "name": "instruction",
        "required": ["instruction", "output"],
        "optional": ["input", "system"],
        "turns": [
            {"role": "=system", "text": ["system"], "if": "system"},
            {"role": "=user", "text": ["instruction", "input"]},
            {"role": "=assistant", "text": ["output"]},
        ],
    },
    {
        "name": "messages",
        "required": ["messages[].role"],
        "optional": ["messages[].content", "messages[].content[].type", "messages[].content[].text", "messages[].name", "system"],
        "turns": [
            {"role": "=system", "text": ["system"], "if": "system"},
            {"each": "messages", "role": "role", "text": ["content"]},
        ],
    },
    {
        "name": "conversations",
        "required": ["conversations[].from", "conversations[].value"],
        "optional": ["system"],
        "roles": {"human": "user", "gpt": "assistant"},
        "turns": [
            {"role": "=system", "text": ["system"], "if": "system"},
            {"each": "conversations", "role": "from", "text": ["value"]},
        ],
    },
    {
        "name": "dialog",
        "required": ["dialog.turns[].speaker", "dialog.turns[].utterance"],
        "optional": ["dialog.system"],
        "roles": {"customer": "user", "agent": "assistant"},
        "turns": [
            {"role": "=system", "text": ["dialog.system"], "if": "dialog.system"},
            {"each": "dialog.turns", "role": "speaker", "text": ["utterance"]},
        ],
    },
]

# control strings of the template
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPED = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
PIECE = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?) </s>\n", re.DOTALL)
ADDED = re.compile(r"\\(\\?)")
LOSS_ROLE = "assistant"
TURNS = "array<struct<role: string, text: string>>"


def paths(value, prefix: str = "") -> set[str]:
    """Paths of all values present in a JSON value; list items share `[]`."""
    if isinstance(value, dict):
        inner = [(f"{prefix}.{k}" if prefix else k, v) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(f"{prefix}[]", v) for v in value]
    else:
        return set() if value is None else {prefix}
    return set().union(*(paths(v, p) for p, v in inner))


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def layout_table(layouts: list[dict]) -> dict[str, dict]:
    """Fingerprint -> layout, for every choice of optional paths."""
    table: dict[str, dict] = {}
    for layout in layouts:
        for n in range(len(layout["optional"]) + 1):
            for chosen in combinations(layout["optional"], n):
                known = table.setdefault(fingerprint({*layout["required"], *chosen}), layout)
                if known is not layout:
                    raise ValueError(f"layouts {known['name']} and {layout['name']} share the paths of one record")
    return table


def at_path(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def as_text(value) -> str:
    """Strings as they are, lists of parts joined, other values as JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "".join(as_text(x.get("text") if isinstance(x, dict) else x) for x in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: dict, layout: dict) -> list[dict]:
    out = []
    renamed = layout.get("roles", {})
    for rule in layout["turns"]:
        if at_path(record, rule["if"]) is None if "if" in rule else False:
            continue
        for item in at_path(record, rule["each"]) or [] if "each" in rule else [record]:
            role = rule["role"][1:] if rule["role"][0] == "=" else as_text(at_path(item, rule["role"]))
            texts = [as_text(at_path(item, path)) for path in rule["text"]]
            text = texts[0] if len(texts) == 1 else "\n\n".join(filter(None, texts))
            out.append({"role": renamed.get(role, role), "text": text})
    return out


def canonical(records: DataFrame, *, id_column: str, order: Column, record: Column, layouts: list[dict] | None = None) -> DataFrame:
    """(id, order, tie, copy, fingerprint, layout, turns) of every record; `record` is its JSON text.

    tie orders records of one place by content, copy keeps the turns of repeated records together.
    """
    table = layout_table(LAYOUTS if layouts is None else layouts)
    rows = records.select(
        F.col(id_column).alias("id"),
        order.alias("order"),
        F.md5(F.coalesce(record, F.lit("")).cast("binary")).alias("tie"),
        F.monotonically_increasing_id().alias("copy"),
        F.coalesce(record, F.lit("{}")).alias("record"),
    )
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "order", "tie", "copy"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[frozenset, str] = {}
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            marks, names, turns = [], [], []
            for text in batch.column(4).to_pylist():
                record = json.loads(text)
                found = frozenset(paths(record))
                if found not in hashes:
                    hashes[found] = fingerprint(found)
                layout = table.get(hashes[found])
                marks.append(hashes[found])
                names.append(layout and layout["name"])
                turns.append(layout and turns_of(record, layout))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(marks, pa.string()), pa.array(names, pa.string()), pa.array(turns, kind)],
                names=["id", "order", "tie", "copy", "fingerprint", "layout", "turns"],
            )

    return arrow_map(rows, read, f"{kinds}, fingerprint string, layout string, turns {TURNS}")


def unmapped(records: DataFrame) -> DataFrame:
    """Fingerprints without a layout and their records, of `canonical`."""
    return records.where("layout IS NULL").groupBy("fingerprint").count()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1\\\\")


def unescape(text: str) -> str:
    return ADDED.sub(r"\1", text)


def formatted(records: DataFrame) -> DataFrame:
    """(id, order, tie, copy, at, piece, loss_start, loss_end): one piece of the template for each turn of `canonical`.

    Joined in order, the pieces of an id are its formatted conversation. The span counts code points from the piece's
    start and is null where the turn has no loss.
    """
    turns = records.select("id", "order", "tie", "copy", F.posexplode("turns").alias("at", "turn"))
    role, text = escaped(F.col("turn.role")), escaped(F.col("turn.text"))
    head = F.concat(F.lit("<s>[INST] "), role, F.lit(" [/INST] "))
    out = turns.select("id", "order", "tie", "copy", "at", "turn.role", head.alias("head"), text.alias("body"))
    loss = F.col("role") == LOSS_ROLE
    return out.select(
        "id",
        "order",
        "tie",
        "copy",
        "at",
        F.concat("head", "body", F.lit(" </s>\n")).alias("piece"),
        F.when(loss, F.length("head")).alias("loss_start"),
        F.when(loss, F.length("head") + F.length("body")).alias("loss_end"),
    )


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Reading:
    """What was read back of one conversation so far."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        match = PIECE.fullmatch(piece)
        if match is None:
            raise ValueError("a piece doesn't follow the template")
        role, text = map(unescape, match.groups())
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(piece)
        if start is not None:
            under = unescape(piece[start:end])
            self.loss.update(under.encode())
            self.loss_chars += len(under)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(pieces: DataFrame) -> DataFrame:
    """id and DIGESTS of every conversation, from the pieces alone: sorted rows are streamed, none are gathered."""
    kind = pieces.schema["id"].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in DIGESTS.split(", "))]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, reading, done, id_type = nothing, None, [], None

        def flush():
            columns = list(zip(*done)) if done else [[] for _ in names]
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if current is nothing or i != current:
                    if current is not nothing:
                        done.append((current, *reading.row()))
                    current, reading = i, Reading()
                reading.add(piece, start, end)
            if done:
                yield flush()
        if current is not nothing:
            done.append((current, *reading.row()))
            yield flush()

    rows = pieces.repartition("id").sortWithinPartitions("id", F.col("order").asc_nulls_first(), "tie", "copy", "at")
    return arrow_map(rows.select("id", "piece", "loss_start", "loss_end"), stream, f"id {kind}, {DIGESTS}")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """conv_id and DIGESTS of a table of turns (conv_id, turn, role, text), formatted and read back."""
    turns = canonical(
        conversations, id_column="conv_id", order=F.col("turn"), record=F.to_json(F.struct("turn", "role", "text"))
    )
    return read_back(formatted(turns)).withColumnRenamed("id", "conv_id")
