"""Operator 3: chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths (array steps as []); it selects a declarative mapping that lists where
roles and texts are. A fingerprint that no mapping lists, such as one with a field more, selects the mapping with most required paths among those whose required paths it all has. Canonical turns are then written by one template,

    ### role: text </turn>

where control strings inside roles and texts are escaped reversibly, and the loss mask covers assistant texts. Turns of a conversation are
formatted and read back as a stream in turn order, so a conversation of any length needs the memory of one turn.

Defined cases: a null role or text is empty; a null turn comes before others, equal turns by role, then text; repeated rows are turns each; a null
conv_id is a conversation of its own; a record that no mapping fits has no turns (`unmapped` lists such records), but in formatted text it is one turn of the role `unmapped`
with the record as its text, so none is lost; texts of any length are written whole; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURNS = "conv_id long, place long, role string, text string"
SEGMENTS = "conv_id long, segment string, loss_start int, loss_length int"


@dataclass(frozen=True)
class Mapping:
    """Where turns are. `turns`: fixed (role, path) pairs; or `each`: the array of messages with its role and text keys; or `row`: one turn a record."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


#: Layouts known by default; `format_records` takes others.
MAPPINGS = (
    Mapping("row", ("role", "text", "turn"), ("conv_id",), row=("turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "messages[].name"), each=("messages", "role", "content")),
    Mapping("dialogue", ("conversations[].from", "conversations[].value"), ("id", "system"), turns=(("system", "system"),), each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", ("prompt", "completion"), ("system", "id"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("nested", ("prompt.text", "response.text"), ("prompt.system", "id"), turns=(("system", "prompt.system"), ("user", "prompt.text"), ("assistant", "response.text"))),
    Mapping("question", ("question", "answer"), ("context", "id"), turns=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
)


def paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves; an empty array or object is a leaf itself."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint to mapping, for each choice of a mapping's optional paths."""
    return {fingerprint({*m.required, *some}): m for m in mappings for k in range(len(m.optional) + 1) for some in combinations(m.optional, k)}


def mapping_of(found: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping with most required paths among those whose required paths are all there; None if there is none, or two."""
    fit = sorted((m for m in mappings if {*m.required} <= found), key=lambda m: -len(m.required))
    return fit[0] if fit and (len(fit) == 1 or len(fit[0].required) > len(fit[1].required)) else None


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(x: object) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)


def canonical(record: dict, m: Mapping) -> list[tuple[int | None, str, str]]:
    """(place, role, text) of each turn."""
    if m.row:
        place, role, text = (_get(record, k) for k in m.row)
        return [(place, m.roles.get(_text(role), _text(role)), _text(text))]
    out = [(role, _text(x)) for role, path in m.turns if (x := _get(record, path)) not in (None, "") or role in ("user", "assistant") and path in m.required]
    if m.each:
        array, role, text = m.each
        out += [(m.roles.get(r := _text(x.get(role)), r), _text(x.get(text))) for x in _get(record, array)]
    return [(i, *x) for i, x in enumerate(out)]


def _turns(mappings: tuple[Mapping, ...], keep_unmapped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                record = _loads(text)
                m = None
                if isinstance(record, dict):
                    found = paths(record)
                    name = fingerprint(found)
                    if name not in known and len(known) < 100_000:
                        known[name] = mapping_of(found, mappings)
                    m = known[name] if name in known else mapping_of(found, mappings)
                if m:
                    rows += [(conv, *t) for t in canonical(record, m)]
                elif keep_unmapped:
                    rows.append((conv, 0, "unmapped", text or ""))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "role", "text"])

    return run


def _loads(text: str | None) -> object:
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


def _prints(mappings: tuple[Mapping, ...]):
    """The records that no mapping fits, with their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        for batch in batches:
            prints, keep = [], []
            for text in batch.column("record").to_pylist():
                record = _loads(text)
                found = paths(record) if isinstance(record, dict) else None
                prints.append(None if found is None else fingerprint(found))
                keep.append(found is None or (prints[-1] not in known and mapping_of(found, mappings) is None))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("record"), pa.array(prints, pa.string())], ["conv_id", "record", "fingerprint"]).filter(pa.array(keep, pa.bool_()))

    return run


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, record and fingerprint of the records that no mapping fits; a null fingerprint marks what is no JSON object."""
    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")).mapInArrow(_prints(mappings), "conv_id long, record string, fingerprint string")


def turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, keep_unmapped: bool = False) -> DataFrame:
    """Canonical turns (TURNS) of `records`: conv_id and record, a JSON text. With keep_unmapped, a record that no mapping fits is one turn of that role."""
    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")).mapInArrow(_turns(mappings, keep_unmapped), TURNS)


#: What stands for a control string inside roles and texts.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
_ESCAPED = re.compile(r"\\([\\hec])")
_BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ": "}


def escape(text: str, role: bool = False) -> str:
    for k, v in ESCAPES.items():
        text = text.replace(k, v)
    return text.replace(": ", "\\c") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, with the start and length of its text."""
    head, body = f"### {escape(role, role=True)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(body)


_TURN = re.compile(r"### (.*?): (.*?) </turn>\n", re.DOTALL)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*written(r, t), r) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        segment, start, length, role = zip(*rows, strict=True) if rows else ((), (), (), ())
        length = [n if r == "assistant" else 0 for n, r in zip(length, role, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(segment, pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32())], ["conv_id", "segment", "loss_start", "loss_length"])


def format_turns(found: DataFrame) -> DataFrame:
    """Segments of `found` (turns): a conversation's segments, one after another, are its formatted text. They lie in one partition, in order; loss_length is 0 without loss."""
    filled = found.select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text").mapInArrow(_format, SEGMENTS)


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    return format_turns(turns(records, mappings, keep_unmapped=True))


class _Reader:
    """Digests of one conversation, read back from its segments."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.n, self.loss, self.chars, self.rest = conv, 0, 0, 0, ""
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def take(self, segment: str, start: int, length: int) -> None:
        under = unescape(segment[start : start + length])
        self.loss, self.chars, self.rest = self.loss + len(under), self.chars + len(segment), self.rest + segment
        self.learned.update(under.encode())
        at = 0
        for m in _TURN.finditer(self.rest):
            self.n, at = self.n + 1, m.end()
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        return self.conv, self.n, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST.split(", ")]
    reader = None
    for batch in batches:
        done = []
        for conv, *segment in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
            if reader is None or reader.conv != conv:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv)
            reader.take(*segment)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(reader.row(), kinds, strict=True)], names)


def digest(segments: DataFrame) -> DataFrame:
    """What is read back from the output of `format_turns` (its partitions and order are used as they are)."""
    return segments.mapInArrow(_read, DIGEST)


PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("x"))
    rows = rows.unionByName(probe.select("conv_id", "x.turn", "x.role", F.lit(PROBE).alias("text")))
    return digest(format_records(rows.select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS n,
         length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) AS m FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + m + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
