"""Chat formatting with compiled templates, and reading formatted conversations back."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .templates import compile_template

#: Strings that steer a chat model; none of them stands in a formatted conversation but where the template puts it.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for turn in turns %}<|im_start|>{{ turn.role | line | escape }}{{ '\\n' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}"
)
_STARTS = {}
for _c in CONTROLS:
    _STARTS.setdefault(_c[0], []).append(re.escape(_c[1:]))
#: The first character of each control string, however they overlap, or a backslash.
_MARKED = re.compile("|".join([r"\\", *(f"{re.escape(a)}(?={'|'.join(rest)})" for a, rest in _STARTS.items())]))
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """A backslash is doubled, and one breaks up each control string after its first character."""
    return _MARKED.sub(lambda m: m[0] + "\\", text)


def line(text: str) -> str:
    """Keep a role on one line: line ends become \\v and backslash-v is told apart by a backslash before it."""
    return text.replace("\v", "\v\v").replace("\n", "\vn")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def unline(text: str) -> str:
    return re.sub("\v(.)", lambda m: "\n" if m[1] == "n" else "\v", text, flags=re.S)


FILTERS = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper}
SCHEMA = "conv_id long, n_rows long, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conv_id: the text that ``template`` makes of its turns, and the code points that a model is to learn.

    Rows go by turn, nulls first; rows of one turn (ties, repeated rows) go by role and text. A null text or role
    counts as empty, and rows without a conv_id are one conversation. An empty table gives no rows. A conversation
    streams through one task, of which it takes as much memory as its own text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    compile_template(template, FILTERS)  # a faulty template fails here

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        render = compile_template(template, FILTERS)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def batch_of(done):
            out = [render({"turns": turns}) for _, turns in done]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in out]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([len(t) for _, t in done], pa.int64()), pa.array([t for t, _ in out], pa.string()), pa.array(spans, kind)], ["conv_id", "n_rows", "formatted", "loss_spans"])

        held: list[dict] = []
        last, done, size = None, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if held and conv_id != last:
                    done.append((last, held))
                    held = []
                    if size > 8_000_000:
                        yield batch_of(done)
                        done, size = [], 0
                last = conv_id
                size += len(text)
                held.append({"role": role, "text": text})
        if held:
            done.append((last, held))
        if done:
            yield batch_of(done)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation that the standard template has formatted."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unline(unescape(m[1])), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at} on")
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A row for each row, null conv_ids too; no rows of an empty table. Very long ones are read whole."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_spans"))):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
