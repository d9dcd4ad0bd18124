"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(messages) -> str``. The formatter renders
successive prefixes of a conversation; where one output extends the one before,
the new part is that turn's span. Inside it, two probe texts that differ in
every character show how much of the span is the template's head and tail. An
output that does not extend the one before shows a template that rewrites
history; such conversations get ``rewrites`` and no loss spans.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<role:string,start:int,end:int,body_start:int,body_end:int,loss:boolean>>"


class TurnTemplate:
    r"""``### Role: text</turn>\n`` for each turn.

    Inside texts and unknown role names ``\``, ``#`` and ``</`` are written
    ``\\``, ``\#`` and ``<\/``; so neither ``###`` nor ``</turn>`` can appear
    there, and dropping each escaping backslash restores the text.
    """

    #: How the known roles are written.
    NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
    TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*?)</turn>\n", re.S)

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def name(self, role: str) -> str:
        return self.NAMES.get(role) or "role=" + self.escape(role).replace(":", "\\:")

    def render(self, messages: list[tuple[str, str]]) -> str:
        return "".join(f"### {self.name(role)}: {self.escape(text)}</turn>\n" for role, text in messages)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns read back from an output of ``render``."""
        back = {v: k for k, v in self.NAMES.items()}
        return [(back.get(m[1]) or self.unescape(m[1].removeprefix("role=")), self.unescape(m[2])) for m in self.TURN.finditer(formatted)]


def _common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def render_spans(template, messages: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[dict], bool]:
    """(output, a span per turn, whether some prefix's output was rewritten by a later turn)."""
    before, spans, rewrites = template.render([]), [], False
    for k, (role, _) in enumerate(messages):
        after = template.render(messages[: k + 1])
        if not after.startswith(before):
            rewrites = True
            before = after
            spans.append({"role": role, "start": None, "end": None, "body_start": None, "body_end": None, "loss": False})
            continue
        at = len(before)
        one, two = (template.render([*messages[:k], (role, probe)]) for probe in ("a", "b"))
        head = _common_prefix(one, two) - at  # the template's part before the text in this turn
        tail = len(one) - at - head - 1
        spans.append({"role": role, "start": at, "end": len(after), "body_start": at + head, "body_end": len(after) - tail, "loss": role in loss_roles})
        before = after
    if rewrites:
        for s in spans:
            s["loss"] = False
    return before, spans, rewrites


def format_conversations(conversations: DataFrame, make_template: Callable[[], object] = TurnTemplate, loss_roles: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrites.

    Rows go by turn (ties by role, then text; null turns first). A null text or
    role is empty; null conv_ids are one conversation. Repeated rows stay. An
    empty table gives no rows. A conversation is one output string, so its turns
    meet in one row.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = conversations.groupBy("conv_id").agg(turns.alias("turns"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = make_template()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [render_spans(template, [(t["role"], t["text"]) for t in row], loss_roles) for row in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], _SPANS), pa.array([o[2] for o in out], pa.bool_())], ["conv_id", "formatted", "spans", "rewrites"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(render, f"conv_id {kind}, formatted string, spans {SPAN_TYPE}, rewrites boolean")


_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("body_start", pa.int32()), ("body_end", pa.int32()), ("loss", pa.bool_())]))


def digest_formatted(formatted: DataFrame, make_template: Callable[[], TurnTemplate] = TurnTemplate) -> DataFrame:
    """What can be read back from formatted conversations: turns by parsing, loss text by the spans under the mask."""
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = make_template()
        for f in frames:
            rows = []
            for conv, text, spans in zip(f["conv_id"], f["formatted"], f["spans"]):
                turns = template.parse(text)
                loss = "".join(template.unescape(text[s["body_start"] : s["body_end"]]) for s in spans if s["loss"])
                rows.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "spans").mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
