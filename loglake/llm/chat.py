"""Chat formatting by event-sourced reconstruction.

A log has one row an event: conversation, sequence, kind, turn, role, text. Rows are partitioned by conversation, sorted by sequence and folded, one
conversation after the other in a stream, into final messages that are rendered through a template:

* ``message``: opens turn ``turn`` with ``role`` and ``text`` (a turn that is open already is replaced, with all that follow it);
* ``delta``: appends ``text`` to the turn (opens it, if its start got lost);
* ``edit``: replaces the turn's text; later turns answered the old text and go;
* ``regenerate``: empties the turn for new deltas; later turns go;
* anything else, and an event without a turn: no effect.

The template marks turns by ``### <role>: `` and ``</turn>``. Control strings within a role or text get a backslash, and so does a backslash, so that the
formatted text can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.shared import ship

OPEN, END = "### ", "</turn>"
#: What may stand in the way of reading back.
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
TOKENS = re.compile(r"\\(\\|###|</turn>|:)|(</turn>\n)")
EVENT = "conv_id bigint, seq bigint, part bigint, kind string, turn bigint, role string, text string"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", lambda m: m[1], text)


def render(messages: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{escape(role, ROLE_CONTROL)}: {escape(text)}{END}\n" for role, text in messages)


def turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """Role, and start and end of the (escaped) text, of each turn of a formatted conversation."""
    at = 0
    for m in TOKENS.finditer(formatted):
        if m[2]:
            colon = at + len(OPEN)
            while formatted[colon] != ":":
                colon += 2 if formatted[colon] == "\\" and formatted[colon + 1] in "\\:" else 1
            yield unescape(formatted[at + len(OPEN) : colon]), colon + 2, m.start()
            at = m.end()


def loss_spans(formatted: str, learned: str = "assistant") -> list[tuple[int, int]]:
    """Spans of the formatted text that a model is trained on: the texts of ``learned``'s turns."""
    return [(a, b) for role, a, b in turns(formatted) if role == learned]


class Fold:
    """Messages of one conversation, as the events come; texts are lists of deltas until they are read.

    Turns are kept in order, so that what an event takes back is cut from the end: each turn is put in and taken out once.
    """

    def __init__(self) -> None:
        self.messages: dict = {}
        self.order: list = []

    def put(self, turn, role: str, parts: list[str]) -> None:
        if turn not in self.messages:
            insort(self.order, turn)
        self.messages[turn] = (role, parts)

    def take(self, kind: str, turn, role: str, text: str) -> None:
        if turn is None or kind not in KINDS:
            return
        known = self.messages.get(turn)
        if kind == "delta":
            if known is None:
                self.put(turn, role, [text])
            else:
                known[1].append(text)
            return
        while self.order and self.order[-1] > turn:
            del self.messages[self.order.pop()]
        if kind == "message":
            self.put(turn, role, [text])
        elif known is not None:
            self.put(turn, known[0], [text] if kind == "edit" else [])

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in (self.messages[t] for t in self.order)]


def format_log(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_starts, loss_ends`` of every conversation of an event log with the columns of ``EVENT``.

    Events are folded by (seq, part); ties are folded by kind, turn, role and text. Null roles and texts count as empty; null conversations are one
    conversation. A conversation whose events leave no message has an empty text; no events, no rows. Further columns are not read.
    """
    ship(events.sparkSession)
    order = ["seq", "part", "kind", "turn", "role", "text"]
    rows = events.select("conv_id", *order).repartition("conv_id").sortWithinPartitions("conv_id", *order).select(F.col("conv_id").cast("string"), "kind", F.col("turn").cast("string"), "role", "text")

    def done(key, fold: Fold):
        formatted = render(fold.final())
        spans = loss_spans(formatted)
        return key, formatted, [a for a, _ in spans], [b for _, b in spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "formatted", "loss_starts", "loss_ends"]
        key, fold, out, size = None, None, [], 0
        for batch in batches:
            values = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("conv_id", "kind", "turn", "role", "text")]
            for conv, kind, turn, role, text in zip(*values, strict=True):
                if fold is None or conv != key:
                    if fold is not None:
                        out.append(done(key, fold))
                        size += len(out[-1][1])
                    key, fold = conv, Fold()
                fold.take(kind, None if turn is None else int(turn), role or "", text or "")
            if size > 1 << 22:
                yield pd.DataFrame(out, columns=columns)
                out, size = [], 0
        if fold is not None:
            out.append(done(key, fold))
        if out:
            yield pd.DataFrame(out, columns=columns)

    folded = rows.mapInPandas(run, "conv_id string, formatted string, loss_starts array<int>, loss_ends array<int>")
    return folded.withColumn("conv_id", F.col("conv_id").cast("bigint"))


def log_of(conversations: DataFrame, delta_chars: int = 2048) -> DataFrame:
    """The event log of a table of rows (conv_id, turn, role, text), as a chat service would have written it.

    A row is a ``message`` and, where it is long, ``delta`` events of ``delta_chars``. By a hash of conversation and turn, a quarter of the rows come
    first as a draft that is regenerated and streamed anew, and a quarter as a draft with an answer, both of which an ``edit`` takes back. The fold of the
    log is the table. Rows of a conversation are ordered by turn, then role and text, and are a turn each, so repeated rows stay. Null texts and roles are
    empty, null conversations are one conversation, no rows give no events.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    kept = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    placed = kept.withColumn("turn", at.cast("bigint")).withColumn("way", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    parts = F.greatest(F.lit(1), F.ceil(F.char_length("text") / delta_chars)).cast("int")

    def event(part, kind, turn, said):
        return F.struct(part.cast("bigint").alias("part"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), turn.alias("turn"), said.alias("text"))

    def chunks(first: str):
        """The text in pieces: the first as ``first``, deltas after it."""
        kind = lambda k: F.when(k == 0, F.lit(first)).otherwise(F.lit("delta"))
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: event(k, kind(k), F.col("turn"), F.substring(F.col("text"), k * delta_chars + 1, F.lit(delta_chars))))

    draft = event(F.lit(-3), "message", F.col("turn"), F.concat(F.lit("draft of "), F.col("role")))
    again = F.array(draft, event(F.lit(-2), "regenerate", F.col("turn"), F.lit("")))
    answered = F.array(draft, event(F.lit(-2), "message", F.col("turn") + 1, F.lit("taken back")))
    events = F.when(F.col("way") == 1, F.concat(again, chunks("delta"))).when(F.col("way") == 2, F.concat(answered, chunks("edit"))).otherwise(chunks("message"))
    made = placed.select("conv_id", F.col("turn").alias("seq"), "role", F.explode(events).alias("e"))
    return made.select("conv_id", "seq", "e.part", "e.kind", "e.turn", "role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, starts, ends in zip(batch["conv_id"], batch["formatted"], batch["loss_starts"], batch["loss_ends"], strict=True):
                read = [(role, unescape(text[a:b])) for role, a, b in turns(text)]
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                said = "".join(f"{role}\n{said}\n" for role, said in read)
                out.append((key, len(read), sha(said), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    keyed = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))  # pandas would turn a column with a null into floats
    return keyed.mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumn("conv_id", F.col("conv_id").cast("bigint"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
