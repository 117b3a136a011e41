"""Conversations as token ids: segments encoded one by one, reserved ids between them, masks by prefix sums.

A turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``. The four control strings
are single reserved ids above the tokenizer's own, and are spliced in; no text is ever read as one.
As the formatted text shows them as strings, strings like them inside roles and texts are escaped:
a backslash is doubled, and a control string gets a backslash after its first character. Taking away
single backslashes and halving doubled ones gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.tokens import default_path, encoder

#: The control strings. Their ids follow the tokenizer's, in this order.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: The template of a turn: where it starts, where its text starts and ends, and where it ends.
START, TEXT, TEXT_END, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, position, role, formatted, ids, start, loss_start, loss_end: a row for every row of ``turns``.

    ``turns`` has conv_id, turn, role, text. Turns are taken in the order of (turn, role, text), nulls
    first, so ties and repeated rows have a defined place; each row is a turn. Null roles and texts
    are empty; rows with a null conv_id form one conversation. formatted is the turn as text, ids its
    tokens (four bytes each, least first), start the conversation's tokens before it. The tokens of
    an assistant's text, from loss_start to loss_end, are learned; other turns have both equal.
    Other columns are not read; an empty table gives an empty result.
    """
    path = path or default_path()
    kinds = dict(turns.dtypes)
    picked = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        own = encoder(path)
        control = {c: np.array([own.size + i], "<u4").tobytes() for i, c in enumerate(CONTROL)}
        for batch in batches:
            formatted, ids, before, learned = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                who, what = escape(role), escape(text)
                head = control[START] + own.encode(who) + control[TEXT]
                body = own.encode(what)
                formatted.append(START + who + TEXT + what + TEXT_END + END)
                ids.append(head + body + control[TEXT_END] + control[END])
                before.append(len(head) // 4)
                learned.append(len(body) // 4 if role == LEARNED_ROLE else 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(formatted, pa.string()), pa.array(ids, pa.binary()), pa.array(before, pa.int64()), pa.array(learned, pa.int64())],
                names=["conv_id", "turn", "role", "text", "formatted", "ids", "before", "learned"],
            )

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string, ids binary, before long, learned long"
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.expr("octet_length(ids) div 4")).over(earlier), F.lit(0))
    return (
        picked.mapInArrow(run, schema)
        .withColumn("position", F.row_number().over(order).cast("long") - 1)
        .withColumn("start", start)
        .withColumn("loss_start", F.col("start") + F.col("before"))
        .withColumn("loss_end", F.col("loss_start") + F.col("learned"))
        .select("conv_id", "position", "role", "formatted", "ids", "start", "loss_start", "loss_end")
    )


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the tokens of ``format_turns``.

    Roles and texts are cut out between the reserved ids, learned text by the mask's token positions. Turns
    pass one by one, so a conversation of any length takes the memory of one turn.
    """
    path = path or default_path()
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches):
        own = encoder(path)
        control = {c: own.size + i for i, c in enumerate(CONTROL)}
        names = dict(enumerate(CONTROL, own.size))
        state = None
        id_type = pa.int64()

        def text_of(ids: np.ndarray) -> str:
            return unescape(own.decode(ids.astype("<u4").tobytes()).decode())

        def row(states: list) -> pa.RecordBatch:
            values = [[s[0] for s in states], [s[1] for s in states], [s[2].hexdigest() for s in states], [s[3] for s in states], [s[4].hexdigest() for s in states], [s[5] for s in states]]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            labels = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=labels)

        for batch in batches:
            id_type = batch.schema.field(0).type
            done = []
            for conv, packed, start, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(packed, "<u4")
                at = np.flatnonzero(ids >= own.size)
                assert [names[i] for i in ids[at].tolist()] == [START, TEXT, TEXT_END, END]
                role, text = text_of(ids[at[0] + 1 : at[1]]), text_of(ids[at[1] + 1 : at[2]])
                learned = text_of(ids[first - start : last - start])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                plain = own.decode(ids[ids < own.size].astype("<u4").tobytes()).decode()
                state[5] += len(plain) + sum(map(len, control))
            yield row(done)
        if state is not None:
            yield row([state])

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "ids", "start", "loss_start", "loss_end").mapInArrow(run, schema)
