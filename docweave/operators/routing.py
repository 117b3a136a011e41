"""Routing rules as data: which queues a notified file goes to.

A rule is a condition and a list of destinations.  Exclusive rules are tried in order and
the first that holds wins; when none holds, every non-exclusive rule that holds applies.
Rules become one CASE expression over the segments of the key, so routing reads each
notification once and needs no join with the rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.sources.notifications import UNPROCESSED

# Fixed value: a key with this text anywhere is no data file.
CONTROL = "control"
SHORT_KEY = "short_key"
NO_KEY = "no_key"
UNPARSED = "unparsed"


def _segments(rules: Sequence[Rule]) -> int:
    """How many segments of the key the rules name, those that have names of their own included."""
    texts = [c.field for r in rules for c in r.conditions]
    templates = [t for r in rules for d in r.destinations for t in (d.table, d.file)]
    named = [int(n) for t in templates for n in re.findall(r"\{x(\d+)\}", t)]
    named += [int(t[1:]) for t in texts if re.fullmatch(r"x\d+", t)]
    return max([4, *named]) + 1


def _fields(segments: int) -> dict[str, Column]:
    """What a condition or a template may name: segments x0, x1, ... of the key, the table name inside
    segments 3 and 4 (m3, m4), both halves of segment 3 (t0, t1), sequencer and bucket ARN."""
    parts = F.col("__parts")
    segment = {i: F.get(parts, F.lit(i)) for i in range(segments)}
    return {
        **{f"x{i}": column for i, column in segment.items()},
        "m3": text.regex_part(segment[3], 1),
        "m4": text.regex_part(segment[4], 1),
        "t0": text.dot_part(segment[3], 0),
        "t1": text.dot_part(segment[3], 1),
        "sequencer": F.col("sequencer"),
        "arn": F.col("bucketArn"),
    }


@dataclass(frozen=True)
class Condition:
    """``field`` compared with any of ``values``: eq, eq_ci (values in lower case) or prefix."""

    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Destination:
    """Queue ``layer``, table and file templates such as ``{x2}-rider``, and the layer of the bookmark."""

    layer: str
    table: str
    file: str
    payload: str


@dataclass(frozen=True)
class Rule:
    name: str
    exclusive: bool
    conditions: tuple[Condition, ...]
    destinations: tuple[Destination, ...]


# The rule table, one row per rule.
RULE_TABLE = (
    "rule_order int, name string, exclusive boolean,"
    "conditions array<struct<field:string,op:string,values:array<string>>>,"
    "destinations array<struct<layer:string,table:string,file:string,payload:string>>"
)
MOST_TEXT = 2**31 - 1

# Destinations per rule, as constants inside the plan.
LISTS = (
    "array<array<struct<rule:string,data_layer:string,lead:string,table_head:int,table_tail:string,"
    "file_head:int,file_tail:string,`dataLayer`:string>>>"
)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table."""
    rows = [
        (
            order,
            rule.name,
            rule.exclusive,
            [(c.field, c.op, list(c.values)) for c in rule.conditions],
            [(d.layer, d.table, d.file, d.payload) for d in rule.destinations],
        )
        for order, rule in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_TABLE)


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table, in its order."""
    rows = table.orderBy("rule_order").collect()
    return tuple(
        Rule(
            row.name,
            row.exclusive,
            tuple(Condition(c.field, c.op, tuple(c["values"])) for c in row.conditions),
            tuple(Destination(*d) for d in row.destinations),
        )
        for row in rows
    )


def _holds(rule: Rule, fields: dict[str, Column]) -> Column:
    """The rule's condition; a missing segment makes it false."""
    result = F.lit(True)
    for condition in rule.conditions:
        value = fields[condition.field]
        match condition.op:
            case "eq":
                holds = value.isin(*condition.values)
            case "eq_ci":
                holds = F.lower(value).isin(*condition.values)
            case "prefix":
                holds = F.lit(False)
                for prefix in condition.values:
                    holds = holds | value.startswith(prefix)
            case _:
                raise ValueError(f"{rule.name}: unknown operator {condition.op!r}")
        result = result & holds
    return F.coalesce(result, F.lit(False))


def _split(template: str) -> tuple[str, str]:
    """A template up to its last field, and the constant text after that."""
    head, field, tail = template.rpartition("}")
    return head + field, tail


def _fill(template: str, fields: dict[str, Column]) -> Column:
    """The template's text, NULL when a field it names is missing."""
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(fields[part])
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def route(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per notified file and destination.

    The bookmark columns, then rule, data_layer, source, table, destKey and reason.
    ``reason`` is NULL for a good destination, or says why destKey could not be made: the
    key has too few segments, which does not affect the other destinations of the same
    file, there is no key at all, or the notification did not parse.

    A file is first given the numbers of its rules and the few texts that their templates
    are made of.  The destinations of a rule are a constant list, and each of them picks
    two of the texts, so that little runs per destination however many there are.
    """
    fields = _fields(_segments(rules))
    heads: dict[str, int] = {}

    def destination(rule: str | None, d: Destination) -> dict[str, str | int | None]:
        table_head, table_tail = _split("/" + d.table if d.table else "")
        file_head, file_tail = _split(d.file)
        return {
            "rule": rule,
            "data_layer": d.layer,
            "lead": f"bookmarks/{d.layer}/unprocessed/",
            "table_head": heads.setdefault(table_head, len(heads)),
            "table_tail": table_tail,
            "file_head": heads.setdefault(file_head, len(heads)),
            "file_tail": file_tail,
            "dataLayer": d.payload,
        }

    lists = [[destination(rule.name, d) for d in rule.destinations] for rule in rules]
    # The number after the last rule stands for a record without a key.
    lists.append([destination(None, Destination(None, "", "", None))])

    always = [
        F.when(_holds(rule, fields), F.array(F.lit(number))).otherwise(F.array().cast("array<int>"))
        for number, rule in enumerate(rules)
        if not rule.exclusive
    ]
    chosen = F.when(F.col("fileName").isNull(), F.array(F.lit(len(rules))))
    for number, rule in enumerate(rules):
        if rule.exclusive:
            chosen = chosen.when(_holds(rule, fields), F.array(F.lit(number)))
    chosen = chosen.otherwise(F.concat(*always) if always else F.array().cast("array<int>"))

    base = [c for c in records.columns if c not in ("dataLayer", "status")]
    raw = F.col("raw") if "raw" in base else F.lit(None)
    constant = F.from_json(F.lit(json.dumps(lists)), LISTS)
    texts = F.array(*[_fill(head, fields) for head in heads])
    to, source = F.col("__to"), F.col("sourceSystem")
    table_head, file_head = (F.get(F.col("__texts"), to[name]) for name in ("table_head", "file_head"))
    short = source.isNull() | table_head.isNull() | file_head.isNull()
    return (
        records.where(~F.coalesce(F.col("fileName").contains(CONTROL), F.lit(False)))
        .withColumn("__parts", text.path_segments(F.col("fileName")))
        .select(*base, texts.alias("__texts"), F.explode(chosen).alias("__rule"))
        .select(*base, "__texts", F.explode(F.get(constant, F.col("__rule"))).alias("__to"))
        .select(
            *base,
            to["dataLayer"].alias("dataLayer"),
            F.lit(UNPROCESSED).alias("status"),
            to["rule"].alias("rule"),
            to["data_layer"].alias("data_layer"),
            source.alias("source"),
            F.nullif(F.substring(F.concat(table_head, to["table_tail"]), 2, MOST_TEXT), F.lit("")).alias("table"),
            F.concat(
                to["lead"], source, table_head, to["table_tail"], F.lit("/"), file_head, to["file_tail"]
            ).alias("destKey"),
            F.when(F.col("fileName").isNull() & raw.isNotNull(), UNPARSED)
            .when(F.col("fileName").isNull(), NO_KEY)
            .when(short, SHORT_KEY)
            .alias("reason"),
        )
    )


def destinations(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reason").isNull()).drop("reason", "raw")


def quarantined(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reason").isNotNull())
