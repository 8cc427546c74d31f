"""Chat formatting with tool calls: link calls and results, order them, check arguments, write canonical JSON.

Everything is DataFrame operations. One table of events goes in (see :func:`format_chat`) and one row
an event comes out, so a conversation of any length is many rows and never one group. Variant
values hold the parsed arguments: their objects keep keys sorted, which makes the JSON canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common

#: Turns of one ranking window.
BLOCK_TURNS = 64
NODE = ["conv", "kind", "call_id"]


def event_rows(events: DataFrame) -> DataFrame:
    """The events with their kind and ``pos``, a total order of a conversation's events but for identical ones."""
    kind = F.when(F.col("tool").isNotNull(), "call").when(F.col("role") == "tool", "result").otherwise("message")
    own = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "after"]
    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.col(c).cast("string").alias(c) for c in own[2:-1]), F.col("after").cast("array<string>").alias("after")).withColumn("kind", kind)
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    rows = rows.withColumn("pos", F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), rank.alias("rank"), F.coalesce("call_id", F.lit("")).alias("id"), F.xxhash64(*own).alias("h")))
    return rows


def link(rows: DataFrame) -> DataFrame:
    """The first call and the first result of each identifier, hash-joined: ``conv, call_id, call_pos, result_pos``."""
    first = lambda kind, name: rows.filter((F.col("kind") == kind) & F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(F.min("pos").alias(name))
    return first("call", "call_pos").join(first("result", "result_pos").hint("shuffle_hash"), ["conv", "call_id"], "full_outer")


def edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """What must come before what, ``src`` before ``dst`` (nodes: kind, call_id), with both positions.

    A call comes before its result, and the results (or, unanswered, the calls) that it is ``after`` before the call.
    """
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("call_id"))
    own = links.filter("call_pos is not null and result_pos is not null").select("conv", node("call", "call_id").alias("src"), node("result", "call_id").alias("dst"), F.col("call_pos").alias("src_pos"), F.col("result_pos").alias("dst_pos"))
    wants = rows.filter((F.col("kind") == "call") & F.col("call_id").isNotNull()).select("conv", F.col("call_id").alias("dst_id"), F.col("pos").alias("dst_pos"), F.explode("after").alias("call_id"))
    wants = wants.join(links.filter("call_pos is not null").select("conv", F.col("call_id").alias("dst_id"), F.col("call_pos").alias("dst_pos")), ["conv", "dst_id", "dst_pos"], "left_semi")
    of = wants.join(links, ["conv", "call_id"])
    src = F.when(F.col("result_pos").isNotNull(), node("result", "call_id")).otherwise(node("call", "call_id"))
    return own.unionByName(of.select("conv", src.alias("src"), node("call", "dst_id").alias("dst"), F.coalesce("result_pos", "call_pos").alias("src_pos"), "dst_pos")).distinct()


def moved(before: DataFrame) -> DataFrame | None:
    """``conv, node, anchor, hop`` of the nodes that can't stay at their own position; None if all can.

    A node's anchor is the latest position among itself and all that must come before it; among
    nodes of one anchor ``hop`` is the longest way to it, null for nodes on or behind a cycle.
    (anchor, hop, position) is then a topological order, and it is the order of positions wherever that
    already is one: only conversations with an edge that runs backwards take part in the rounds.
    """
    backwards = before.filter("src_pos >= dst_pos").select("conv").distinct()
    if not backwards.limit(1).count():
        return None
    own = common.written(before.join(backwards, "conv", "left_semi"), "edges")
    ends = own.select("conv", F.col("src").alias("node"), F.col("src_pos").alias("anchor")).unionByName(own.select("conv", F.col("dst").alias("node"), F.col("dst_pos").alias("anchor")))
    nodes = common.written(ends.distinct(), "anchors")
    while True:
        pushed = own.join(nodes.withColumnRenamed("node", "src"), ["conv", "src"]).groupBy("conv", F.col("dst").alias("node")).agg(F.max("anchor").alias("pushed"))
        new = common.written(nodes.join(pushed, ["conv", "node"], "left").select("conv", "node", F.greatest("anchor", "pushed").alias("anchor"), (F.col("pushed") > F.col("anchor")).alias("changed")), "anchors")
        changed = new.filter("changed").limit(1).count()
        nodes = new.drop("changed")
        if not changed:
            break
    at = lambda end: nodes.select("conv", F.col("node").alias(end), F.col("anchor").alias(f"{end}_anchor"))
    tied = own.join(at("src"), ["conv", "src"]).join(at("dst"), ["conv", "dst"]).filter("src_anchor = dst_anchor").select("conv", "src", "dst")
    tied = common.written(tied, "tied")
    need = tied.groupBy("conv", F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    done = common.written(nodes.select("conv", "node").join(need, ["conv", "node"], "left_anti").withColumn("hop", F.lit(0)), "hops")
    while True:
        got = tied.join(done.withColumnRenamed("node", "src"), ["conv", "src"]).groupBy("conv", F.col("dst").alias("node")).agg(F.count("*").alias("got"), (F.max("hop") + 1).alias("hop"))
        ready = common.written(got.join(need, ["conv", "node"]).filter("got = need").join(done, ["conv", "node"], "left_anti").select("conv", "node", "hop"), "hops")
        if not ready.limit(1).count():
            break
        done = common.written(done.unionByName(ready), "hops")
    return nodes.join(done, ["conv", "node"], "left")


def schema_maps(schemas: DataFrame) -> DataFrame:
    """One row a tool: ``params``, a map from parameter to its type and whether it is required (repeated: the largest)."""
    rule = F.struct(F.col("type").cast("string").alias("type"), F.coalesce(F.col("required").cast("boolean"), F.lit(False)).alias("required"))
    each = schemas.filter("tool is not null").groupBy(F.col("tool").cast("string").alias("tool"), F.col("param").cast("string").alias("param")).agg(F.max(rule).alias("rule"))
    entries = F.sort_array(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "rule"))))
    return each.groupBy("tool").agg(F.map_from_entries(entries).alias("params"))


def json_type(value: Column) -> Column:
    """The JSON Schema name of a variant's type; whole numbers are integers however they are written."""
    kind = F.schema_of_variant(value)
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return F.when(kind == "STRING", "string").when(whole, "integer").when(kind.rlike("^(DECIMAL|DOUBLE)"), "number").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null")


def errors(args: Column, params: Column, tool: Column, kind: Column) -> Column:
    """What is wrong with a call's arguments, in the order of parameters' names; empty if nothing is."""
    fits = lambda k, v: (json_type(v) == params[k]["type"]) | ((params[k]["type"] == "number") & (json_type(v) == "integer"))
    given = F.transform(F.map_entries(args), lambda e: F.when(~F.map_contains_key(params, e["key"]), F.concat(e["key"], F.lit(": unknown"))).when(~fits(e["key"], e["value"]), F.concat(e["key"], F.lit(": not "), params[e["key"]]["type"])))
    missing = F.transform(F.map_entries(params), lambda e: F.when(e["value"]["required"] & ~F.map_contains_key(args, e["key"]), F.concat(e["key"], F.lit(": missing"))))
    found = F.when(args.isNull(), F.array(F.lit("arguments: not a JSON object"))).when(params.isNull(), F.array(F.concat(tool, F.lit(": unknown tool")))).otherwise(F.array_sort(F.array_compact(F.concat(given, missing))))
    return F.when(kind == "call", found)


def format_chat(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """Format the events of conversations, one row an event.

    ``events``: ``conv_id, turn, role, text, call_id, tool, arguments`` (JSON text), ``after`` (array of call ids). Rows
    with a tool are calls, other rows of role ``tool`` are results, the rest plain messages.
    ``schemas``: ``tool, param, type`` (JSON Schema name), ``required``.

    Returns ``conv_id, turn, kind, call_id, status, position, errors`` and ``json``. Status: a call is ``linked`` or
    ``unanswered``, a result ``linked`` or ``orphan``; later calls and results of one identifier are ``duplicate``, and
    calls and results on or behind a cycle of dependencies ``cycle``; messages have none. ``position`` counts from 0 in
    a topological order that keeps the order of turns where it can. ``errors`` (calls only) lists what
    breaks the tool's schema. ``json`` has sorted keys, no white space and no nulls.

    A null turn comes before all others; rows without conv_id are one conversation; identifiers that are null never link;
    a missing ``after`` means none, and identifiers in it that don't exist are ignored; identical rows are
    kept and numbered one after another; an empty table gives no rows; other columns are not read.
    """
    rows = common.written(event_rows(events), "events")
    links = common.written(link(rows), "links")
    order = moved(common.written(edges(rows, links), "order"))
    rows = rows.join(links, ["conv", "call_id"], "left")
    mine = F.when(F.col("kind") == "call", F.col("call_pos")).when(F.col("kind") == "result", F.col("result_pos"))
    other = F.when(F.col("kind") == "call", F.col("result_pos")).otherwise(F.col("call_pos"))
    alone = F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")
    rows = rows.withColumns({"first": mine == F.col("pos"), "status": F.when(F.col("kind") != "message", F.when(mine.isNotNull() & (mine != F.col("pos")), "duplicate").when(mine.isNull() | other.isNull(), alone).otherwise("linked"))})
    if order is None:
        rows = rows.withColumns({"anchor": F.col("pos"), "hop": F.lit(0)})
    else:
        order = order.select("conv", F.col("node.kind").alias("kind"), F.col("node.call_id").alias("call_id"), F.col("anchor").alias("to"), "hop", F.lit(True).alias("first"))
        rows = rows.join(order, ["conv", "kind", "call_id", "first"], "left")
        rows = rows.withColumns({"status": F.when(F.col("to").isNotNull() & F.col("hop").isNull(), "cycle").otherwise(F.col("status")), "anchor": F.coalesce("to", "pos"), "hop": F.when(F.col("to").isNull(), 0).otherwise(F.coalesce("hop", F.lit(2**31 - 1)))})
    rows = rows.withColumn("block", F.floor(F.col("anchor.turn") / BLOCK_TURNS))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv", "block").agg(F.count("*").alias("n")).select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv", "block").orderBy("anchor", "hop", "pos")
    rows = rows.withColumn("rn", F.row_number().over(within) - 1).join(base, ["conv", "block"])
    rows = rows.join(schema_maps(schemas), "tool", "left").withColumn("args", F.when(F.col("kind") == "call", F.from_json("arguments", "map<string,variant>")))
    checked = F.try_parse_json("arguments")
    rows = rows.withColumn("args", F.when(checked.isNotNull() & F.schema_of_variant(checked).startswith("OBJECT"), F.col("args")))
    rows = rows.withColumn("errors", errors(F.col("args"), F.col("params"), F.col("tool"), F.col("kind")))
    body = F.struct(
        F.when(F.col("args").isNotNull(), checked).alias("arguments"), "call_id", F.col("text").alias("content"),
        F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), F.when((F.col("kind") == "call") & F.col("args").isNull(), F.col("arguments")).alias("raw_arguments"), "role", "tool",
    )
    return rows.select("conv_id", "turn", "kind", "call_id", "status", (F.col("base") + F.col("rn")).cast("long").alias("position"), F.concat_ws("; ", "errors").alias("errors"), F.to_json(body).alias("json"))
