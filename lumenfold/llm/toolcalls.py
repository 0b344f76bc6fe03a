"""Tool-call linking for chat data [DataFrame operators only].

Calls and results meet in one hash join on (conv_id, call_id), each side first reduced to one row
an identifier. Arguments are checked against a schema for each tool on their parsed form, and
calls are written as canonical JSON: keys in order, no blanks, text unescaped beyond what JSON asks.

Order: a call comes after the calls that its arguments refer to; its level is the length of the
longest chain of references behind it, and calls on a cycle, and those behind one, get a null level.

Defined results: of several calls or results with one identifier the first by turn, then by text, counts
and `copies` tells how many there were; a result without its call is `orphan`, a call without a
result `no_result`; arguments that are null or not JSON have the error `not_json`; null
identifiers never link: with keep_null each such call is a row `no_result` without level and each
such result a row `orphan`, else they are left out; an empty table gives no rows; further columns
stay out of the result; an argument text of any length is parsed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, drop_cut, table

#: tool -> argument -> (type names of schema_of_variant, required)
Schema = dict[str, dict[str, tuple[tuple[str, ...], bool]]]
REPLY: Schema = {"reply": {"after": (("STRING",), False), "prompt": (("STRING",), True), "turn": (("BIGINT",), True)}}


def argument_errors(tool, args, schema: Schema) -> F.Column:
    """Sorted names of what is wrong with a call's arguments."""
    parsed = F.try_parse_json(args)
    found = F.when(parsed.isNull(), F.array(F.lit("not_json")))
    for name, fields in schema.items():
        checks = [F.transform(F.array_except(F.coalesce(F.json_object_keys(args), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in fields])), lambda k: F.concat(F.lit("unknown:"), k))]
        for field, (kinds, required) in fields.items():
            value = F.variant_get(parsed, f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            missing = F.when(value.isNull(), F.array(F.lit(f"missing:{field}"))) if required else F.lit(None).cast("array<string>")
            wrong = F.when(value.isNotNull() & ~kind.isin(*kinds), F.array(F.lit(f"type:{field}")))
            checks.append(F.coalesce(missing, wrong, F.array().cast("array<string>")))
        found = found.when(tool == name, F.sort_array(F.concat(*checks)))
    return found.otherwise(F.array(F.lit("unknown_tool")))


def canonical(**fields) -> F.Column:
    """A JSON object of the given columns, keys in order; null fields are left out, variants keep their own keys in order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]))


def first_by_id(rows: DataFrame, *more: str) -> DataFrame:
    keep = F.min(F.struct("turn", *more)).alias("x")
    return rows.where("call_id is not null").groupBy("conv_id", "call_id").agg(keep, F.count("*").alias("copies")).select("conv_id", "call_id", "x.*", "copies")


def levels(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls: 0 without a reference to a known call, else one more than the highest call referred to.

    refs has conv_id, call_id, ref. Where no call has two references, chains are followed by doubling
    steps, so their length costs its logarithm in joins; otherwise calls are peeled level by level.
    """
    calls = calls.select("conv_id", "call_id")
    known = cut(refs.join(calls, ["conv_id", "call_id"]).join(calls.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select("conv_id", "call_id", "ref").distinct())
    most = known.groupBy("conv_id", "call_id").count().agg(F.max("count")).first()[0] or 0
    out = _chains(calls, known) if most <= 1 else _peel(calls, known)
    drop_cut(known)
    return out


def _chains(calls: DataFrame, known: DataFrame) -> DataFrame:
    state = cut(calls.join(known.withColumnRenamed("ref", "to"), ["conv_id", "call_id"], "left").withColumn("level", F.col("to").isNotNull().cast("int")))
    longest = known.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps <= longest and not (open_ := state.where("to is not null")).isEmpty():
        at = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        further = open_.join(at, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"))
        new = cut(state.where("to is null").unionByName(further))
        drop_cut(state)
        state, steps = new, 2 * steps
    # what still points on after so many steps stands on a cycle, or behind one
    out = state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))
    out._cut_path = state._cut_path
    return out


def _peel(calls: DataFrame, edges: DataFrame) -> DataFrame:
    left = cut(calls)
    done = None
    level = 0
    while not left.isEmpty():
        waiting = edges.join(left.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left_semi").select("conv_id", "call_id").distinct()
        free = cut(left.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            stuck = left.withColumn("level", F.lit(None).cast("int"))
            done = stuck if done is None else done.unionByName(stuck)
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
        level += 1
    return cut(done) if done is not None else left.withColumn("level", F.lit(0))


def link_calls(calls: DataFrame, results: DataFrame, schema: Schema, refs: tuple[str, ...] = (), keep_null: bool = False) -> DataFrame:
    """One row for each identifier of calls (conv_id, call_id, turn, tool, args) and results (conv_id, call_id, turn, content)."""
    one = cut(first_by_id(calls, "tool", "args").withColumn("called", F.lit(True)))
    two = first_by_id(results, "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("copies").alias("result_copies"), F.lit(True).alias("answered"))
    links = None
    for path in refs:
        x = one.select("conv_id", "call_id", F.get_json_object("args", f"$.{path}").alias("ref")).where("ref is not null")
        links = x if links is None else links.unionByName(x)
    out = one.join(two, ["conv_id", "call_id"], "full_outer")
    if links is not None:
        gone = links.join(one.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti").select("conv_id", "call_id").distinct()
        out = out.join(gone.withColumn("lost", F.lit(True)), ["conv_id", "call_id"], "left").join(levels(one, links), ["conv_id", "call_id"], "left")
    else:
        out = out.withColumns({"lost": F.lit(None).cast("boolean"), "level": F.when(F.col("called"), F.lit(0))})
    if keep_null:
        bare = calls.where("call_id is null").select("conv_id", "call_id", "turn", "tool", "args").withColumns({"copies": F.lit(1).cast("long"), "called": F.lit(True), "lost": F.lit(False)})
        for path in refs:
            there = one.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("there"))
            bare = bare.withColumn("ref", F.get_json_object("args", f"$.{path}")).join(there, ["conv_id", "ref"], "left")
            bare = bare.withColumn("lost", F.col("lost") | F.col("ref").isNotNull() & F.col("there").isNull()).drop("ref", "there")
        late = results.where("call_id is null").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content").withColumns({"result_copies": F.lit(1).cast("long"), "answered": F.lit(True)})
        out = out.unionByName(bare, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    errors = argument_errors(F.col("tool"), F.col("args"), schema)
    errors = F.when(F.col("called"), F.when(F.col("lost"), F.sort_array(F.concat(errors, F.array(F.lit("unknown_ref"))))).otherwise(errors))
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "no_result").otherwise("linked")
    text = canonical(arguments=F.try_parse_json("args"), id=F.col("call_id"), name=F.col("tool"), result=F.col("content"))
    return out.select("conv_id", "call_id", "turn", "result_turn", "level", status.alias("status"), errors.alias("errors"), "copies", "result_copies", text.alias("json"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call of `reply`, the turn that answers it is its result, and each call refers to the user turn before it."""
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - n).cast("string"))
    user = chat.where("role = 'user'")
    known = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has")).distinct()
    args = canonical(after=F.when(F.col("has"), ident(2)), prompt=F.col("text"), turn=F.col("turn"))
    calls = user.join(known, ["conv_id", "turn"], "left").select("conv_id", ident(0).alias("call_id"), "turn", F.lit("reply").alias("tool"), args.alias("args"))
    results = chat.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), "turn", F.col("text").alias("content"))
    out = link_calls(calls, results, REPLY, ("after",), keep_null=True)
    return out.select("conv_id", "call_id", "turn", "result_turn", "level", "status", F.concat_ws(",", "errors").alias("errors"), "copies", F.md5("json").alias("json_md5"))


OP4_SQL = r"""
with u as (select *, conv_id || ':' || turn as call_id from conversations where role = 'user'),
a as (select conv_id, text, turn, conv_id || ':' || (turn - 1) as call_id from conversations where role = 'assistant'),
one as (select conv_id, call_id, min(turn) as turn, min(text) as text, count(*) as copies from u group by all),
two as (select conv_id, call_id, min(turn) as result_turn, min(text) as content from a group by all),
isles as (select conv_id, turn, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as isle from (select distinct conv_id, turn from u)),
levels as (select conv_id, turn, cast(row_number() over (partition by conv_id, turn % 2, isle order by turn) - 1 as int) as level from isles)
select conv_id, call_id, o.turn, t.result_turn,
       l.level,
       case when o.turn is null then 'orphan' when t.result_turn is null then 'no_result' else 'linked' end as status,
       case when o.turn is not null and o.text is null then 'missing:prompt' else '' end as errors,
       o.copies,
       md5('{' || concat_ws(',',
         case when o.turn is not null then '"arguments":{' || concat_ws(',',
           case when p.turn is not null then '"after":"' || p.call_id || '"' end,
           case when o.text is not null then '"prompt":' || to_json(o.text) end,
           '"turn":' || o.turn) || '}' end,
         '"id":"' || call_id || '"',
         case when o.turn is not null then '"name":"reply"' end,
         case when t.content is not null then '"result":' || to_json(t.content) end) || '}') as json_md5
from one o full join two t using (conv_id, call_id)
left join one p on p.conv_id = o.conv_id and p.turn = o.turn - 2
left join levels l on l.conv_id = o.conv_id and l.turn = o.turn
"""
