"""Chat formatting from event logs, in DataFrame functions only.

A log has a row for each event of a message: ``open``, ``delta`` (text to add), ``edit``
(the whole text anew) and ``regenerate`` (what was said so far is void). Events are folded
message by message, in the order of their sequence, so that a conversation of many messages
is spread over the tasks; each message is rendered where it was folded; then a
conversation's turns are put together in order.

The template writes a turn as ``<turn role>``, a newline, the text, ``</turn>`` and a newline.
In roles and texts ``&`` and ``<`` (in roles also ``>``) are written as entities, so none of
them can hold a mark, and reading them back gives the very characters. The loss mask is a
list of spans: the turn, and where in it the text of an assistant lies.

Defined results: of events that are alike in conversation, message, sequence and kind one
counts, as logs are delivered again; the last edit or regeneration voids all before it; a
message is where its first event is, a role the first that is not null; a null role is
empty, a null text (payload) too; a message of regenerations alone is an empty turn; a null
conv_id is a conversation like others; an empty log gives an empty table; extra columns are
ignored. A text, and a formatted conversation, is one string, of at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, TAIL = "<turn ", "</turn>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
DELTA_CHARS = 512
EVENTS = ("open", "delta", "edit", "regenerate")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column, role: bool = False) -> Column:
    for raw, entity in ENTITIES if role else ENTITIES[:2]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def fold_messages(log: DataFrame) -> DataFrame:
    """``log``: conv_id, message_id, seq (of any type that sorts), event, role, payload ->
    conv_id, message_id, at (its first sequence), role and text."""
    events = F.array_sort(F.array_distinct(F.collect_list(F.struct("seq", F.col("event"), F.coalesce("payload", F.lit("")).alias("payload")))))
    per = log.where(F.col("event").isin(*EVENTS)).groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("at"), F.expr("min_by(role, seq) filter (where role is not null)").alias("role"), events.alias("events"),
        F.max(F.when(F.col("event").isin("edit", "regenerate"), F.struct("seq", F.col("event")))).alias("void"),
    )
    counts = F.filter("events", lambda e: e["event"].isin("delta", "edit") & (F.col("void").isNull() | (F.struct(e["seq"], e["event"]) >= F.col("void"))))
    text = F.array_join(F.transform(counts, lambda e: e["payload"]), "")
    return per.select("conv_id", "message_id", "at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def format_conversations(messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss: (turn, start, length) of each assistant text, in code
    points of the turn's part as it lies between marks."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(">\n"))
    turns = messages.select("conv_id", "at", "message_id", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == assistant).alias("learns"))
    turn = F.struct(
        "at", "message_id", F.concat("head", "body", F.lit(TAIL)).alias("part"), F.char_length("head").alias("start"), F.char_length("body").alias("length"), "learns",
    )
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["learns"].alias("learns")))
    loss = F.transform(F.filter(spans, lambda x: x["learns"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return per.select("conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and loss alone: conv_id, turns (role, text), learnt (the text under the
    mask) and formatted_chars."""

    def read(parts: Column) -> Column:
        def turn(p: Column) -> Column:
            role_end = F.locate(">\n", p)
            role = F.substr(p, F.lit(len(HEAD) + 1), role_end - F.lit(len(HEAD) + 1))
            return F.struct(unescape(role).alias("role"), unescape(F.substr(p, role_end + F.lit(2))).alias("text"))

        texts = F.transform("loss", lambda x: unescape(F.substr(F.get(parts, x["turn"]), x["start"] + F.lit(1), x["length"])))
        return F.struct(F.transform(F.filter(parts, lambda p: p != ""), turn).alias("turns"), F.array_join(texts, "").alias("learnt"))

    rows = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), _let(F.split("formatted", TAIL), read).alias("r"))
    return rows.select("conv_id", F.col("r.turns").alias("turns"), F.col("r.learnt").alias("learnt"), "formatted_chars")


def conversation_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that ends in them: each is opened and
    streamed in deltas; of some, by a hash of their text, a first answer is regenerated, of
    others the last word is an edit. The order is by turn, nulls first, then by role, text
    hash and row."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    n = F.ceil(F.char_length("text") / delta_chars).cast("int")
    deltas = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), 0)
    kind = F.pmod(F.col("key"), F.lit(16))

    def event(name: str, payload: Column, at) -> Column:
        return F.struct(F.lit(name).alias("event"), payload.alias("payload"), at.alias("k"))

    none = F.lit(None).cast("string")
    drafted = F.array(event("delta", F.substring("text", 1, 7), F.lit(1)), event("regenerate", none, F.lit(2)))
    streamed = F.transform(deltas, lambda d, i: event("delta", d, i + 3))
    edited = F.array(event("delta", F.lit("…"), F.lit(1)), event("edit", F.col("text"), F.lit(2)))
    events = F.concat(F.array(event("open", none, F.lit(0))), F.when(kind == 0, F.concat(drafted, streamed)).when(kind == 1, edited).otherwise(streamed))
    rows = rows.withColumn("n", n).withColumn("e", F.explode(events))
    message = F.struct("turn", "role", "key", "row")
    return rows.select("conv_id", message.alias("message_id"), F.struct(*[F.col(c) for c in ("turn", "role", "key", "row")], F.col("e.k").alias("k")).alias("seq"), "e.event", "role", "e.payload")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns that look like marks."""
    says = "\\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(says).alias("text")) for k, r in enumerate(("user", "assistant"))])
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def oracle_sql() -> str:
    """DuckDB SQL of what is read back, from the rows themselves."""
    says = "chr(92) || '### Assistant: </turn> ok'"

    def escaped(column: str, n: int) -> str:
        return f"(length({column}) + " + " + ".join(f"{len(e) - 1} * (length({column}) - length(replace({column}, '{r}', '')))" for r, e in ENTITIES[:n]) + ")"

    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {says} union all select -7, 1, 'assistant', {says}),
o as (select *, role || chr(10) || text || chr(10) as said, {len(HEAD) + 2 + len(TAIL)} + {escaped('role', 3)} + {escaped('text', 2)} as chars from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(said, '' order by turn nulls first, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from o group by conv_id"""
