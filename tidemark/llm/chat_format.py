"""Operator 3 [native]: chat formatting with typed content parts.

A row is a turn: conversation, order, role and content, an array of typed parts (type, text, ref, units). A visitor
flattens the parts in order: text stays, image, audio and document parts become placeholders that carry their number in
the conversation, and the attachment's reference and expanded token count (units times tokens a unit) are recorded. Parts of
other types become placeholders [PART] of no tokens, so that their references stay.

Template, per turn: `[ROLE]` role `[/ROLE]`, then `[INST] ` text ` [/INST]`, or for the assistant `[OUT] ` text `</s>`;
`<s>` opens a conversation. Control strings inside roles and texts are escaped: a backslash goes behind their first
character, and one more where backslashes are there already. Undoing it takes one off, so any text survives.

Nulls: null roles and texts are empty, null parts are left out; null turns come first, a null conversation is one of its
own. Equal turns of a conversation are ordered by role, text and content, and repeated rows stay. Very long texts are formatted
whole. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: What may follow the first character of a control string, and tokens that one unit of a part expands to.
CONTROL = r"/?(?:s>|INST\]|OUT\]|ROLE\]|IMAGE\]|AUDIO\]|DOCUMENT\]|PART\])"
TOKENS_PER_UNIT = {"image": 256, "audio": 50, "document": 512}
PART = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PART)


def _media(part: Column) -> Column:
    """Whether a part is an attachment: all but text (or no type) is."""
    return F.coalesce(part["type"], F.lit("text")) != "text"


def _visit(content: Column, before: Column) -> Column:
    """The parts of a turn in one string. Text between attachments is escaped as a whole, so that no control string is made
    up of parts. before: attachments in earlier turns, for numbering."""
    at = F.filter(F.transform(content, lambda p, i: F.when(_media(p), i)), lambda i: i.isNotNull())
    name = lambda p: F.when(p["type"].isin(*TOKENS_PER_UNIT), F.upper(p["type"])).otherwise(F.lit("PART"))
    mark = lambda p, k: F.concat(F.lit("["), name(p), F.lit("]"), (before + k + 1).cast("string"), F.lit("[/"), name(p), F.lit("]"))

    def run(k: Column) -> Column:
        low, high = F.when(k > 0, F.get(at, k - 1) + 1).otherwise(F.lit(0)), F.coalesce(F.get(at, k), F.size(content))
        text = escape(F.array_join(F.transform(F.slice(content, low + 1, high - low), lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        return F.when(k < F.size(at), F.concat(text, mark(F.get(content, high), k))).otherwise(text)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), run), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, content) to a row a conversation: formatted, mask (array of start, length in code
    points of what the loss is taken over), attachments (number, type, ref, tokens), n_turns.

    Numbers and places are running sums over a conversation's turns, so that its cost is linear in them. The rows of a
    conversation meet once, as its result is one row.
    """
    clean = F.filter(F.coalesce("content", F.array().cast(PART)), lambda p: p.isNotNull())
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), clean.alias("content"))
    key = F.array_join(F.transform("content", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "key", "content")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    media = F.filter("content", _media)
    rows = rows.withColumn("key", key).withColumn("n_media", F.size(media)).withColumn("at", F.row_number().over(own)).withColumn("before", F.coalesce(F.sum("n_media").over(earlier), F.lit(0)))
    said = F.col("role") == "assistant"
    head = F.concat(F.when(F.col("at") == 1, F.lit("<s>")).otherwise(F.lit("")), F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"), F.when(said, F.lit("[OUT] ")).otherwise(F.lit("[INST] ")))
    rates = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    attach = F.transform(media, lambda p, i: F.struct((F.col("before") + i + 1).cast("long").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * F.coalesce(rates[p["type"]], F.lit(0))).cast("long").alias("tokens")))
    body = F.when(F.col("n_media") == 0, escape(F.array_join(F.transform("content", lambda p: F.coalesce(p["text"], F.lit(""))), ""))).otherwise(_visit(F.col("content"), F.col("before")))
    rows = rows.select("conv_id", "turn", "role", "key", "content", "at", said.alias("own"), head.alias("head"), body.alias("body"), F.when(said, F.lit("</s>")).otherwise(F.lit(" [/INST]")).alias("tail"), attach.alias("attach"))
    length = F.char_length("head") + F.char_length("body") + F.char_length("tail")
    rows = rows.withColumn("begin", F.coalesce(F.sum(length.cast("long")).over(earlier), F.lit(0)) + F.char_length("head"))
    piece = F.struct("at", F.concat("head", "body", "tail").alias("text"), "own", F.struct(F.col("begin").alias("start"), F.char_length("body").cast("long").alias("length")).alias("span"), "attach")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    mask = F.transform(F.filter("p", lambda x: x["own"]), lambda x: x["span"])
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"), mask.alias("mask"), F.flatten(F.transform("p", lambda x: x["attach"])).alias("attachments"), F.size("p").cast("long").alias("n_turns"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text)."""
    turn = r"(?s)\[ROLE\].*?(?: \[/INST\]|</s>)"
    one = r"(?s)^\[ROLE\](.*?)\[/ROLE\]\[(?:INST|OUT)\] (.*?)(?: \[/INST\]|</s>)$"
    return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), lambda t: F.struct(unescape(F.regexp_extract(t, one, 1)).alias("role"), unescape(F.regexp_extract(t, one, 2)).alias("text")))


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations and their masks."""
    df = chats.withColumn("_turns", read_turns(F.col("formatted")))
    df = df.withColumn("_loss", F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    rows = told.union(extra)
    return digests(format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))))


SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|OUT\]|ROLE\]|IMAGE\]|AUDIO\]|DOCUMENT\]|PART\]))', '\1\\\2\3', 'g') as t,
  regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|OUT\]|ROLE\]|IMAGE\]|AUDIO\]|DOCUMENT\]|PART\]))', '\1\\\2\3', 'g') as o from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(length(t) + length(o) + case when role = 'assistant' then 23 else 28 end) as bigint) as formatted_chars
from e group by conv_id"""
