"""Conversations inside the issue field of a ticket."""

from pyspark.sql import DataFrame, functions as F

from deskloom import fixed
from deskloom.functions import json as j, text as t


def parse_conversations(tickets: DataFrame) -> DataFrame:
    """Add conversation_text and last_user_message to tickets.

    Text that is no JSON array is taken as the message itself. Elements that
    are no objects and empty messages are skipped; a missing role is the user.
    """
    items = F.filter(j.elements(F.col("_json")), lambda v: j.is_object(v))
    messages = F.transform(
        items,
        lambda v: F.struct(
            F.upper(F.coalesce(j.text_field(v, "role"), F.lit("user"))).alias("role"),
            t.null_safe(j.text_field(v, "content")).alias("content"),
        ),
    )
    parsed = (
        tickets.withColumn("_json", j.parse(F.col("issue")))
        .withColumn("_messages", messages)
        .withColumn("_messages", F.filter("_messages", lambda m: m["content"] != ""))
    )
    lines = F.transform("_messages", lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"]))
    by_user = F.filter("_messages", lambda m: m["role"] == "USER")
    last = F.get(by_user, F.size(by_user) - 1)["content"]
    whole = F.coalesce(F.array_join(lines, "\n"), t.strip(F.col("issue")))
    return (
        parsed.withColumn("conversation_text", whole)
        .withColumn("last_user_message", F.coalesce(last, F.col("conversation_text")))
        .drop("_json", "_messages")
    )


def roll_up(turns: DataFrame) -> DataFrame:
    """Text and last user message of every whole conversation, from one row per turn.

    The last message is an aggregate that combines on the map side.
    """
    content = t.null_safe(F.col("text"))
    role = F.upper(F.coalesce("role", F.lit("user")))
    rows = turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit("["), role, F.lit("]: "), content).alias("line"),
        F.when(role == "USER", content).alias("user_text"),
        content.alias("content"),
    ).where("content != ''")
    grouped = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"),
        F.max(F.when(F.col("user_text").isNotNull(), F.struct("turn", "user_text"))).alias("last"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return grouped.select(
        "conv_id",
        "n_turns",
        text.alias("conversation_text"),
        F.coalesce(F.col("last.user_text"), text).alias("last_user_message"),
    )


def last_user_message(turns: DataFrame) -> DataFrame:
    """The last user message of every whole conversation, any length."""
    spoken = turns.where((F.lower("role") == "user") & (t.null_safe(F.col("text")) != ""))
    return spoken.groupBy("conv_id").agg(F.max_by(t.strip(F.col("text")), "turn").alias("last_user_message"))


def add_query(tickets: DataFrame) -> DataFrame:
    """The retrieval query: subject and last user message, cut and squeezed."""
    joined = t.strip(F.concat(F.col("subject"), F.lit(" "), F.col("last_user_message")))
    return tickets.withColumn("query", t.squeeze(F.substring(joined, 1, fixed.QUERY_CHARS)))


def add_domain_filter(tickets: DataFrame, companies) -> DataFrame:
    """The company as a domain filter if it names a domain, else null."""
    company = F.lower(t.strip(F.col("company")))
    return tickets.withColumn("domain_filter", F.when(company.isin(list(companies)), company))
