"""Prompt and message assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text

# Response modes, the disclaimers that go with them, and the user's turn.
GROUNDED, GENERAL = "REFERENCE_SUPPORTED", "GENERAL_ENT"
DISCLAIMERS = {
    GROUNDED: "This is educational information, not a diagnosis or treatment recommendation. Please consult a qualified healthcare professional for patient-specific advice.",
    GENERAL: "Important: This answer is general ENT educational information only. It is not a diagnosis, treatment recommendation, prescription, or substitute for professional medical advice. Please consult a qualified healthcare professional for patient-specific guidance.",
}
TEMPLATE = """
    RESPONSE MODE:
    {response_mode}

    REQUIRED OPENING DISCLAIMER:
    {safety_disclaimer}

    REFERENCE PASSAGE:
    {retrieved_passage}

    USER QUESTION:
    {user_question}

    Begin with the required opening disclaimer exactly once.
    Then answer the user's question directly.
    Do not mention the response mode, retrieval process, missing context, or whether reference material was provided.
    """
#: A system turn of this library's own; {today_date} is filled in.
SYSTEM = "Today: {today_date}\nYou explain educational material. Answer from the reference passage if there is one, else in general terms."


def fill(template: str, **values: Column) -> Column:
    """A template with its named places filled; values may hold braces of their own."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(values[name], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def response_mode(context: Column) -> Column:
    """General without a context: null, blank or the no-context text."""
    return F.when(text.strip(F.coalesce(context, F.lit(""))).isin("", text.NO_CONTEXT), GENERAL).otherwise(GROUNDED)


def disclaimer(mode: Column) -> Column:
    return F.when(mode == GROUNDED, DISCLAIMERS[GROUNDED]).otherwise(DISCLAIMERS[GENERAL])


def prompt(question: Column, context: Column, template: str = TEMPLATE) -> Column:
    """The user's turn: mode and disclaimer by the context, then context and question."""
    mode = response_mode(context)
    return fill(template, response_mode=mode, safety_disclaimer=disclaimer(mode), retrieved_passage=context, user_question=question)


def system(date: Column, template: str = SYSTEM) -> Column:
    """The system turn of a day, written as in 01 January 2026."""
    return fill(template, today_date=F.date_format(date, "dd MMMM yyyy"))


def messages(system: Column, history: Column, user: Column) -> Column:
    """System turn, earlier turns, then the user's; a null prompt gives no messages."""
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.when(user.isNotNull(), F.concat(turn("system", system), history, turn("user", user)))


def history(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", most: int | None = None) -> DataFrame:
    """Every turn with all turns before it, or the ``most`` latest of them.

    Each row holds its own history, so n turns of a conversation take some n * n / 2 turns, or n * ``most``: give a bound where
    conversations outgrow a prompt, or keep them as state (``streaming.chat``).
    """
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return turns.withColumn("history", F.collect_list(F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).over(w))
