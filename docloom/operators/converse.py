"""Sessions, prompts, model answers and source links, for whole tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.fixed_values import (
    BLOCKED_PREFIX,
    CONTEXT_PROMPT,
    DEFAULT_EXPERTISE,
    DEFAULT_MAX_OUTPUT_TOKENS,
    DEFAULT_TEMPERATURE,
    DEFAULT_TOP_K,
    DEFAULT_TOP_P,
    ENRICH_STATEMENT,
    FOUND_ON_INTERNET,
    LAST_EXCHANGES,
    MAX_NEIGHBORS,
    NEGATIVE_ANSWER,
    NEGATIVE_ANSWERS,
    SUMMARY_PROMPT,
)
from docloom.functions.keys import key_parts
from docloom.functions.text import contains_any, is_blank, or_default

TURNS = "array<struct<author: string, content: string>>"


def validate_questions(questions: DataFrame) -> DataFrame:
    """Add ``reason``, null for a usable question."""
    return questions.withColumn(
        "reason",
        F.when(F.col("session_id").isNull(), "The session id is missing")
        .when(F.col("text").isNull(), "The question is missing")
        .when(is_blank(F.col("text")), "The question is blank"),
    )


# --- earlier exchanges ---------------------------------------------------------


def parse_exchanges(exchanges: DataFrame) -> DataFrame:
    """``session, ts, question, answer``; a value that is not exactly two parts is left out."""
    parts = key_parts(F.col("exchange"))
    return exchanges.filter(F.size(parts) == 2).select(
        "session",
        "ts",
        F.get(parts, F.lit(0)).alias("question"),
        F.get(parts, F.lit(1)).alias("answer"),
    )


def is_negative(answer: Column) -> Column:
    return contains_any(answer, NEGATIVE_ANSWERS)


def first_answers(parsed: DataFrame) -> DataFrame:
    """First answer that is not negative for each question of a session.

    An aggregation rather than a window: it combines on the map side, so neither a long
    session nor a question asked very often has to fit one task.
    """
    return (
        parsed.filter(~is_negative(F.col("answer")))
        .groupBy("session", "question")
        .agg(F.min(F.struct("ts", "answer")).alias("first"))
        .select("session", "first.ts", "question", "first.answer")
    )


def last_exchanges(parsed: DataFrame, count: int = LAST_EXCHANGES, compat: bool = False) -> DataFrame:
    """The newest ``count`` exchanges of each session.

    ``compat`` gives the older slice instead: where there are more than ``count``
    exchanges, the newest is left out and ``count`` before it are kept.
    """
    newest = W.partitionBy("session").orderBy(F.desc("ts"), F.desc("question"))
    numbered = parsed.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= count + 1)
    if not compat:
        return numbered.filter(F.col("rn") <= count).drop("rn")
    # at most count + 1 rows per session are left here
    many = F.count("*").over(W.partitionBy("session")) > count
    return numbered.withColumn("many", many).filter(~F.col("many") | (F.col("rn") > 1)).drop("rn", "many")


def exchange_rows(parsed: DataFrame) -> DataFrame:
    """Two turns per exchange: what the user asked, what the model said."""
    pair = F.array(
        F.struct(F.lit("user").alias("author"), F.col("question").alias("content")),
        F.struct(F.lit("model").alias("author"), F.col("answer").alias("content")),
    )
    return parsed.select("session", "ts", "question", F.posexplode(pair).alias("side", "turn")).select(
        "session", "ts", "question", "side", "turn.author", "turn.content"
    )


def session_turns(last: DataFrame) -> DataFrame:
    """Turns of each session in order, as one array; ``last`` holds a few exchanges per session."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "question", "answer")))
    pairs = F.transform(
        ordered,
        lambda e: F.array(
            F.struct(F.lit("user").alias("author"), e["question"].alias("content")),
            F.struct(F.lit("model").alias("author"), e["answer"].alias("content")),
        ),
    )
    return last.groupBy("session").agg(F.flatten(pairs).alias("previous"))


def with_current_turn(previous: Column, text: Column) -> Column:
    """Earlier turns followed by the current question."""
    now = F.array(F.struct(F.lit("user").alias("author"), text.alias("content")))
    return F.concat(F.coalesce(previous, F.array().cast(TURNS)), now)


def summary_prompt_parts(turns: Column) -> Column:
    """Prompt parts: the template (its place holder stays as it is), then one line per turn."""
    lines = F.transform(turns, lambda t: F.format_string("%s: %s", t["author"], t["content"]))
    return F.concat(F.array(F.lit(SUMMARY_PROMPT)), lines)


def summary_prompt(turns: Column) -> Column:
    """The parts joined; null when there is nothing to summarise, so no model is called."""
    return F.when(F.size(turns) > 0, F.array_join(summary_prompt_parts(turns), "\n"))


# --- parameters and prompts ----------------------------------------------------


def effective_k(requested: Column, configured: int = MAX_NEIGHBORS) -> Column:
    return F.least(F.lit(configured), F.coalesce(requested, F.lit(2147483647)))


def model_parameters(parameters: Column) -> Column:
    return F.struct(
        F.coalesce(parameters["temperature"], F.lit(DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce(parameters["maxOutputTokens"], F.lit(DEFAULT_MAX_OUTPUT_TOKENS)).alias("maxOutputTokens"),
        F.coalesce(parameters["topK"], F.lit(DEFAULT_TOP_K)).alias("topK"),
        F.coalesce(parameters["topP"], F.lit(DEFAULT_TOP_P)).alias("topP"),
    )


def expertise(requested: Column, configured: str = "") -> Column:
    """Request, else configuration, else the built-in one; blank counts as absent."""
    return or_default(requested, configured, DEFAULT_EXPERTISE)


def enrichment(requested: Column, configured: bool = True) -> Column:
    return F.coalesce(requested, F.lit(configured))


def context_prompt(content: Column, expertise_text: Column, enrich: Column) -> Column:
    """Fill the prompt template by concatenation: content may hold any character."""
    pieces = CONTEXT_PROMPT.split("%s")
    values = [
        expertise_text,
        F.when(enrich, F.lit(ENRICH_STATEMENT)).otherwise(F.lit("")),
        F.lit(NEGATIVE_ANSWER),
        F.coalesce(content, F.lit("")),
    ]
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [value, F.lit(piece)]
    return F.concat(*out)


# --- hits ----------------------------------------------------------------------


def context_texts(hits: DataFrame) -> DataFrame:
    """Contents of each request joined by one space, best score first (a few hits each)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "content")))
    return hits.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda h: h["content"]), " ").alias("context")
    )


def link_scores(hits: DataFrame) -> DataFrame:
    """Best score of each link of a request; blank links are left out."""
    return (
        hits.filter(~is_blank(F.col("link")))
        .groupBy("request_id", "link")
        .agg(F.max("score").alias("distance"))
    )


def source_links(hits: DataFrame) -> DataFrame:
    """The links of each request as one array, best first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("order"), "link", "distance")))
    return (
        link_scores(hits)
        .groupBy("request_id")
        .agg(F.transform(ordered, lambda x: F.struct(x["link"], x["distance"])).alias("links"))
    )


# --- answers -------------------------------------------------------------------


def parse_response(response: Column) -> Column:
    """Parts joined by line breaks and read as one JSON scalar; null when that fails."""
    text = F.array_join(response["parts"], "\n")
    scalar = ~text.rlike(r"^\s*[\[{]")
    values = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return F.when(scalar, F.get(values, F.lit(0)))


def block_feedback(response: Column) -> Column:
    """Reason and message of a block, null for a response that was not blocked."""
    return F.when(
        response["block_reason"].isNotNull(),
        F.concat_ws(" ", response["block_reason"], response["block_message"]),
    )


def answer_text(response: Column) -> Column:
    feedback = block_feedback(response)
    return F.when(feedback.isNotNull(), F.concat(F.lit(BLOCKED_PREFIX), feedback)).otherwise(
        parse_response(response)
    )


def shown_links(answer: Column, links: Column) -> Column:
    """No links under an answer that is negative or comes from the internet."""
    none = F.array().cast("array<struct<link: string, distance: double>>")
    hide = is_negative(answer) | answer.contains(FOUND_ON_INTERNET)
    return F.when(hide, none).otherwise(F.coalesce(links, none))
