"""Question to answer, for a whole table of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.fixed_values import MAX_NEIGHBORS, MIN_SCORE
from docloom.operators import converse, index, inference, search
from docloom.session import materialise
from docloom.sources import sinks, stores
from docloom.sources.versions import Change, Store, Table


@dataclass
class AnswerSettings:
    """Configuration of the question service."""

    max_neighbors: int = MAX_NEIGHBORS
    min_score: float = MIN_SCORE
    expertise: str = ""
    enrichment: bool = True
    with_summary: bool = False
    compat_last: bool = False


@dataclass
class AnswerModels:
    embed: inference.Embed | None = None
    summarise: inference.Summarise = inference.digest_summary
    chat: inference.Chat = inference.digest_chat


def previous_turns(questions: DataFrame, exchanges: DataFrame, compat: bool = False) -> DataFrame:
    """Turns of each asked session: parsed, without negative and repeated answers, last five."""
    wanted = questions.select(F.col("session_id").alias("session"))
    stored = stores.session_exchanges(exchanges, wanted)
    first = converse.first_answers(converse.parse_exchanges(stored))
    return converse.session_turns(converse.last_exchanges(first, compat=compat))


def hits_with_content(
    vectors: DataFrame | search.VectorIndex, cells: DataFrame, queries: DataFrame, request_of: DataFrame, settings: AnswerSettings
) -> DataFrame:
    """Best hits of each request with text and link.

    ``request_of`` maps ``query_pos`` to ``request_id``.  The score bound reaches into the
    search tasks; the content table is cut down to the hit keys before it is read.
    """
    indexed = vectors if isinstance(vectors, search.VectorIndex) else search.VectorIndex(vectors)
    found = search.above(indexed.find(queries, settings.min_score), settings.min_score)
    best = search.best_of_request(found.join(request_of, "query_pos"), settings.max_neighbors)
    best = materialise(best, "hits")
    content = stores.content_by_key(cells, best.select(F.col("id").alias("row_key")))
    return best.join(content.withColumnRenamed("row_key", "id"), "id", "left")


def answer(
    questions: DataFrame,
    vectors: DataFrame | search.VectorIndex,
    cells: DataFrame,
    exchanges: DataFrame,
    settings: AnswerSettings | None = None,
    models: AnswerModels | None = None,
) -> DataFrame:
    """``request_id, session_id, text, parameters, prompt, turns, summary, answer, source_links, failure``.

    Invalid questions come back with a failure and nothing else.
    """
    settings = settings or AnswerSettings()
    models = models or AnswerModels()
    checked = converse.validate_questions(questions)
    valid = checked.filter("reason IS NULL").drop("reason")

    turns = previous_turns(valid, exchanges, settings.compat_last)
    asked = valid.join(turns.withColumnRenamed("session", "session_id"), "session_id", "left")
    asked = inference.summarise(
        asked.withColumn("summary_prompt", converse.summary_prompt(F.col("previous"))), models.summarise
    )
    to_embed: Column = F.concat_ws("\n", F.nullif("summary", F.lit("")), F.col("text")) if settings.with_summary else F.col("text")
    numbered = asked.withColumn("query_pos", F.monotonically_increasing_id()).withColumn("embed_text", to_embed)
    # written once: the numbers stay, the vectors are counted, shared and joined below, the models run once
    ready = materialise(inference.embed_texts(numbered, "embed_text", models.embed), "questions")

    wanted = converse.effective_k(F.col("parameters.maxNeighbors"), settings.max_neighbors)
    queries = search.query_batch(
        inference.embedded(ready).select("query_pos", "embedding", "parameters"), F.col("query_pos"), wanted
    )
    hits = materialise(
        hits_with_content(vectors, cells, queries, ready.select("query_pos", "request_id"), settings), "found"
    )
    prompted = (
        ready.join(converse.context_texts(hits), "request_id", "left")
        .join(converse.source_links(hits), "request_id", "left")
        .withColumn(
            "prompt",
            converse.context_prompt(
                F.col("context"),
                converse.expertise(F.col("parameters.botContextExpertise"), settings.expertise),
                converse.enrichment(F.col("parameters.includeOwnKnowledgeEnrichment"), settings.enrichment),
            ),
        )
        .withColumn("turns", converse.with_current_turn(F.col("previous"), F.col("text")))
        .withColumn("model_parameters", converse.model_parameters(F.col("parameters")))
    )
    columns = [
        "request_id", "session_id", "text", "parameters", "prompt", "turns", "summary", "links",
        "model_parameters", "summary_error", "embed_error",
    ]
    said = inference.chat(prompted.select(*columns), models.chat).withColumn(
        "answer", converse.answer_text(F.col("response"))
    )
    failure = F.coalesce(
        "summary_error",
        "embed_error",
        "chat_error",
        F.when(F.col("answer").isNull(), F.lit("The model gave no answer")),
    )
    results = said.select(
        "request_id",
        "session_id",
        "text",
        "parameters",
        "prompt",
        "turns",
        "summary",
        "answer",
        converse.shown_links(F.col("answer"), F.col("links")).alias("source_links"),
        failure.alias("failure"),
    )
    rejected = checked.filter("reason IS NOT NULL").select(
        "request_id", "session_id", "text", "parameters", F.col("reason").alias("failure")
    )
    return results.unionByName(rejected, allowMissingColumns=True)


def _no_results(questions: DataFrame) -> DataFrame:
    """What ``answer`` gives for no questions."""
    none = questions.limit(0).select("request_id", "session_id", "text", "parameters")
    types = {
        "prompt": "string", "turns": converse.TURNS, "summary": "string", "answer": "string",
        "source_links": "array<struct<link: string, distance: double>>", "failure": "string",
    }
    return none.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in types.items()])


def answered_exchanges(results: DataFrame) -> DataFrame:
    """What has to be added to the session table."""
    return results.filter("failure IS NULL").select(
        F.col("session_id").alias("session"), F.col("text").alias("question"), "answer"
    )


#: Session exchanges and the interaction log change together.
SESSION_TABLE = Table("exchanges", "session string, ts timestamp, exchange string", "session")
LOG_TABLE = Table("interactions", "interaction_id string, request_id string, ts timestamp, request string, response string", "interaction_id")


def open_sessions(spark: SparkSession, path: str) -> Store:
    """The session and log tables below a folder; a new folder is an empty store."""
    return Store(spark, path, [SESSION_TABLE, LOG_TABLE])


def answer_and_store(
    questions: DataFrame,
    vectors: DataFrame | search.VectorIndex,
    cells: DataFrame,
    sessions: Store,
    now: Column,
    settings: AnswerSettings | None = None,
    models: AnswerModels | None = None,
    log: bool = True,
    writer: str | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Answer all questions from the stored sessions, and add the exchanges and the log in one step.

    Only what is new is written; answers are complete before anything is stored.  A batch that its writer
    has stored already is not asked again: it adds nothing and gives no rows (its answers are in the log).
    """
    base = sessions.snapshot()
    if sessions.committed(writer, batch, base):
        return _no_results(questions)
    answered = answer(questions, vectors, cells, base.table("exchanges"), settings or AnswerSettings(), models or AnswerModels())
    results = materialise(answered, "results")
    none = base.table("exchanges").limit(0)
    changes = {"exchanges": Change(index.append_exchanges(none, answered_exchanges(results), now))}
    if log:
        served = results.where("failure IS NULL").select("request_id", "answer", "summary", "source_links")
        asked = questions.select("request_id", "text", "session_id", "parameters")
        changes["interactions"] = Change(sinks.interaction_log(asked, served).withColumn("ts", now))
    sessions.commit(changes, writer, batch, base)
    return results
