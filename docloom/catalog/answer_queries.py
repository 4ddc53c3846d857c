"""Vector search, conversations and answers (inventory G and H, and B-15)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docloom.catalog import inputs
from docloom.catalog.registry import query
from docloom.catalog.sql import T0, sql
from docloom.fixed_values import (
    CONTEXT_PROMPT,
    DEFAULT_EXPERTISE,
    ENRICH_STATEMENT,
    FOUND_ON_INTERNET,
    NEGATIVE_ANSWER,
    NEGATIVE_ANSWERS,
    SEED_VECTOR_ID,
    SUMMARY_PROMPT,
)
from docloom.functions.text import collapse_spaces
from docloom.functions.vectors import as_double, dot, l2_norm
from docloom.operators import converse, index, inference, ivf, search
from docloom.plans import answer
from docloom.session import materialise, new_folder
from docloom.sources import sinks, stores
from docloom.sources.versions import Change


def text(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def is_negative(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(n)})" for n in NEGATIVE_ANSWERS) + ")"


# --- G: vector search ----------------------------------------------------------

HIT = "query_pos, query_id, id, round(score, 6) AS score, rank"


def _hits(spark, sf_dir):
    return search.exact(inputs.vector_queries(spark, sf_dir), inputs.vectors(spark, sf_dir))


def _shown(hits, *more):
    rank = F.col("rank").cast("bigint").alias("rank")
    return hits.select("query_pos", "query_id", "id", F.round("score", 6).alias("score"), rank, *more)


@query(
    "G01_query_batch",
    """SELECT vec_id AS query_pos, 'query' || vec_id AS query_id, len(embedding)::BIGINT AS dimensions, (3 + vec_id % 2)::BIGINT AS max_nn
    FROM embeddings""",
)
def query_batch(spark, sf_dir):
    batch = search.query_batch(
        inputs.given(spark, sf_dir, "embeddings"), F.col("vec_id"), F.lit(3) + F.col("vec_id") % 2
    )
    return batch.select(
        "query_pos", "query_id", F.size("embedding").cast("bigint").alias("dimensions"), F.col("max_nn").cast("bigint").alias("max_nn")
    )


@query("G02_exact_search", sql(f"SELECT {HIT}, round(1 - score, 6) AS distance FROM ranked", "ranked"))
def exact_search(spark, sf_dir):
    """Every vector asks for its nearest among all vectors; queries are shared with the tasks."""
    return _shown(_hits(spark, sf_dir), F.round("distance", 6).alias("distance"))


@query("G02_exact_search_blocks", sql(f"SELECT {HIT} FROM ranked", "ranked"))
def exact_search_blocks(spark, sf_dir):
    """The same for a query table too large to share at once: one slice after the other is shared."""
    return _shown(
        search.exact(inputs.vector_queries(spark, sf_dir), inputs.vectors(spark, sf_dir), broadcast_bytes=0)
    )


@query(
    "G03_dot_product_search",
    sql(
        f"""SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY score DESC, id) AS rank FROM (
        SELECT q.vec_id AS query_pos, 'query' || q.vec_id AS query_id, v.id, 3 + q.vec_id % 2 AS max_nn,
        round(list_dot_product(q.embedding, v.embedding) / sqrt(list_dot_product(v.embedding, v.embedding)), 9) AS score
        FROM vectors q CROSS JOIN vectors v)) WHERE rank <= max_nn""",
        "vectors",
    ),
)
def dot_product_search(spark, sf_dir):
    vectors = search.normalise(inputs.vectors(spark, sf_dir))
    return _shown(search.exact(inputs.vector_queries(spark, sf_dir), vectors, metric="dot"))


@query(
    "G03_normalised_vectors",
    """SELECT vec_id::VARCHAR AS id, 1.0::DOUBLE AS norm, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first
    FROM embeddings""",
)
def normalised_vectors(spark, sf_dir):
    unit = search.normalise(inputs.vectors(spark, sf_dir))
    return unit.select(
        "id", F.round(l2_norm(as_double(F.col("embedding"))), 6).alias("norm"), F.round(F.get("embedding", F.lit(0)), 6).alias("first")
    )


@query("G03_self_dot_product", "SELECT vec_id::VARCHAR AS id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS product FROM embeddings")
def self_dot_product(spark, sf_dir):
    v = as_double(F.col("embedding"))
    return inputs.vectors(spark, sf_dir).select("id", F.round(dot(v, v), 6).alias("product"))


@query("G04_ivf_search")
def ivf_search(spark, sf_dir):
    """Nearest vectors among the closest leaves, as many of them as a recall of 0.9 takes."""
    vectors = inputs.vectors(spark, sf_dir)
    leaves = ivf.train(vectors, per_leaf=50)
    assigned = materialise(ivf.by_leaf(ivf.assign(vectors, leaves)), "leaves")
    queries = inputs.vector_queries(spark, sf_dir)
    share = ivf.probe_share(queries, assigned, leaves)
    return _shown(ivf.search(queries, assigned, leaves, probe_fraction=share))


@query("G04_ivf_search_blocks", sql(f"SELECT {HIT} FROM ranked", "ranked"))
def ivf_search_blocks(spark, sf_dir):
    """Every leaf again, for a query batch too large to share."""
    vectors = inputs.vectors(spark, sf_dir)
    leaves = ivf.train(vectors, per_leaf=50)
    assigned = materialise(ivf.by_leaf(ivf.assign(vectors, leaves)), "leaves")
    queries = inputs.vector_queries(spark, sf_dir)
    return _shown(ivf.search(queries, assigned, leaves, probe_fraction=1.0, broadcast_bytes=0))


@query("G04_ivf_search_all_leaves", sql(f"SELECT {HIT} FROM ranked", "ranked"))
def ivf_search_all_leaves(spark, sf_dir):
    """Looking into every leaf has to find exactly what the exact search finds."""
    vectors = inputs.vectors(spark, sf_dir)
    leaves = ivf.train(vectors, per_leaf=50)
    index_ = search.VectorIndex(
        materialise(ivf.by_leaf(ivf.assign(vectors, leaves)), "leaves"), mode="ivf", leaves=leaves, probe_fraction=1.0
    )
    return _shown(index_.find(inputs.vector_queries(spark, sf_dir)))


@query(
    "G05_index_store_and_remove",
    f"""WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE label % 2 <> 0
        UNION ALL SELECT p || vec_id, list_transform(embedding::DOUBLE[], lambda x: -x) FROM embeddings, (VALUES (''), ('n')) t(p) WHERE label % 2 = 0),
    k AS (SELECT * FROM v WHERE id NOT IN (SELECT doc_id::VARCHAR FROM labels)),
    s AS (SELECT q.vec_id AS query_pos, 'query' || q.vec_id AS query_id, k.id, 3 + q.vec_id % 2 AS max_nn,
        round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding), 9) AS score FROM embeddings q CROSS JOIN k)
    SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= max_nn""",
)
def index_store_and_remove(spark, sf_dir):
    """Search after replacing, adding and removing vectors."""
    even = inputs.given(spark, sf_dir, "embeddings").filter("label % 2 = 0")
    ids = F.explode(F.array(F.col("vec_id").cast("string"), F.concat(F.lit("n"), "vec_id")))
    new = even.select(ids.alias("id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    gone = inputs.given(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    changed = search.VectorIndex(inputs.vectors(spark, sf_dir)).store(new).remove(gone)
    return _shown(changed.find(inputs.vector_queries(spark, sf_dir)))


@query("G06_default_query_ids", "SELECT vec_id AS query_pos, CASE WHEN label % 2 = 0 THEN 'named' || label ELSE 'query' || vec_id END AS query_id FROM embeddings")
def default_query_ids(spark, sf_dir):
    name = F.when(F.col("label") % 2 == 0, F.concat(F.lit("named"), "label"))
    batch = search.query_batch(inputs.given(spark, sf_dir, "embeddings"), F.col("vec_id"), 3, name)
    return batch.select("query_pos", "query_id")


@query(
    "G07_nested_hits",
    sql(
        """SELECT query_pos, query_id, count(*) AS neighbors, string_agg(id, ',' ORDER BY rank) AS ids FROM ranked GROUP BY query_pos, query_id""",
        "ranked",
    ),
)
def nested_hits(spark, sf_dir):
    return search.nested(_hits(spark, sf_dir)).select(
        "query_pos",
        "query_id",
        F.size("neighbors").cast("bigint").alias("neighbors"),
        F.array_join(F.transform("neighbors", lambda n: n["id"]), ",").alias("ids"),
    )


@query("G08_effective_k", sql("SELECT request_id, least(3, coalesce(max_neighbors, 2147483647))::BIGINT AS k FROM questions", "questions"))
def effective_k(spark, sf_dir):
    return inputs.questions(spark, sf_dir).select(
        "request_id", converse.effective_k(F.col("parameters.maxNeighbors")).cast("bigint").alias("k")
    )


@query("G09_above_threshold", sql(f"SELECT {HIT} FROM ranked WHERE score > 0.4", "ranked"))
def above_threshold(spark, sf_dir):
    """The bound is applied inside the search tasks and again, strictly, on the hits."""
    hits = search.exact(inputs.vector_queries(spark, sf_dir), inputs.vectors(spark, sf_dir), min_score=0.4)
    return _shown(search.above(hits))


@query(
    "G10_best_of_request",
    sql(
        """SELECT request_id, id, score, place FROM (SELECT request_id, id, round(score, 6) AS score,
        row_number() OVER (PARTITION BY request_id ORDER BY r.score DESC, id) AS place FROM (
        SELECT label::VARCHAR AS request_id, r.id, max(r.score) AS score FROM ranked r JOIN embeddings e ON e.vec_id = r.query_pos
        WHERE r.id <> e.vec_id::VARCHAR GROUP BY 1, 2) r) WHERE place <= 3""",
        "ranked",
    ),
)
def best_of_request(spark, sf_dir):
    """All query vectors of one label form a request; the best three other vectors stay."""
    label = inputs.given(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_pos"), F.col("label").cast("string").alias("request_id")
    )
    hits = _hits(spark, sf_dir).filter(F.col("id") != F.col("query_pos").cast("string")).join(label, "query_pos")
    once = hits.groupBy("request_id", "id").agg(F.max("score").alias("score"))
    return search.best_of_request(once).select(
        "request_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place")
    )


@query(
    "G11_without_seed_vector",
    f"""SELECT CASE WHEN vec_id % 50 = 0 THEN 'dummy' || vec_id ELSE vec_id::VARCHAR END AS id FROM embeddings
    WHERE vec_id > (SELECT min(vec_id) FROM embeddings) -- the first is named {SEED_VECTOR_ID}""",
)
def without_seed_vector(spark, sf_dir):
    vectors = inputs.given(spark, sf_dir, "embeddings")
    first = vectors.agg(F.min("vec_id")).first()[0]
    named = vectors.select(
        F.when(F.col("vec_id") == first, F.lit(SEED_VECTOR_ID))
        .when(F.col("vec_id") % 50 == 0, F.concat(F.lit("dummy"), "vec_id"))
        .otherwise(F.col("vec_id").cast("string"))
        .alias("id")
    )
    return search.without_seed(named)


# --- H: conversations ----------------------------------------------------------


REASON = """CASE WHEN session_id IS NULL THEN 'The session id is missing'
    WHEN NOT regexp_matches(text, '\\S') THEN 'The question is blank' END"""


@query("H01_validate_questions", sql(f"SELECT request_id, {REASON} AS reason FROM questions", "questions"))
def validate_questions(spark, sf_dir):
    return converse.validate_questions(inputs.questions(spark, sf_dir)).select("request_id", "reason")


def _qa(spark, sf_dir):
    return converse.parse_exchanges(inputs.exchanges(spark, sf_dir))


def _timed(rows):
    return rows.select("session", F.unix_timestamp("ts").alias("ts"), "question", "answer")


QA = "session, epoch(ts)::BIGINT AS ts, question, answer"


@query("H02_parse_exchanges", sql(f"SELECT {QA} FROM qa", "qa"))
def parse_exchanges(spark, sf_dir):
    return _timed(_qa(spark, sf_dir))


@query("H03_negative_answers", sql(f"SELECT {QA}, {is_negative('answer')} AS negative FROM qa", "qa"))
def negative_answers(spark, sf_dir):
    rows = _qa(spark, sf_dir)
    return rows.select(
        "session", F.unix_timestamp("ts").alias("ts"), "question", "answer", converse.is_negative(F.col("answer")).alias("negative")
    )


@query("H04_first_answers", sql(f"SELECT {QA} FROM first_answers", "first_answers"))
def first_answers(spark, sf_dir):
    return _timed(converse.first_answers(_qa(spark, sf_dir)))


@query("H05_last_exchanges", sql(f"SELECT {QA} FROM last_five", "last_five"))
def last_exchanges(spark, sf_dir):
    return _timed(converse.last_exchanges(converse.first_answers(_qa(spark, sf_dir))))


@query(
    "H05_last_exchanges_compat",
    sql(
        f"""SELECT {QA} FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, question DESC) AS rn,
        count(*) OVER (PARTITION BY session) AS n FROM first_answers) WHERE (n <= 5) OR (rn BETWEEN 2 AND 6)""",
        "first_answers",
    ),
)
def last_exchanges_compat(spark, sf_dir):
    return _timed(converse.last_exchanges(converse.first_answers(_qa(spark, sf_dir)), compat=True))


@query(
    "H06_exchange_turns",
    sql(
        """SELECT session, epoch(ts)::BIGINT AS ts, author, CASE author WHEN 'user' THEN question ELSE answer END AS content
        FROM last_five, (VALUES ('user'), ('model')) v(author)""",
        "last_five",
    ),
)
def exchange_turns(spark, sf_dir):
    last = converse.last_exchanges(converse.first_answers(_qa(spark, sf_dir)))
    return converse.exchange_rows(last).select("session", F.unix_timestamp("ts").alias("ts"), "author", "content")


def _asked(spark, sf_dir):
    """Valid questions with the earlier turns of their session."""
    valid = converse.validate_questions(inputs.questions(spark, sf_dir)).filter("reason IS NULL")
    turns = answer.previous_turns(valid, inputs.exchanges(spark, sf_dir))
    return valid.join(turns.withColumnRenamed("session", "session_id"), "session_id", "left")


VALID = "questions q LEFT JOIN turns t ON t.session = q.session_id WHERE session_id IS NOT NULL AND regexp_matches(text, '\\S')"


def _said(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(t["author"], F.lit(": "), t["content"])), "\n")


@query(
    "H06_turns_of_questions",
    sql(f"SELECT request_id, coalesce(said || chr(10), '') || 'user: ' || text AS said FROM {VALID}", "questions", "turns"),
)
def turns_of_questions(spark, sf_dir):
    turns = converse.with_current_turn(F.col("previous"), F.col("text"))
    return _asked(spark, sf_dir).select("request_id", _said(turns).alias("said"))


SUMMARY = f"CASE WHEN said IS NOT NULL THEN {text(SUMMARY_PROMPT)} || chr(10) || said END"


@query("H07_summary_prompts", sql(f"SELECT request_id, {SUMMARY} AS prompt FROM {VALID}", "questions", "turns"))
def summary_prompts(spark, sf_dir):
    return _asked(spark, sf_dir).select("request_id", converse.summary_prompt(F.col("previous")).alias("prompt"))


@query(
    "H08_summaries",
    sql(f"SELECT request_id, coalesce('Summary ' || md5({SUMMARY}), '') AS summary FROM {VALID}", "questions", "turns"),
)
def summaries(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("summary_prompt", converse.summary_prompt(F.col("previous")))
    return inference.summarise(asked.select("request_id", "summary_prompt")).select("request_id", "summary")


@query(
    "H09_embed_questions",
    sql("SELECT request_id, bucket, round(v, 6) AS value FROM question_weights WHERE v <> 0", "question_weights"),
)
def embed_questions(spark, sf_dir):
    valid = converse.validate_questions(inputs.questions(spark, sf_dir)).filter("reason IS NULL")
    rows = inference.embed_texts(valid.select("request_id", "text"), "text")
    return (
        rows.select("request_id", F.posexplode("embedding").alias("bucket", "v"))
        .filter("v <> 0")
        .select("request_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("v").cast("double"), 6).alias("value"))
    )


# --- H: hits, prompts, links ---------------------------------------------------


def _index(spark, sf_dir):
    """Vector table and content cells of all documents."""
    rows = index.indexable(inputs.embedded(spark, sf_dir), "mime_type").withColumn(
        "link", index.source_link(F.col("row_key"), F.col("mime_type"))
    )
    return (
        rows.select(F.col("row_key").alias("id"), "embedding"),
        index.content_cells(rows, inputs.at(F.lit(0))),
    )


def _question_hits(spark, sf_dir):
    """Hits of the valid questions, with text and link."""
    valid = converse.validate_questions(inputs.questions(spark, sf_dir)).filter("reason IS NULL")
    ready = materialise(
        inference.embed_texts(valid.withColumn("query_pos", F.col("request_id").cast("long")), "text"), "questions"
    )
    queries = search.query_batch(ready, F.col("query_pos"), converse.effective_k(F.col("parameters.maxNeighbors")))
    vectors, cells = _index(spark, sf_dir)
    return answer.hits_with_content(
        vectors, cells, queries, ready.select("query_pos", "request_id"), answer.AnswerSettings()
    )


@query(
    "H10_hits_with_content",
    sql("SELECT request_id, id, round(score, 6) AS score, content, link FROM question_hits", "question_hits"),
)
def hits_with_content(spark, sf_dir):
    return _question_hits(spark, sf_dir).select("request_id", "id", F.round("score", 6).alias("score"), "content", "link")


CONTEXT = "SELECT request_id, string_agg(content, ' ' ORDER BY score DESC, id) AS context FROM question_hits GROUP BY request_id"


@query("H11_context_texts", sql(CONTEXT, "question_hits"))
def context_texts(spark, sf_dir):
    return converse.context_texts(_question_hits(spark, sf_dir))


_pieces = CONTEXT_PROMPT.split("%s")
EXPERTISE = f"CASE WHEN regexp_matches(expertise, '\\S') THEN expertise ELSE {text(DEFAULT_EXPERTISE)} END"
ENRICH = f"CASE WHEN coalesce(enrich, true) THEN {text(ENRICH_STATEMENT)} ELSE '' END"
PROMPT = " || ".join(
    [
        text(_pieces[0]), EXPERTISE, text(_pieces[1]), ENRICH, text(_pieces[2]), text(NEGATIVE_ANSWER),
        text(_pieces[3]), "coalesce({context}, '')", text(_pieces[4]),
    ]
)


@query("H12_context_prompts", sql(f"SELECT request_id, {PROMPT.format(context='text')} AS prompt FROM questions", "questions"))
def context_prompts(spark, sf_dir):
    """The prompt of every question, with its own text as content."""
    prompt = converse.context_prompt(
        F.col("text"),
        converse.expertise(F.col("parameters.botContextExpertise")),
        converse.enrichment(F.col("parameters.includeOwnKnowledgeEnrichment")),
    )
    return inputs.questions(spark, sf_dir).select("request_id", prompt.alias("prompt"))


@query(
    "H13_expertise_and_enrichment",
    sql(
        """SELECT request_id, CASE WHEN regexp_matches(expertise, '\\S') THEN expertise ELSE 'You answer for the archive.' END AS expertise,
        coalesce(enrich, false) AS enrichment FROM questions""",
        "questions",
    ),
)
def expertise_and_enrichment(spark, sf_dir):
    return inputs.questions(spark, sf_dir).select(
        "request_id",
        converse.expertise(F.col("parameters.botContextExpertise"), "You answer for the archive.").alias("expertise"),
        converse.enrichment(F.col("parameters.includeOwnKnowledgeEnrichment"), False).alias("enrichment"),
    )


@query(
    "H14_model_parameters",
    sql(
        """SELECT request_id, coalesce(temperature, 0.5)::DOUBLE AS temperature, coalesce(max_output, 1024)::BIGINT AS max_output_tokens,
        40::BIGINT AS top_k, 0.95::DOUBLE AS top_p FROM questions""",
        "questions",
    ),
)
def model_parameters(spark, sf_dir):
    p = converse.model_parameters(F.col("parameters"))
    return inputs.questions(spark, sf_dir).select(
        "request_id",
        p["temperature"].alias("temperature"),
        p["maxOutputTokens"].cast("bigint").alias("max_output_tokens"),
        p["topK"].cast("bigint").alias("top_k"),
        p["topP"].alias("top_p"),
    )


@query(
    "H15_chat_answers",
    sql(
        f"""SELECT request_id, 'Answer ' || md5({PROMPT.format(context='text')} || coalesce(said || chr(10), '') || 'user: ' || text) AS answer
        FROM {VALID}""",
        "questions",
        "turns",
    ),
)
def chat_answers(spark, sf_dir):
    """Every valid question with its own text as content."""
    prompted = _asked(spark, sf_dir).select(
        "request_id",
        converse.context_prompt(
            F.col("text"),
            converse.expertise(F.col("parameters.botContextExpertise")),
            converse.enrichment(F.col("parameters.includeOwnKnowledgeEnrichment")),
        ).alias("prompt"),
        converse.with_current_turn(F.col("previous"), F.col("text")).alias("turns"),
        converse.model_parameters(F.col("parameters")).alias("model_parameters"),
    )
    return inference.chat(prompted).select("request_id", converse.answer_text(F.col("response")).alias("answer"))


def _responses(spark, sf_dir):
    """A response per page: JSON string, JSON string in two parts, no JSON, blocked with and without message."""
    kind = F.col("page_id") % 5
    quoted = F.concat(F.lit('"'), "url", F.lit('"'))
    response = F.struct(
        F.when(kind == 0, F.array(quoted))
        .when(kind == 1, F.array(F.lit('"an answer'), F.lit('"')))
        .when(kind == 2, F.array(F.col("url")))
        .alias("parts"),
        F.when(kind >= 3, "SAFETY").alias("block_reason"),
        F.when(kind == 3, F.col("url")).alias("block_message"),
    )
    return inputs.given(spark, sf_dir, "pages").select("page_id", response.alias("response"))


@query("H16_parse_responses", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url END AS answer FROM pages")
def parse_responses(spark, sf_dir):
    """A line break inside a JSON string is not valid JSON, so only whole one-part strings parse."""
    return _responses(spark, sf_dir).select("page_id", converse.parse_response(F.col("response")).alias("answer"))


@query(
    "H17_blocked_responses",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 3 THEN 'Response blocked by model. SAFETY ' || url
    WHEN 4 THEN 'Response blocked by model. SAFETY' END AS answer FROM pages""",
)
def blocked_responses(spark, sf_dir):
    return _responses(spark, sf_dir).select("page_id", converse.answer_text(F.col("response")).alias("answer"))


LINKS = """SELECT request_id, link, max(score) AS distance FROM question_hits WHERE regexp_matches(link, '\\S') GROUP BY request_id, link"""


@query("H18_link_scores", sql(f"SELECT request_id, link, round(distance, 6) AS distance FROM ({LINKS})", "question_hits"))
def link_scores(spark, sf_dir):
    return converse.link_scores(_question_hits(spark, sf_dir)).select(
        "request_id", "link", F.round("distance", 6).alias("distance")
    )


@query(
    "H18_link_scores_of_vectors",
    sql(
        """SELECT query_id AS request_id, url AS link, round(max(score), 6) AS distance FROM ranked r
        JOIN pages p ON p.page_id = r.id::BIGINT % (SELECT count(*) FROM pages) GROUP BY 1, 2""",
        "ranked",
    ),
)
def link_scores_of_vectors(spark, sf_dir):
    """Hits of every vector, each vector belonging to a page."""
    pages = inputs.given(spark, sf_dir, "pages").select("page_id", F.col("url").alias("link"))
    count = pages.count()
    hits = _hits(spark, sf_dir).withColumn("page_id", F.col("id").cast("bigint") % count).join(pages, "page_id")
    return converse.link_scores(hits.withColumnRenamed("query_id", "request_id")).select(
        "request_id", "link", F.round("distance", 6).alias("distance")
    )


@query(
    "H19_shown_links",
    sql(
        f"""SELECT session, epoch(ts)::BIGINT AS ts, question, CASE WHEN {is_negative('answer')} OR length(answer) % 3 = 0 THEN 0 ELSE 1 END::BIGINT
        AS links FROM qa""",
        "qa",
    ),
)
def shown_links(spark, sf_dir):
    """Links under the stored answers; a third of them is said to come from the internet."""
    found = F.concat(F.lit(FOUND_ON_INTERNET + ": "), F.col("answer"))
    said = F.when(F.length("answer") % 3 == 0, found).otherwise(F.col("answer"))
    links = F.array(F.struct(F.col("question").alias("link"), F.lit(0.5).alias("distance")))
    return _qa(spark, sf_dir).select(
        "session",
        F.unix_timestamp("ts").alias("ts"),
        "question",
        F.size(converse.shown_links(said, links)).cast("bigint").alias("links"),
    )


# --- H: the whole --------------------------------------------------------------


def _answered(spark, sf_dir):
    vectors, cells = _index(spark, sf_dir)
    return answer.answer(inputs.questions(spark, sf_dir), vectors, cells, inputs.exchanges(spark, sf_dir))


ANSWER = f"""CASE WHEN NOT regexp_matches(coalesce(context, ''), '\\S') THEN {text(NEGATIVE_ANSWER)}
    ELSE 'Answer ' || md5({PROMPT.format(context='context')} || coalesce(said || chr(10), '') || 'user: ' || text) END"""
ANSWERED = f"""answered AS (SELECT q.request_id, q.session_id, q.text, {REASON} AS failure,
    CASE WHEN {REASON} IS NULL THEN coalesce('Summary ' || md5({SUMMARY}), '') END AS summary,
    CASE WHEN {REASON} IS NULL THEN {ANSWER} END AS answer,
    CASE WHEN {REASON} IS NULL THEN coalesce(links, '') END AS links FROM questions q
    LEFT JOIN turns t ON t.session = q.session_id LEFT JOIN ({CONTEXT}) c USING (request_id)
    LEFT JOIN (SELECT request_id, string_agg(link, ' ' ORDER BY distance DESC, link) AS links FROM ({LINKS}) GROUP BY request_id) l USING (request_id))"""


@query(
    "H21_answer_questions",
    sql("", "questions", "turns", "question_hits").rstrip()
    + f", {ANSWERED} SELECT request_id, session_id, text, summary, answer, links, failure FROM answered",
)
def answer_questions(spark, sf_dir):
    """The whole question path over all indexed documents, with the default model functions."""
    return _answered(spark, sf_dir).select(
        "request_id",
        "session_id",
        "text",
        "summary",
        "answer",
        F.array_join(F.transform("source_links", lambda x: x["link"]), " ").alias("links"),
        "failure",
    )


@query(
    "H20_results_and_exchanges",
    sql("", "questions", "turns", "question_hits").rstrip()
    + f""", {ANSWERED} SELECT session_id AS session, epoch({T0})::BIGINT AS ts, text || '___' || answer AS exchange FROM answered
    WHERE failure IS NULL UNION ALL SELECT session, epoch(ts)::BIGINT, exchange FROM exchanges""",
)
def results_and_exchanges(spark, sf_dir):
    """The session table after all questions were answered."""
    new = answer.answered_exchanges(_answered(spark, sf_dir))
    whole = index.append_exchanges(inputs.exchanges(spark, sf_dir), new, inputs.at(F.lit(0)))
    return whole.select("session", F.unix_timestamp("ts").alias("ts"), "exchange")


@query(
    "B15_interaction_log",
    sql(
        """SELECT request_id, '{"text":"' || text || '","sessionId":"' || session_id || '"}' AS request,
        '{"content":"' || md5(text) || '","previousConversationSummary":"","sourceLinks":[]}' AS response
        FROM (SELECT request_id, session_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM questions WHERE session_id IS NOT NULL)""",
        "questions",
    ),
)
def interaction_log(spark, sf_dir):
    """One row per interaction; its random id is left out of the comparison."""
    asked = inputs.questions(spark, sf_dir).filter("session_id IS NOT NULL").select(
        "request_id", "session_id", collapse_spaces(F.col("text")).alias("text"),
        F.lit(None).cast("struct<maxNeighbors: int>").alias("parameters"),
    )
    said = asked.select(
        "request_id",
        F.md5(F.col("text")).alias("answer"),
        F.lit("").alias("summary"),
        F.array().cast("array<struct<link: string, distance: double>>").alias("source_links"),
    )
    log = sinks.interaction_log(asked, said)
    return log.filter("length(interaction_id) = 36").select("request_id", "request", "response")


@query(
    "A06_content_of_hits",
    sql("SELECT DISTINCT id AS row_key, content, link FROM question_hits", "question_hits"),
)
def content_of_hits(spark, sf_dir):
    hits = materialise(_question_hits(spark, sf_dir), "hits")
    _, cells = _index(spark, sf_dir)
    return stores.content_by_key(cells, hits.select(F.col("id").alias("row_key")))


# --- H-20, B-15: answers with what they leave behind ----------------------------

_sessions: dict[tuple[str, str], str] = {}


def _answered_sessions(spark, sf_dir):
    """The stored sessions after all questions were answered once, though the batch came twice."""
    known = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if known not in _sessions:
        path = new_folder(spark, "sessions")
        sessions = answer.open_sessions(spark, path)
        sessions.commit({"exchanges": Change(inputs.exchanges(spark, sf_dir))})
        vectors, cells = _index(spark, sf_dir)
        for _ in range(2):
            answer.answer_and_store(
                inputs.questions(spark, sf_dir), vectors, cells, sessions, inputs.at(F.lit(86400)), writer="questions", batch=0
            )
            if not sessions.committed("questions", 0, sessions.snapshot()):
                raise RuntimeError("the answers were not stored")
        _sessions[known] = path
    return answer.open_sessions(spark, _sessions[known])


@query(
    "H20_stored_exchanges",
    sql("", "questions", "turns", "question_hits").rstrip()
    + f""", {ANSWERED} SELECT session_id AS session, epoch({T0})::BIGINT + 86400 AS ts, text || '___' || answer AS exchange FROM answered
    WHERE failure IS NULL UNION ALL SELECT session, epoch(ts)::BIGINT, exchange FROM exchanges""",
)
def stored_exchanges(spark, sf_dir):
    """The session table that the answer plan leaves."""
    whole = _answered_sessions(spark, sf_dir).table("exchanges")
    return whole.select("session", F.unix_timestamp("ts").alias("ts"), "exchange")


@query(
    "B15_logged_answers",
    sql("", "questions", "turns", "question_hits").rstrip()
    + f""", {ANSWERED} SELECT request_id, epoch({T0})::BIGINT + 86400 AS ts, '{{"text":' || to_json(text) || ',"sessionId":' || to_json(session_id)
    || CASE WHEN has_parameters THEN ',"parameters":{{' || array_to_string(list_filter([
        CASE WHEN expertise IS NOT NULL THEN '"botContextExpertise":' || to_json(expertise) END,
        CASE WHEN enrich IS NOT NULL THEN '"includeOwnKnowledgeEnrichment":' || enrich END,
        CASE WHEN max_neighbors IS NOT NULL THEN '"maxNeighbors":' || max_neighbors END,
        CASE WHEN temperature IS NOT NULL THEN '"temperature":' || temperature END,
        CASE WHEN max_output IS NOT NULL THEN '"maxOutputTokens":' || max_output END], lambda x: x IS NOT NULL), ',') || '}}' ELSE '' END || '}}' AS request,
    answer, summary, links FROM answered JOIN (SELECT request_id, has_parameters, expertise, enrich, max_neighbors, temperature, max_output FROM questions)
    USING (request_id) WHERE failure IS NULL""",
)
def logged_answers(spark, sf_dir):
    """The interaction log of the same: whole requests, and the answers read back from the response."""
    log = _answered_sessions(spark, sf_dir).table("interactions")
    response = "content string, previousConversationSummary string, sourceLinks array<struct<link: string, distance: double>>"
    rows = log.withColumn("r", F.from_json("response", response))
    return rows.select(
        "request_id",
        F.unix_timestamp("ts").alias("ts"),
        "request",
        F.col("r.content").alias("answer"),
        F.col("r.previousConversationSummary").alias("summary"),
        F.array_join(F.transform("r.sourceLinks", lambda x: x["link"]), " ").alias("links"),
    )
