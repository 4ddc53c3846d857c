import datetime as dt

from pyspark.sql import functions as F

from docloom.fixed_values import DEFAULT_EXPERTISE, NEGATIVE_ANSWER
from docloom.operators import converse, inference
from docloom.plans import answer

AT = dt.datetime(2024, 1, 1)


def exchanges(spark, sessions):
    rows = [(s, AT + dt.timedelta(minutes=i), x) for s, xs in sessions.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "session string, ts timestamp, exchange string")


def kept(df):
    got = {}
    for r in df.orderBy("session", "ts").collect():
        got.setdefault(r.session, []).append(r.question)
    return got


def test_last_exchanges_default_and_compat(spark):
    sessions = {f"s{n}": [f"q{i}___a{i}" for i in range(n)] for n in (1, 5, 6, 7)}
    first = converse.first_answers(converse.parse_exchanges(exchanges(spark, sessions)))
    q = lambda a, b: [f"q{i}" for i in range(a, b)]
    assert kept(converse.last_exchanges(first)) == {"s1": q(0, 1), "s5": q(0, 5), "s6": q(1, 6), "s7": q(2, 7)}
    assert kept(converse.last_exchanges(first, compat=True)) == {"s1": q(0, 1), "s5": q(0, 5), "s6": q(0, 5), "s7": q(1, 6)}


def test_repeated_negative_and_malformed_exchanges(spark):
    stored = exchanges(spark, {"s": ["q___I am not sure", "q___first", "q___second", "r___x___y", "only", "z___I'm not sure ok"]})
    got = converse.first_answers(converse.parse_exchanges(stored)).collect()
    assert [(r.question, r.answer) for r in got] == [("q", "first")]


def test_response_parsing(spark):
    rows = [
        (["\"a\\nb\""], None, None), (["\"a", "b\""], None, None), (["plain"], None, None), (["[1]"], None, None),
        (['"x"'], "SAFETY", "why"), (None, "SAFETY", None), (['"x","v"'], None, None), (["12"], None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r struct<parts: array<string>, block_reason: string, block_message: string>")
    got = [r[0] for r in df.orderBy("i").select(converse.answer_text(F.col("r"))).collect()]
    assert got[:1] + got[2:6] == ["a\nb", None, None, "Response blocked by model. SAFETY why", "Response blocked by model. SAFETY"]
    assert got[1] is None and got[6:] == ["x", "12"]  # what follows the first value is not read


def test_prompt_keeps_any_content(spark):
    df = spark.createDataFrame([("100%s {x} \\1 $1",)], "c string")
    prompt = df.select(converse.context_prompt(F.col("c"), converse.expertise(F.lit(" ")), F.lit(False))).first()[0]
    assert prompt.startswith(DEFAULT_EXPERTISE + "\n") and prompt.endswith("KB_CONTENT:\n 100%s {x} \\1 $1\n")


def test_links_keep_their_best_score(spark):
    hits = spark.createDataFrame(
        [("r", "a", 0.5, "l1"), ("r", "b", 0.9, "l2"), ("r", "c", 0.7, "l1"), ("r", "d", 0.99, " ")],
        "request_id string, id string, score double, link string",
    )
    links = converse.source_links(hits).first().links
    assert [(x.link, x.distance) for x in links] == [("l2", 0.9), ("l1", 0.7)]
    shown = spark.range(1).select(
        F.size(converse.shown_links(F.lit("well, I am not sure."), F.array(F.struct(F.lit("l").alias("link"), F.lit(1.0).alias("distance")))))
    )
    assert shown.first()[0] == 0


def test_whole_answer(spark):
    texts = {"k___f1___0": "apples grow on trees", "k___f2___0": "rivers run to the sea"}
    embed = inference.hashing_embedder(64)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in zip(texts, embed(list(texts.values())), strict=True)], "id string, embedding array<float>")
    cells = spark.createDataFrame(
        [(k, q, AT, t if q == "content" else "link " + k) for k, t in texts.items() for q in ("content", "link")],
        "row_key string, qualifier string, ts timestamp, value string",
    )
    questions = spark.createDataFrame(
        [("1", "where do apples grow", "s", None), ("2", "zzz", "s2", None), ("3", " ", "s", None), ("4", "apples grow", None, None)],
        "request_id string, text string, session_id string, parameters struct<botContextExpertise: string, "
        "includeOwnKnowledgeEnrichment: boolean, maxNeighbors: int, temperature: double, maxOutputTokens: int, topK: int, topP: double>",
    )
    models = answer.AnswerModels(embed=embed)
    stored = exchanges(spark, {"s": ["old question___old answer"]})
    got = {r.request_id: r for r in answer.answer(questions, vectors, cells, stored, models=models).collect()}
    assert got["1"].source_links[0].link == "link k___f1___0" and "apples grow on trees" in got["1"].prompt
    assert [t.content for t in got["1"].turns] == ["old question", "old answer", "where do apples grow"]
    assert got["1"].summary.startswith("Summary ") and got["2"].summary == ""
    assert got["2"].answer == NEGATIVE_ANSWER and got["2"].source_links == []
    assert got["3"].failure == "The question is blank" and got["4"].failure.startswith("The session id")

    def failing(prompts, turns, parameters):
        raise RuntimeError("down")

    models = answer.AnswerModels(embed=embed, chat=failing)
    got = {r.request_id: r.failure for r in answer.answer(questions, vectors, cells, stored, models=models).collect()}
    assert got["1"] == got["2"] == "RuntimeError: down"


def test_a_repeated_batch_asks_no_model(spark, tmp_path):
    """The second time the batch is stored already: nothing is embedded, searched or asked."""
    embed = inference.hashing_embedder(8)
    vectors = spark.createDataFrame([("k___f1___0", embed(["apples grow"])[0].tolist())], "id string, embedding array<float>")
    cells = spark.createDataFrame([("k___f1___0", "content", AT, "apples grow")], "row_key string, qualifier string, ts timestamp, value string")
    questions = spark.createDataFrame(
        [("1", "apples", "s", None)],
        "request_id string, text string, session_id string, parameters struct<botContextExpertise: string, "
        "includeOwnKnowledgeEnrichment: boolean, maxNeighbors: int, temperature: double, maxOutputTokens: int, topK: int, topP: double>",
    )
    sessions, models = answer.open_sessions(spark, str(tmp_path)), answer.AnswerModels(embed=embed)

    def store(batch):
        return answer.answer_and_store(questions, vectors, cells, sessions, F.lit(AT), models=models, writer="w", batch=batch)

    first, again = store(0), store(0)
    assert first.count() == 1 and again.count() == 0
    simple = lambda df: [(f.name, f.dataType) for f in df.schema]
    assert simple(again) == simple(first)
    assert sessions.table("exchanges").count() == sessions.table("interactions").count() == 1
    assert store(1).count() == 1 and sessions.table("exchanges").count() == 2
