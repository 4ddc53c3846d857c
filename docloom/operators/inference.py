"""Model calls as batch-inference stages, with functions the caller injects.

A model function gets one Arrow batch and returns one value per row, so a client is
made once per task and calls can be grouped.  A call that fails becomes an error
column of its rows, never a failed job.  The defaults need no model and give the same
result everywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.fixed_values import EMBEDDING_INPUT_TYPES, NEGATIVE_ANSWER, VECTOR_DIMENSIONS
from docloom.functions.text import base64_text, is_blank
from docloom.sources.schemas import EMBEDDING_PREDICTION

PUNCTUATION = ".,?!"

Embed = Callable[[list[str]], np.ndarray]
ChunkLinks = Callable[[list[str], list[str]], list[str]]
Chat = Callable[[list[str], list[list[tuple[str, str]]], list[dict]], list[dict]]
Summarise = Callable[[list[str]], list[str]]
EmbedInstances = Callable[[list[dict]], list[dict]]

#: Bytes of instances that a model is sent at once.
INSTANCE_BYTES = 8 << 20

#: Rows and characters of texts whose vectors are held at once.
CALL_ROWS, CALL_CHARACTERS = 512, 4 << 20

#: Words that the default embedder remembers, and the longest of them.
SLOTS, SLOT_CHARACTERS = 300_000, 64


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Redistribute rows evenly before a slow stage.

    An explicit count is kept by adaptive execution, so a few large input splits do not
    decide how many model calls run at once.
    """
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Redistribute only an input with fewer splits than there are cores.

    A large input has many even splits already and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return spread(df, cores) if df.rdd.getNumPartitions() < cores else df


# --- default embedder ----------------------------------------------------------


class _Slots(dict):
    """Twice the dimension of a word, one more for a negative sign; -1 for no word.  Bounded."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if not word:
            return -1
        digest = hashlib.md5(word.encode()).digest()
        slot = 2 * (int.from_bytes(digest[:4]) % self.dimensions) + (digest[4] >> 7)
        if len(word) <= SLOT_CHARACTERS:
            if len(self) >= SLOTS:
                self.clear()
            self[word] = slot
        return slot

    def __reduce__(self):
        return _Slots, (self.dimensions,)


def hashing_embedder(dimensions: int = VECTOR_DIMENSIONS) -> Embed:
    """Signed feature hashing of the words, scaled to length one.

    A stand-in for a hosted model: the first eight hex digits of a word's MD5 choose the
    dimension, the ninth the sign.
    """

    slots = _Slots(dimensions)

    def words_of(text: str) -> list[str]:
        text = text.lower()
        for mark in PUNCTUATION:
            text = text.replace(mark, "")
        return text.split(" ")

    def embed(texts: list[str]) -> np.ndarray:
        held = [words_of(text) for text in texts]
        counts = np.array([len(words) for words in held], dtype=np.int64)
        found = np.fromiter(map(slots.__getitem__, chain.from_iterable(held)), np.int64, counts.sum())
        row = np.repeat(np.arange(len(texts)), counts)[found >= 0]
        found = found[found >= 0]
        # whole numbers, so that their sums are exact in any order
        sums = np.bincount(row * dimensions + (found >> 1), 1.0 - 2 * (found & 1), len(texts) * dimensions)
        out = sums.reshape(len(texts), dimensions)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def _with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(fields))


def _one_by_one(call: Callable[[list], list], items: list) -> tuple[list, list[str | None]]:
    """Answers and failures of items: in one call, or item by item where that fails."""
    try:
        answers = list(call(items))
        if len(answers) != len(items):
            raise ValueError(f"{len(answers)} answers for {len(items)} items")
        return answers, [None] * len(items)
    except Exception as error:  # noqa: BLE001 - any model failure is data here
        if len(items) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
    answers, failures = [], []
    for item in items:
        answer, failure = _one_by_one(call, [item])
        answers += answer
        failures += failure
    return answers, failures


def _calls(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of no more than ``CALL_ROWS`` rows and ``CALL_CHARACTERS`` of text (a row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            fit = int(np.searchsorted(ends, before + CALL_CHARACTERS, side="right"))
            end = max(start + 1, min(start + CALL_ROWS, fit))
            yield batch.slice(start, end - start)
            start = end


def _vector_column(vectors: list[np.ndarray | None]) -> pa.Array:
    """Vectors as one list column, null for none."""
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in vectors)])
    flat = np.concatenate([np.empty(0, dtype=np.float32), *(v for v in vectors if v is not None)])
    none = pa.array([v is None for v in vectors], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=none)


def embed_texts(
    df: DataFrame,
    text: str = "chunk",
    embed: Embed | None = None,
    max_tokens: int | None = None,
    dimensions: int | None = None,
) -> DataFrame:
    """Add ``embedding``, ``token_count``, ``truncated`` and ``embed_error`` to every row.

    Whole texts reach the model; one that takes no more than ``max_tokens`` gets so many and the row
    says that it was ``truncated``.  With ``dimensions`` vectors are cut to so many and scaled to length
    one.  A batch that fails is asked again row by row, so that one bad text costs its own row only.
    """
    embed = embed or hashing_embedder()
    schema = _with_fields(
        df,
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("embed_error", T.StringType()),
    )

    def vectors_of(texts: list[str]) -> list[np.ndarray]:
        vectors = np.asarray(embed(texts), dtype=np.float32)
        if dimensions is None or not len(vectors):
            return list(vectors)
        short = vectors[:, :dimensions].astype(np.float64)
        norm = np.linalg.norm(short, axis=1, keepdims=True)
        return list((short / np.where(norm > 0, norm, 1)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _calls(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts = [len(t.split()) for t in texts]
            cut = [max_tokens is not None and c > max_tokens for c in counts]
            texts = [" ".join(t.split()[:max_tokens]) if c else t for t, c in zip(texts, cut, strict=True)]
            vectors, failures = _one_by_one(vectors_of, texts)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {
                "embedding": _vector_column(vectors),
                "token_count": pa.array(counts, pa.int32()),
                "truncated": pa.array(cut, pa.bool_()),
                "embed_error": pa.array(failures, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embed_error").isNull())


def embed_failures(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embed_error").isNotNull())


def embedding_statistics(df: DataFrame) -> DataFrame:
    """Token totals and truncated instances per document."""
    return df.groupBy("key").agg(
        F.sum("token_count").alias("tokens"),
        F.count_if("truncated").alias("truncated"),
        F.count("*").alias("instances"),
    )


# --- embedding requests and responses ------------------------------------------


def embedding_instance(input_type: Column, data: Column) -> Column:
    """Model instance of a datum by input type; null for an unknown type."""
    image = "struct<bytesBase64Encoded: string, gcsUri: string, mimeType: string>"
    segment = "struct<startOffsetSec: int, endOffsetSec: int, intervalSec: int>"
    video = f"struct<bytesBase64Encoded: string, gcsUri: string, videoSegmentConfig: {segment}>"
    raw = F.when(input_type.endswith("_RAW"), data)
    link = F.when(input_type.endswith("_LINK"), data)
    media = F.struct(
        raw.alias("bytesBase64Encoded"), link.alias("gcsUri"), F.lit(None).cast("string").alias("mimeType")
    )
    clip = F.struct(
        raw.alias("bytesBase64Encoded"),
        link.alias("gcsUri"),
        F.lit(None).cast(segment).alias("videoSegmentConfig"),
    )
    return F.when(
        input_type.isin(EMBEDDING_INPUT_TYPES),
        F.struct(
            F.when(input_type == "TEXT", data).alias("text"),
            F.when(input_type.startswith("IMAGE"), media).cast(image).alias("image"),
            F.when(input_type.startswith("VIDEO"), clip).cast(video).alias("video"),
        ),
    )


def instance_failure(instance: Column) -> Column:
    """Why an instance cannot be sent, null if it can."""

    def empty(media: Column) -> Column:
        return media.isNotNull() & media["bytesBase64Encoded"].isNull() & media["gcsUri"].isNull()

    return (
        F.when(instance.isNull(), "Embedding input type is not supported")
        .when(
            instance["text"].isNull() & instance["image"].isNull() & instance["video"].isNull(),
            "Nothing to embed: neither text nor image nor video",
        )
        .when(empty(instance["image"]), "The image has neither bytes nor a place")
        .when(empty(instance["video"]), "The video has neither bytes nor a place")
    )


def prediction_vector(prediction: Column) -> Column:
    """The vector of a prediction: text, else image, else the first video segment."""
    return F.coalesce(
        prediction["textEmbedding"],
        prediction["imageEmbedding"],
        F.get(prediction["videoEmbeddings"], F.lit(0))["embedding"],
    )


def digest_instances(instances: list[dict]) -> list[dict]:
    """Default model of typed instances: four numbers from the digest of what an instance holds."""
    predictions = []
    for instance in instances:
        media = instance["image"] or instance["video"] or {}
        held = instance["text"] or media.get("bytesBase64Encoded") or media.get("gcsUri")
        vector = [byte / 255 for byte in hashlib.md5(held.encode()).digest()[:4]]
        segment = [{"startOffsetSec": 0, "endOffsetSec": 0, "embedding": vector}]
        predictions.append(
            {
                "textEmbedding": vector if instance["text"] else None,
                "imageEmbedding": vector if instance["image"] else None,
                "videoEmbeddings": segment if instance["video"] else None,
            }
        )
    return predictions


def typed_instances(data: DataFrame) -> DataFrame:
    """Add ``instance`` and ``embed_error`` to rows of ``kind``, ``text`` (text or place) and ``bytes``."""
    held = F.when(F.col("kind").endswith("_RAW"), base64_text(F.col("bytes"))).otherwise(F.col("text"))
    with_instance = data.withColumn("instance", embedding_instance(F.col("kind"), held))
    return with_instance.withColumn("embed_error", instance_failure(F.col("instance")))


def embed_instances(data: DataFrame, model: EmbedInstances = digest_instances, batch_bytes: int = INSTANCE_BYTES) -> DataFrame:
    """Vectors of texts, images and videos in one stage.

    ``data`` has ``kind`` (one of the five input types), ``text`` and ``bytes``; its other columns stay.
    Added are ``embedding`` and ``embed_error``: an instance that cannot be sent is an error row and
    costs no call.  The model gets instances of no more than ``batch_bytes`` at once (one, if that is
    larger), and those of a call that fails one by one.
    """
    rows = typed_instances(data).drop("text", "bytes")
    sizes = (F.coalesce(F.length(x), F.lit(0)) for x in ("instance.text", "instance.image.bytesBase64Encoded", "instance.video.bytesBase64Encoded"))
    sized = rows.withColumn("_size", sum(sizes, F.lit(0)))
    schema = _with_fields(
        rows.drop("instance"),
        T.StructField("embed_error", T.StringType()),
        T.StructField("prediction", T.StructType.fromDDL(EMBEDDING_PREDICTION)),
    )

    def calls(sizes: list[int]) -> Iterator[slice]:
        start, total = 0, 0
        for at, size in enumerate(sizes):
            if at > start and total + size > batch_bytes:
                yield slice(start, at)
                start, total = at, 0
            total += size
        if start < len(sizes):
            yield slice(start, len(sizes))

    def plain(instance) -> dict:
        return {name: dict(value) if isinstance(value, dict) else value for name, value in instance.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            predictions: list[dict | None] = [None] * len(batch)
            failures = batch["embed_error"].tolist()
            good = [k for k, failure in enumerate(failures) if failure is None]
            sizes = batch["_size"].tolist()
            for part in calls([sizes[k] for k in good]):
                own = good[part]
                found, wrong = _one_by_one(model, [plain(batch["instance"][k]) for k in own])
                for k, prediction, failure in zip(own, found, wrong, strict=True):
                    predictions[k], failures[k] = prediction, failure
            yield batch.drop(columns=["instance", "_size"]).assign(
                embed_error=pd.Series(failures, dtype=object), prediction=pd.Series(predictions, dtype=object)
            )[schema.names]

    predicted = sized.mapInPandas(run, schema)
    return predicted.withColumn("embedding", prediction_vector(F.col("prediction"))).drop("prediction")


# --- chunking by a model -------------------------------------------------------


def describe_links(links: list[str], types: list[str]) -> list[str]:
    """Default for linked files: the only known text is the link itself."""
    return [json.dumps([f"{kind} {link}"]) for link, kind in zip(links, types, strict=True)]


def chunk_links(contents: DataFrame, chunk: ChunkLinks = describe_links, *keep: str) -> DataFrame:
    """Model responses for linked files: ``key, response, chunk_error`` and ``keep``, one row per link.

    A batch that fails is asked again link by link.
    """
    links = contents.select("key", *keep, "type", F.explode("content").alias("link")).filter(~is_blank(F.col("link")))
    out = _with_fields(
        links.drop("type", "link"), T.StructField("response", T.StringType()), T.StructField("chunk_error", T.StringType())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = list(zip(batch["link"].tolist(), batch["type"].tolist(), strict=True))
            answers, failures = _one_by_one(lambda own: chunk([link for link, _ in own], [kind for _, kind in own]), asked)
            yield batch.drop(columns=["type", "link"]).assign(
                response=pd.Series(answers, index=batch.index, dtype=object),
                chunk_error=pd.Series(failures, index=batch.index, dtype=object),
            )[out.names]

    return links.mapInPandas(run, out)


# --- summaries and chat --------------------------------------------------------


def digest_summary(prompts: list[str]) -> list[str]:
    """Default summary: names the whole prompt by its digest."""
    return ["Summary " + hashlib.md5(p.encode()).hexdigest() for p in prompts]


def summarise(df: DataFrame, model: Summarise = digest_summary) -> DataFrame:
    """Add ``summary`` from ``summary_prompt``; rows without a prompt get ``''`` and cost no call."""
    schema = _with_fields(
        df, T.StructField("summary", T.StringType()), T.StructField("summary_error", T.StringType())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(summary="", summary_error=None)
            some = batch["summary_prompt"].notna()
            if some.any():
                answers, failures = _one_by_one(model, batch.loc[some, "summary_prompt"].tolist())
                batch.loc[some, "summary"] = ["" if answer is None else answer for answer in answers]
                batch["summary_error"] = batch["summary_error"].astype(object)
                batch.loc[some, "summary_error"] = pd.Series(failures, index=batch.index[some], dtype=object)
            yield batch[schema.names]

    return df.mapInPandas(run, schema)


def digest_chat(
    prompts: list[str], turns: list[list[tuple[str, str]]], parameters: list[dict]
) -> list[dict]:
    """Default chat: a digest of prompt and turns, or the negative answer without content."""
    answers = []
    for prompt, said in zip(prompts, turns, strict=True):
        whole = prompt + "\n".join(f"{author}: {content}" for author, content in said)
        known = prompt.split("KB_CONTENT:\n", 1)[-1].strip() != ""
        text = "Answer " + hashlib.md5(whole.encode()).hexdigest() if known else NEGATIVE_ANSWER
        answers.append({"parts": [json.dumps(text)], "block_reason": None, "block_message": None})
    return answers


def chat(df: DataFrame, model: Chat = digest_chat) -> DataFrame:
    """Add ``response`` (parts, block reason and message) from ``prompt``, ``turns``, ``model_parameters``."""
    response = T.StructType(
        [
            T.StructField("parts", T.ArrayType(T.StringType())),
            T.StructField("block_reason", T.StringType()),
            T.StructField("block_message", T.StringType()),
        ]
    )
    schema = _with_fields(
        df, T.StructField("response", response), T.StructField("chat_error", T.StringType())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [[(t["author"], t["content"]) for t in row] for row in batch["turns"]]
            asked = list(zip(batch["prompt"].tolist(), turns, batch["model_parameters"].tolist(), strict=True))
            answers, failures = _one_by_one(lambda own: model(*map(list, zip(*own, strict=True))), asked)
            yield batch.assign(
                response=pd.Series(answers, index=batch.index, dtype=object),
                chat_error=pd.Series(failures, index=batch.index, dtype=object),
            )[schema.names]

    return df.mapInPandas(run, schema)
