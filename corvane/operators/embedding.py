"""Embeddings as data: hashing encoder, supplied encoders, checks, routing, reuse."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import sliced

#: Words whose places a task keeps between slices.
KNOWN = 500_000


def hash_embed(df: DataFrame, column: str, dim: int, kind: str = "passage") -> DataFrame:
    """embedding: words of "kind:text" hashed to signed dimensions, unit length (zero
    vectors stay)."""

    @sliced("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        one = _hasher(dim, kind)
        return texts.map(lambda t: one(t).astype(np.float32))

    return df.withColumn("embedding", embed(column))


def _placer(dim: int, known: dict[str, tuple[int, int]]) -> Callable[[str], tuple[int, int]]:
    """word -> its dimension and sign; words met before are looked up in known."""

    def place(word: str) -> tuple[int, int]:
        if word not in known:
            digest = hashlib.sha256(word.encode()).digest()
            known[word] = int.from_bytes(digest[:4], "big") % dim, 1 if digest[4] % 2 == 0 else -1
        return known[word]

    return place


def _hasher(dim: int, kind: str) -> Callable[[str | None], np.ndarray]:
    """text -> its vector."""
    place = _placer(dim, {})

    def one(text: str | None) -> np.ndarray:
        vector = np.zeros(dim)
        for word in f"{kind}:{text or ''}".lower().split():
            i, sign = place(word)
            vector[i] += sign
        norm = np.linalg.norm(vector)
        return vector / norm if norm else vector

    return one


def likeness_to_previous(column: str, dim: int, kind: str = "passage") -> Column:
    """array of texts -> cosine of each text's hash embedding with that of the one before
    (the first: 1; of a zero vector: 0)."""

    known: dict[str, tuple[int, int]] = {}

    @sliced("array<double>")
    def alike(lists: pd.Series) -> pd.Series:
        if len(known) > KNOWN:
            known.clear()
        place = _placer(dim, known)

        def row(texts) -> list[float]:
            if not len(texts):
                return []
            # all texts of a row are one count of cells; sums of signs are whole, so they are exact
            words = [f"{kind}:{t or ''}".lower().split() for t in texts]
            places = np.array([place(w) for own in words for w in own], np.int64).reshape(-1, 2)
            cells = np.repeat(np.arange(len(words)) * dim, [len(own) for own in words]) + places[:, 0]
            vectors = np.bincount(cells, places[:, 1], len(words) * dim).reshape(-1, dim)
            norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            vectors = list(np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0))
            return [1.0, *(float(a @ b) for a, b in zip(vectors, vectors[1:]))][: len(vectors)]

        return lists.map(row)

    return alike(column)


def hash_embed_native(df: DataFrame, column: str, id_column: str, dim: int, kind: str = "passage") -> DataFrame:
    """The same in long form (id, dimension, value), without Python: for joins and checks."""
    words = F.filter(F.split(F.lower(F.concat(F.lit(f"{kind}:"), F.coalesce(column, F.lit("")))), r"\s+"), lambda w: w != "")
    hashed = df.select(id_column, F.explode(words).alias("w")).select(id_column, F.sha2("w", 256).alias("h"))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    cells = hashed.select(id_column, (number(1, 8) % dim).alias("dimension"), F.when(number(9, 2) % 2 == 0, 1).otherwise(-1).alias("sign"))
    sums = cells.groupBy(id_column, "dimension").agg(F.sum("sign").cast("double").alias("value"))
    norms = sums.groupBy(id_column).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return sums.join(norms, id_column).where("value <> 0").select(id_column, "dimension", (F.col("value") / F.col("norm")).alias("value"))


def model_embed(df: DataFrame, column: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", batch: int = 8) -> DataFrame:
    """embedding from a supplied encoder, made once per task and fed in batches; rows of
    its matrix are scaled to unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            texts = [prefix + (t or "") for t in frame[column]]
            parts = [np.asarray(encode(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 1))
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
            yield frame.assign(embedding=list(matrix.astype(np.float32)))

    return df.mapInPandas(run, df.withColumn("embedding", F.array(F.lit(0.0).cast("float"))).schema)


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 if a norm is 0; vectors of different lengths are an error."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms))


def validate_embeddings(df: DataFrame, registry: DataFrame) -> DataFrame:
    """df (chunk_id, model, model_version, embedding): first problem of each bad row."""
    joined = df.join(F.broadcast(registry), ["model", "model_version"], "left")  # a registry has a row for each model
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.col("dimension").isNull(), "UNKNOWN_MODEL").when(~F.col("enabled"), "DISABLED_MODEL").when(F.size("embedding") != F.col("dimension"), "DIMENSION").when(bad, "NOT_FINITE")
    return joined.withColumn("problem", problem).where("problem is not null").select("chunk_id", "problem")


def route_by_dimension(df: DataFrame, allowed: tuple[int, ...] = (768, 1024, 1536)) -> DataFrame:
    """dim, to partition a table by; route says where a row goes, ERROR if nowhere."""
    size = F.size("embedding")
    return df.withColumn("dim", size).withColumn("route", F.when(size.isin(*allowed), F.concat(F.lit("dim="), size.cast("string"))).otherwise("ERROR"))


def embeddable(df: DataFrame) -> DataFrame:
    """Chunks that may be embedded: CLEAN ones."""
    return df.where("phi_scan_status = 'CLEAN'")


def embed_distinct(df: DataFrame, column: str, dim: int, model: str = "hash", version: str = "1") -> DataFrame:
    """Each distinct normalised text is encoded once and joined back by its key."""
    keyed = df.withColumn("_text", F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))).withColumn("key", F.sha2(F.concat_ws("\n", "_text", F.lit(model), F.lit(version)), 256))
    once = hash_embed(keyed.groupBy("key").agg(F.first("_text").alias("_text")), "_text", dim).select("key", "embedding")
    return keyed.drop("_text").join(once, "key")
