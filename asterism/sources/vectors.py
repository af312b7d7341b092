"""Vector sources: stored vectors, hashed bag-of-words vectors, and any sentence model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.vector import as_vector, norm
from ..session import durable

HASH_DIM = 64


def load_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "features") -> DataFrame:
    """(id, features) from any frame that holds numeric arrays."""
    return df.select(F.col(id_col).cast("long").alias("id"), as_vector(F.col(vector_col)).alias("features"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors, their smallest and largest size and L2 norm."""
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size("features")).alias("min_dim"),
        F.max(F.size("features")).alias("max_dim"),
        F.min(norm(F.col("features"))).alias("min_norm"),
        F.max(norm(F.col("features"))).alias("max_norm"),
    )


# Embedding functions are declared nondeterministic although they are not: the optimizer then
# never evaluates one a second time for a filter it derives from their result.


def unit_rows(matrix: np.ndarray) -> pa.ListArray:
    """The rows scaled to unit length (zero rows stay) as an Arrow list array."""
    n, dim = matrix.shape
    size = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    scaled = matrix / np.where(size == 0.0, 1.0, size)[:, None]
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(scaled.ravel()))


def _code(term: Column) -> Column:
    """The first 32 bits of a term's MD5 as a number."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long")


_TERMS = 1 << 18  # counted at once


def _hash_embedder(dim: int):
    """Vectors from codes modulo 2 * dim, which say both the place of a term and its sign."""

    @F.arrow_udf("array<double>")
    def embed(terms: pa.Array) -> pa.Array:
        n = len(terms)
        code = terms.flatten().to_numpy(zero_copy_only=False)
        length = terms.value_lengths().to_numpy()
        ends = np.cumsum(length)
        counts, start = np.zeros((n, dim)), 0
        while start < n:  # few terms at once, however long the texts of a batch are
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _TERMS, side="right")))
            part = code[before : int(ends[stop - 1])].astype(np.int64)
            row = np.repeat(np.arange(stop - start), length[start:stop])
            both = np.bincount(row * (2 * dim) + part, minlength=(stop - start) * 2 * dim).reshape(-1, 2, dim)
            counts[start:stop] = both[:, 0] - both[:, 1]
            start = stop
        return unit_rows(counts)

    return embed.asNondeterministic()


def embed_hash(
    df: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = HASH_DIM, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, text, features) and ``keep`` columns: signed counts of hashed terms, L2-normalised. Needs no model.

    A text is embedded from its own row alone, so nothing is shuffled. Texts without terms get
    the zero vector.
    """
    return df.select(
        *keep,
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        _hash_embedder(dim)(
            F.transform(tokenize(F.col(text_col)), lambda t: (_code(t) % (2 * dim)).cast("int"))
        ).alias("features"),
    )


def embed_with(
    df: DataFrame,
    load_model: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    id_col: str = "id",
    text_col: str = "text",
    batch_size: int = 64,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, text, features) from any model, L2-normalised.

    ``load_model`` runs once per task and returns a function from a list of texts to an n x d
    matrix. Copies of a text inside one Arrow batch are embedded once, so a text that makes up
    much of the data costs little and needs neither a shuffle nor a join back.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for batch in batches:
            coded = batch.fill_null("").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            if not texts:
                yield pa.array([], pa.list_(pa.float64()))
                continue
            found = np.vstack([
                np.asarray(model(texts[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(texts), batch_size)
            ])
            yield unit_rows(found[coded.indices.to_numpy()])

    return df.select(
        *keep,
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        embed.asNondeterministic()(F.col(text_col)).alias("features"),
    )


_HOT_TEXT = 100_000  # rows of one text that one part of the join back takes


def embed_distinct(
    df: DataFrame,
    load_model: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    id_col: str = "id",
    text_col: str = "text",
    batch_size: int = 64,
    keep: tuple[str, ...] = (),
    hot: int = _HOT_TEXT,
) -> DataFrame:
    """As ``embed_with``, but every different text of the whole table is embedded once.

    Texts are told apart by 128 bits of hashes; one of each is embedded and its vector stored. Rows get
    theirs by a join on the hashes. A text with more than ``hot`` rows is joined in parts: such texts are at most
    one in ``hot`` rows, so that their list can be broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        *keep, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(64), text).alias("_h2"),
    )
    different = rows.groupBy("_h1", "_h2").agg(F.min(F.coalesce("text", F.lit(""))).alias("_text"), F.count("*").alias("_n"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            if not b.num_rows:
                continue
            model = load_model() if model is None else model
            texts = b.column("_text").to_pylist()
            found = np.vstack([
                np.asarray(model(texts[i : i + batch_size]), dtype=np.float64) for i in range(0, len(texts), batch_size)
            ])
            yield pa.RecordBatch.from_arrays(
                [b.column("_h1"), b.column("_h2"), b.column("_n"), unit_rows(found)], names=["_h1", "_h2", "_n", "features"]
            )

    embedded = durable(different.mapInArrow(embed, "_h1 long, _h2 long, _n long, features array<double>"))
    parts = F.ceil(F.col("_n") / F.lit(hot)).cast("int")
    crowded = embedded.filter(F.col("_n") > hot).select("_h1", "_h2", parts.alias("_parts"))
    dealt = rows.join(F.broadcast(crowded), ["_h1", "_h2"], "left").withColumn(
        "_part", F.pmod(F.xxhash64("id", *keep), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    copies = embedded.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, ["_h1", "_h2", "_part"]).select(*keep, "id", "text", "features")
