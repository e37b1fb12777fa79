"""Vectors as arrays: products, norms, means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    # the norm as a variable of an outer lambda: inside the inner one it would be computed for every element
    n = F.array(F.greatest(norm(v), F.lit(1e-12)))
    return F.transform(n, lambda n: F.transform(as_double(v), lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sum_vectors(df, keys: list[str], vec: str, out: str = "total"):
    """Sum of vectors per group.

    Batches are summed as matrices, a task keeps one sum per group, and only those sums are
    shuffled; a task lets them go whenever it holds some thousands of groups. Null vectors don't
    count; all vectors of a group must have one length.
    """
    import numpy as np
    import pyarrow as pa

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _v array<double>"

    def partial(batches):
        held: dict = {}

        def out_of():
            cols = list(zip(*held)) if held else [[] for _ in keys]
            like = [types[k] for k in keys]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, like)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*keys, "_v"])
            held.clear()

        types: dict = {}
        for b in batches:
            types = {k: b.schema.field(k).type for k in keys}
            v = b.column(vec)
            length = np.asarray(v.value_lengths().fill_null(-1))
            groups = list(zip(*(b.column(k).to_pylist() for k in keys)))
            for n in np.unique(length[length >= 0]).tolist():
                at = np.flatnonzero(length == n)
                x = np.asarray(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), n)
                number: dict = {}
                inside = np.array([number.setdefault(groups[i], len(number)) for i in at.tolist()], int)
                total = np.zeros((len(number), n))
                np.add.at(total, inside, x)
                for g, t in zip(number, total):
                    held[g] = held[g] + t if g in held else t
            if len(held) > 4_000:
                yield from out_of()
        if held:
            yield from out_of()

    return (
        df.select(*keys, as_double(F.col(vec)).alias(vec))
        .mapInArrow(partial, schema)
        .select(*keys, F.posexplode("_v").alias("_i", "_x"))
        .groupBy(*keys, "_i")
        .agg(F.sum("_x").alias("_x"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(out))
    )
