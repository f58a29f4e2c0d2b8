"""Centroid clustering of integer vectors in JVM expressions only.

Vectors are kept once as integer arrays. A round is one scan of them:
``zip_with`` and ``aggregate`` give the squared distance to each centroid of a
literal array, ``array_min`` of (distance, number) structs picks the nearest,
and one hash aggregate with a plain sum per component gives the centroids of
the next round. Only ``k`` rows of sums travel to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.session import scratch_path

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, "2:"
#: Components below this make squared distances of up to 512 components fit a long.
LONG_SAFE = 1 << 26
LARGEST = 10 ** 17


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, v``: the usable vectors as ``floor(scale * x)`` in decimal(38,0)."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = ((F.size(x) == dimensions)
              & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))))
    whole = F.transform(x, lambda a: F.greatest(F.least(F.floor(a * F.lit(float(scale)), F.lit(0)), F.lit(float(LARGEST))),
                                                F.lit(-float(LARGEST))).cast("decimal(38,0)"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                                             whole.alias("v"))


def literal_arrays(rows: list[list[int]], kind: str) -> Column:
    """One literal ``array<array<kind>>``; as text, since a call for every number would cost a round its time."""
    suffix = "L" if kind == "bigint" else "BD"
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}{suffix}" for x in r) + ")" for r in rows) + ")"
                  ).cast(f"array<array<{kind}>>")


def nearest(vector: Column, centroids: list[list[int]], kind: str) -> Column:
    """Struct ``(d, k)`` of the nearest centroid; of equally near ones that with the least number.
    The centroids are one literal, folded to an array by the optimizer."""
    table = literal_arrays(centroids, kind)
    zero = F.lit(0).cast(kind)

    def distance(c: Column) -> Column:
        square = F.zip_with(vector, c, lambda a, b: ((a - b) * (a - b)).cast(kind))
        return F.aggregate(square, zero, lambda s, q: (s + q).cast(kind))

    return F.array_min(F.transform(table, lambda c, i: F.struct(distance(c).alias("d"), i.cast("int").alias("k"))))


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, rounds: int = ROUNDS,
                      scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Lloyd's rounds over integer vectors, exact at every step.

    Vectors with other than ``dimensions`` components, or with a null or
    non-finite one, are left out. Centroids start as the vectors of the least
    SHA-256 of ``seed`` and the id; of equal ids the least vector goes first,
    null ids go last, and with fewer vectors there are fewer centroids. Ties
    in distance go to the smaller number; an empty cluster keeps its centroid.
    Repeated rows each count. Components are taken to +-10**17 at most; sums
    and distances are exact, as longs where the largest component and the
    number of rows prove that they fit, else as decimal(38,0).

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, centroid``; a distance or inertia beyond a long is null.
    Other columns are not read. An empty input gives an empty result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "vectors")
    integer_vectors(df, id_col, vector_col, dimensions, scale).write.parquet(path)
    kept = spark.read.parquet(path)
    n, top = kept.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("decimal(38,0)"),
                                                      lambda s, a: F.greatest(s, F.abs(a))))).first()
    top = int(top or 0)
    kind = "bigint" if top < LONG_SAFE and dimensions <= 512 else "decimal(38,0)"
    total = "bigint" if kind == "bigint" and n * max(4 * top * top * dimensions, 1) < 2 ** 62 else "decimal(38,0)"
    if kind == "bigint":  # half the bytes for each scan of a round
        path = scratch_path(spark, "vectors-long")
        kept.withColumn("v", F.col("v").cast("array<bigint>")).write.parquet(path)
        kept = spark.read.parquet(path)
    start = (kept.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
             .orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect())
    centres = [[int(x) for x in row["v"]] for row in start]
    best = nearest(F.col("v"), centres, kind) if centres else F.lit(None).cast(f"struct<d:{kind},k:int>")
    sums = [F.sum(F.col("v")[j].cast(total)).alias(f"s{j}") for j in range(dimensions)]
    for _ in range(rounds if centres else 0):
        for row in (kept.select(best["k"].alias("k"), "v").groupBy("k").agg(F.count("*").alias("n"), *sums).collect()):
            centres[row["k"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dimensions)]
        best = nearest(F.col("v"), centres, kind)
    path = scratch_path(spark, "assigned")
    kept.select("vec_id", best.alias("b")).write.parquet(path)  # as a struct: its two fields would compute it twice
    assigned = spark.read.parquet(path).select("vec_id", "b.k", "b.d")
    inertia = {r["k"]: int(r["s"]) for r in assigned.groupBy("k").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("s")).collect()}

    def of_cluster(values: list) -> Column:
        return F.get(F.array(*[F.lit(x) for x in values or [""]]), F.col("k"))

    def as_long(c: Column) -> Column:
        return c.cast("decimal(38,0)").try_cast("bigint")

    numbers = range(len(centres))
    texts = [",".join(map(str, c)) for c in centres]
    return assigned.select(
        "vec_id", F.col("k").alias("cluster"), as_long(F.col("d")).alias("distance"),
        as_long(of_cluster([str(inertia.get(k, 0)) for k in numbers])).alias("cluster_inertia"),
        as_long(F.lit(str(sum(inertia.values()))).cast("decimal(38,0)")).alias("inertia"),
        of_cluster([hashlib.sha256(t.encode()).hexdigest() for t in texts]).alias("centroid_sha256"),
        F.split(of_cluster(texts), ",").cast("array<decimal(38,0)>").alias("centroid"))


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``: 40 centroids over 64 components of 1/256, five rounds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return centroid_clusters(vectors).drop("centroid")


def _oracle() -> str:
    """The rounds as one chain of CTEs: distances to all centroids, the nearest, exact floored means."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, b.k AS k, b.d AS d FROM (SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v,
    min({{'d': CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': c.k}}) AS b
  FROM kept x CROSS JOIN c{i} c GROUP BY x.r))""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
    SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"""


ORACLE = _oracle()
