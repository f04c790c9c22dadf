"""A run over an album: only new files are described, and only pairs with a new end are compared.

Every table has a part for each run, which a run overwrites if it begins again after a failure, so a part is whole or not
there. Numbers of images and faces go on from run to run: what an earlier run wrote stays valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.operators import compare, providers
from lumen.operators import graph as G
from lumen.operators import similarity as S
from lumen.operators.components import merged

#: Faces of an image at most; the number of a face is that of its image times this, and its place.
FACES = 1 << 20
IMAGES = "image_id long, image_path string, file_size long, dimensions string, exif map<string,string>, description string, faces array<array<double>>, embedding array<double>, run int"
IDENTITIES = "face_id long, match_id long, run int"


def before(spark: SparkSession, path: str, run: int, schema: str) -> DataFrame:
    """What runs before this one wrote; nothing if there is no table yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    rows = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return rows.where(F.col("run") < run)


def unprocessed(files: DataFrame, processed: DataFrame, key: str = "image_path") -> DataFrame:
    """What a run has still to do: files that no earlier run has finished."""
    return files.join(processed, key, "left_anti")


def _part(df: DataFrame, path: str, run: int) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{path}/run={run}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/run={run}")


def process(spark: SparkSession, at: str, run: int, describe, find_faces, settings: S.Settings, threshold: float, exif, token_vectors: DataFrame | None) -> None:
    """Adds a run's parts of images, similarities, edges, matches, identities and results to the tables under `at`."""
    old = before(spark, f"{at}/images", run, IMAGES)
    files = spark.read.format("binaryFile").load(f"{at}/files").select(F.col("path").alias("image_path"), F.col("length").alias("file_size"), "content")
    rows = providers.with_image_info(unprocessed(files, old.select("image_path")), exif=exif)
    rows = providers.with_model(rows, "content", "description", "string", describe, "")
    rows = providers.with_model(rows, "content", "faces", "array<array<double>>", find_faces, [])
    rows = providers.with_vectors(rows, "description").drop("content")
    first = old.agg(F.coalesce(F.max("image_id") + 1, F.lit(0))).first()[0]
    new = S.row_index(rows, "image_path").withColumn("image_id", F.col("idx") + first).drop("idx")
    new = _part(new, f"{at}/images", run)
    columns = ["image_id", "image_path", "description", "embedding", "faces"]
    images = new.select(*columns, F.lit(True).alias("fresh")).unionByName(old.select(*columns, F.lit(False).alias("fresh")))
    faces = images.select("image_id", "fresh", F.posexplode("faces").alias("pos", "embedding")).withColumn("face_id", F.col("image_id") * FACES + F.col("pos"))
    pairs, matches = compare.compare_new(images, faces, settings, token_vectors)
    path = lambda k: images.select(F.col("image_id").alias(k), F.col("image_path").alias(f"p{k}"))
    named = pairs.join(path("i"), "i").join(path("j"), "j")
    named = named.select(F.least("pi", "pj").alias("image1_path"), F.greatest("pi", "pj").alias("image2_path"), "similarity_score", "face_bonus", "face_count")
    found = _part(named, f"{at}/similarities", run)
    _part(G.build(found.select(F.col("image1_path").alias("image1"), F.col("image2_path").alias("image2"), F.col("similarity_score").alias("score")), threshold), f"{at}/edges", run)
    matches = _part(matches, f"{at}/matches", run)
    known = before(spark, f"{at}/identities", run, IDENTITIES)
    last = known.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    known = known.where(F.col("run") == last).select(F.col("face_id").alias("node"), F.col("match_id").alias("root"))
    own = faces.where("fresh").select(F.col("face_id").alias("node"), F.col("face_id").alias("root"))
    groups = _part(merged(known.unionByName(own), matches).select(F.col("node").alias("face_id"), F.col("root").alias("match_id")), f"{at}/identities", run)
    _part(with_identities(images, groups), f"{at}/results", run)


def with_identities(images: DataFrame, groups: DataFrame) -> DataFrame:
    """(image_path, description, face_embeddings) with the match_id of groups (face_id, match_id) in each face, by place."""
    nested = F.transform("faces", lambda e: F.struct(e.alias("embedding"), F.lit(None).cast("string").alias("match_id")))
    place = groups.select(F.floor(F.col("face_id") / FACES).cast("long").alias("image_id"), (F.col("face_id") % FACES).cast("int").alias("pos"), F.col("match_id").cast("string").alias("match_id"))
    place = place.join(images.select("image_id", "image_path"), "image_id").select("image_path", "pos", "match_id")
    return S.write_back(images.select("image_path", "description", nested.alias("face_embeddings")), place)
