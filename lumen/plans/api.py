"""What the service offers, as functions on tables under one root folder with a sub-folder for each album."""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen import schemas
from lumen.functions.text import basename
from lumen.operators import graph as G
from lumen.operators import providers
from lumen.operators import similarity as S
from lumen.operators import tags as T
from lumen.plans import incremental
from lumen.sources import readers, sinks


unprocessed = incremental.unprocessed


class Albums:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock = threading.Lock()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def list_albums(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def create_album(self, name: str) -> str:
        if not name.strip():
            raise ValueError("an album needs a name")
        fs, p = self._fs(f"{self.root}/{name.strip()}")
        if fs.exists(p):
            raise ValueError("the album exists")
        fs.mkdirs(p)
        return name.strip()

    def upload(self, album: str, name: str, content: bytes) -> str:
        """Saves a file of the album, which must exist; returns its path."""
        if album not in self.list_albums():
            raise KeyError(f"there is no album {album}")
        fs, p = self._fs(f"{self.root}/{album}/files/{name.replace(chr(92), '/').rsplit('/', 1)[-1]}")
        out = fs.create(p, True)
        out.write(bytearray(content))
        out.close()
        return p.toString()

    def process(self, album: str, describe, find_faces, settings: S.Settings = S.Settings(), threshold: float = 0.8, exif=providers.exif_tags, token_vectors: DataFrame | None = None) -> None:
        """From the files to the metrics: new files are described (`describe` and `find_faces` make models, one for each
        partition) and compared with all images, and the graph and its metrics are made anew.

        Tables of the album, a part for each run: images, similarities, edges, matches; the whole as of each run: identities,
        results. A run that fails leaves its parts to be overwritten by the next, and the status says why. Pairs of earlier
        runs are not compared again, and faces keep their identity: that of the first face seen of a person.
        """
        with self._running(album) as run:
            incremental.process(self.spark, f"{self.root}/{album}", run, describe, find_faces, settings, threshold, exif, token_vectors)
            self._metrics(album)

    def start(self, album: str, *args, **settings) -> threading.Thread:
        """`process` in the background; `status` tells when it has ended, and how."""

        def work():
            try:
                self.process(album, *args, **settings)
            except Exception:  # the status has it
                pass

        self._say(album, self.status(album) | {"processing": True, "error": None})
        thread = threading.Thread(target=work, name=f"album {album}")
        thread.start()
        return thread

    def run_pipeline(self, album: str, similarities: DataFrame, threshold: float = 0.8) -> None:
        """Similarities (image1, image2, score) to graph and metrics tables of the album."""
        with self._running(album) as run:
            G.build(similarities, threshold).write.mode("overwrite").parquet(f"{self.root}/{album}/edges/run={run}")
            self._metrics(album)

    def _metrics(self, album: str) -> None:
        G.centralities(self.edges(album)).write.mode("overwrite").parquet(f"{self.root}/{album}/metrics")

    def edges(self, album: str) -> DataFrame:
        """The graph's edges; of an edge that several runs gave the last one counts."""
        rows = self.spark.read.schema("a string, b string, weight double, run int").parquet(f"{self.root}/{album}/edges")
        return G.last_wins(rows, ["a", "b"], "run").select("a", "b", "weight")

    @contextmanager
    def _running(self, album: str):
        """The number of a new run; the album's status says that it goes on, then that it has ended or failed."""
        with self.lock:
            before = self.status(album)
            self._say(album, before | {"processing": True, "error": None})
        try:
            yield before["run"] + 1
        except BaseException as e:
            self._say(album, before | {"processing": False, "error": f"{type(e).__name__}: {e}"[:2000]})
            raise
        self._say(album, {"processing": False, "run": before["run"] + 1, "error": None, "last": datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")})

    def _say(self, album: str, status: dict) -> None:
        fs, p = self._fs(f"{self.root}/{album}/status.json")
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(status | {"by": self.spark.sparkContext.applicationId}).encode()))
        out.close()

    def status(self, album: str) -> dict:
        """processing, last (the time of the last run), run (how many have ended), error; it outlives the process. What another
        session left as processing counts as failed."""
        fs, p = self._fs(f"{self.root}/{album}/status.json")
        said = {"processing": False, "last": None, "run": 0, "error": None}
        if fs.exists(p):
            said |= json.loads("".join(r.value for r in self.spark.read.text(p.toString()).collect()) or "{}")
        if said["processing"] and said.pop("by", None) != self.spark.sparkContext.applicationId:
            said |= {"processing": False, "error": "interrupted"}
        said.pop("by", None)
        return said

    def metrics(self, album: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{album}/metrics")

    def top_central(self, album: str, metric: str = "eigenvector", n: str | int | None = None, files: DataFrame | None = None) -> DataFrame:
        rows = self.metrics(album)
        return G.top(rows if files is None else rows.join(files.select(basename(F.col("image_path")).alias("node")), "node", "left_semi"), metric, n)

    def central_images(self, album: str) -> DataFrame:
        return self.top_central(album, n=10).select("node")

    def graph_json(self, album: str) -> DataFrame:
        edges = self.edges(album)
        return sinks.graph_json(G.nodes(edges).select(F.col("node").alias("id")), edges)

    def graph_document(self, album: str) -> str:
        """Writes the album's graph as a document in parts, for graphs of any size; returns the folder."""
        edges, path = self.edges(album), f"{self.root}/{album}/graph"
        sinks.write_graph(G.nodes(edges).select(F.col("node").alias("id")), edges, path)
        return path

    def propagated(self, album: str) -> DataFrame:
        """(node, tags) of every image of the graph: the saved tags (image, person, place, period, objects as the interface
        posts them) propagated, confidences with four digits."""
        edges = self.edges(album)
        posted = self.spark.read.schema(schemas.UI_ROW).json(f"{self.root}/{album}/tags")
        seed = T.seeds(readers.ui_tags(posted), G.nodes(edges))
        return sinks.propagated(G.nodes(edges), T.propagate(edges, seed))

    def save_tags(self, album: str, tags: DataFrame) -> None:
        sinks.tags_json(tags, f"{self.root}/{album}/tags")


def find_similar(similarities: DataFrame, threshold: float = 0.8) -> DataFrame:
    return similarities.where(F.col("similarity_score") >= threshold).select(F.col("image1_path").alias("image1"), F.col("image2_path").alias("image2"), F.col("similarity_score").alias("similarity"), "face_bonus", F.col("face_count").alias("matching_faces"))
