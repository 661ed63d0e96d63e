"""The two tables and everything that can be asked of them, as one object."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clipatlas.functions.links import PROMPT_VIDEO_PREFIX, playback_url, scene_video_url, storage_uri
from clipatlas.operators import catalog, ivf, stats
from clipatlas.operators.embed import HASH_DIMS, Embedder, embed_once, embed_queries
from clipatlas.operators.search import (
    PROMPT_RESULTS,
    PROMPT_VECTORS,
    SCENE_RESULTS,
    prompt_search_batch,
    scene_results,
    scene_search_batch,
    scene_search_places,
)
from clipatlas.schemas import PROMPTS, RESPONSE_RECORD, SCENES
from clipatlas.sources.requests import decode_queries, split_requests
from clipatlas.sources.commits import Snapshot, commit, fresh
from clipatlas.sources.tables import ROW_PLACE, append_prompts, append_scenes
from clipatlas.streaming.ingest import CELLS, ORIGIN, SCENE_INDEX, into_cells, store_documents, stream_ingest, with_origin


class Index(NamedTuple):
    """A clustered table of a library."""

    name: str
    kind: str
    table: str
    schema: T.StructType
    vec_col: str
    folder: str


# The clustered tables of a library: what commits call them, the table and the vectors they are of, and their folder.
_SCENES = Index(SCENE_INDEX, "batch", "scenes", SCENES, "embedding", CELLS)
_PROMPT_INDEXES = [Index(f"{c}_cells", "prompts", "prompts", PROMPTS, c, f"{c}_cells") for c in PROMPT_VECTORS]


class Library:
    """Scenes under ``root/scenes``, prompts under ``root/prompts``, rejected responses under ``root/rejects``.

    What belongs to the library is told by the commits under ``root/commits``: every batch, upload and index is
    visible as a whole or not at all. After ``build_index`` the scenes are also kept clustered by their vectors, and
    after ``build_prompt_index`` the prompts by both of theirs; everything that is stored later is added there.
    What was stored while an index was built is looked at all the same, and added by the next ``extend_indexes``.

    ``load`` and ``load_image`` return the models for texts and images; the hash embedding stands in
    for the first. ``bucket`` is where videos stored under the source ``gcs`` lie.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        bucket: str | None = None,
        load: Callable[[], Embedder] | None = None,
        load_image: Callable[[], Embedder] | None = None,
        dims: int = HASH_DIMS,
    ):
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket
        self.load, self.load_image, self.dims = load, load_image, dims

    @property
    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.root)

    def _table(self, name: str, schema: T.StructType, kind: str, placed: bool = False) -> DataFrame:
        snapshot = self.snapshot
        return snapshot.read(name, schema, snapshot.of(kind), placed)

    @property
    def scenes(self) -> DataFrame:
        return self._table("scenes", SCENES, "batch")

    @property
    def prompts(self) -> DataFrame:
        return self._table("prompts", PROMPTS, "prompts")

    @property
    def rejects(self) -> DataFrame:
        return self._table("rejects", RESPONSE_RECORD, "batch")

    def add_responses(self, documents: DataFrame, batch: str | None = None) -> DataFrame:
        """Store the scenes of the accepted documents and the others as rejects, and return the rejects.

        A batch that is stored again under the same name replaces what it stored before.
        """
        folders = store_documents(documents, self.root, f"batch={batch or uuid.uuid4().hex}", self.load, self.dims)
        return self.spark.read.schema(documents.schema).parquet(f"{self.root}/{folders['rejects']}")

    def add_analyses(self, requests: DataFrame, responses: DataFrame, batch: str | None = None) -> DataFrame:
        """Store the responses ``(request_id, response)`` to analysis requests.

        Video id and source come from the request. Returns the rejected documents; requests without
        an address have no response to store.
        """
        work, _ = split_requests(requests)
        known = responses.join(work.select("request_id", "video_id", "source"), "request_id")
        return self.add_responses(known, batch)

    def stream_responses(self, source: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Store responses as they arrive; rejected ones go to ``root/rejects``."""
        return stream_ingest(
            self.spark, source, self.root, checkpoint, self.load, self.dims, available_now=available_now
        )

    def add_prompts(self, uploads: DataFrame, bucket: str, batch: str | None = None) -> None:
        """Store uploads ``(prompt_text, filename, video_embedding)``; the text is embedded here.

        A batch that is stored again under the same name replaces what it stored before.
        """
        name = f"batch={batch or uuid.uuid4().hex}"
        path = storage_uri(bucket, F.col("filename"), PROMPT_VIDEO_PREFIX)
        rows = embed_once(uploads.withColumn("gcs_video_path", path), "prompt_text", "prompt_embedding", self.load, self.dims)
        folders = {"prompts": fresh(f"prompts/{name}")}
        append_prompts(rows, f"{self.root}/{folders['prompts']}")
        stored, snapshot, indexes = with_origin(self.spark.read.schema(PROMPTS).parquet(f"{self.root}/{folders['prompts']}")), self.snapshot, {}
        for index in _PROMPT_INDEXES:
            cells, version = into_cells(snapshot, index.name, stored, f"{self.root}/{index.folder}")
            folders |= cells
            indexes |= version
        commit(self.spark, self.root, "prompts", name, folders, indexes)

    def _vectors(self, queries: DataFrame) -> DataFrame:
        return embed_queries(decode_queries(queries), self.load, self.load_image, self.dims)

    def build_index(self, nlist: int | None = None, training_fraction: float | None = None) -> None:
        """Keep the scenes clustered by their vectors from now on. Building again replaces the clusters."""
        self._build(_SCENES, nlist, training_fraction)

    def build_prompt_index(self, nlist: int | None = None, training_fraction: float | None = None) -> None:
        """Keep the prompts clustered by their video vectors and by their text vectors from now on."""
        for index in _PROMPT_INDEXES:
            self._build(index, nlist, training_fraction)

    def _build(self, index: Index, nlist: int | None, training_fraction: float | None) -> None:
        snapshot = self.snapshot
        batches = snapshot.of(index.kind)
        rows = snapshot.read(index.table, index.schema, batches)
        rows = with_origin(rows) if batches else rows.withColumn(ORIGIN, F.lit(""))
        path = f"{self.root}/{index.folder}"
        about, folders = ivf.ivf_write_build(rows, path, index.vec_col, nlist, training_fraction=training_fraction)
        ivf.ivf_commit(self.spark, self.root, index.name, about, folders, [r.folders[index.table] for r in batches])
        self._extend(index)

    def extend_indexes(self) -> None:
        """Add to the indexes what was stored while they were built, and measure anew how far a search has to look."""
        for index in (_SCENES, *_PROMPT_INDEXES):
            if self.snapshot.index(index.name) is not None:
                self._extend(index)
                self._measure(index)

    def _extend(self, index: Index) -> None:
        snapshot = self.snapshot
        for batch in self._outside(index, snapshot):
            rows = with_origin(snapshot.read(index.table, index.schema, [batch]))
            cells, version = into_cells(snapshot, index.name, rows, f"{self.root}/{index.folder}")
            if cells:
                # A batch of that name that is stored meanwhile is later than this and stays.
                folders, indexes = {**batch.folders, **cells}, {**batch.indexes, **version}
                commit(self.spark, self.root, index.kind, batch.name, folders, indexes, at=batch.at + 1)

    def _measure(self, index: Index) -> None:
        snapshot = self.snapshot
        row = snapshot.index(index.name)
        about = ivf.ivf_measured(ivf.ivf_of(snapshot, index.name, f"{self.root}/{index.folder}"))
        commit(self.spark, self.root, "index", index.name, row.folders, {}, json.dumps(about), row.covers)

    def rebalance_indexes(self) -> None:
        """Let the cells follow the rows: split those that grew since the build and dissolve those that shrank."""
        for index in (_SCENES, *_PROMPT_INDEXES):
            snapshot = self.snapshot
            row, table = snapshot.index(index.name), self._clustered(index)
            changed = None if table is None else ivf.ivf_write_rebalanced(table)
            if changed is not None:
                inside = [r.folders[index.table] for r in snapshot.of(index.kind) if r.indexes.get(index.name) == table.about.identity]
                ivf.ivf_commit(self.spark, self.root, index.name, *changed, sorted({*row.covers, *inside}))

    def _outside(self, index: Index, snapshot: Snapshot) -> list[Row]:
        """Commits whose rows are in no cell of the index."""
        row = snapshot.index(index.name)
        covers, version = set(row.covers), ivf.About(*json.loads(row.about)).identity
        return [
            r for r in snapshot.of(index.kind)
            if index.table in r.folders and r.folders[index.table] not in covers and r.indexes.get(index.name) != version
        ]

    def _clustered(self, index: Index) -> ivf.Clustered | None:
        """The index as of now: without what has been replaced, and with what is not in it yet beside it."""
        snapshot = self.snapshot
        table = ivf.ivf_of(snapshot, index.name, f"{self.root}/{index.folder}")
        if table is None:
            return None
        outside = self._outside(index, snapshot)
        if outside:
            loose = snapshot.read(index.table, index.schema, outside, placed=True)
            table = table._replace(loose=loose.withColumn(ORIGIN, F.lit("")))
        # Folders that the index was built from and that another attempt of their batch has replaced.
        gone = set(snapshot.index(index.name).covers) - {r.folders.get(index.table) for r in snapshot.of(index.kind)}
        return table._replace(stale=tuple(sorted(folder.rpartition("attempt=")[2] for folder in gone)))

    def search(
        self, queries: DataFrame, k: int = SCENE_RESULTS, metric: str = "cosine", nprobe: int | None = None
    ) -> DataFrame:
        """Nearest scenes for queries ``(query_id, query)``, each a text or an image address.

        With an index, scenes are found in the cells that may hold one of the nearest, which gives the same as looking
        at all of them. With ``nprobe`` only so many cells are looked through for each query.
        """
        vectors = self._vectors(queries)
        table = self._clustered(_SCENES) if metric == "cosine" else None
        if nprobe is not None and table is None:
            raise ValueError("clusters are searched by cosine, once there is an index")
        if table is None or table.about.dims is None:
            return scene_search_batch(self._table("scenes", SCENES, "batch", True), vectors, k, metric, self.bucket, ROW_PLACE)
        find = ivf.ivf_search_batch_exact if nprobe is None else ivf.ivf_search_batch
        return scene_results(find(self.spark, table, vectors, k, nprobe, key=ROW_PLACE), self.bucket, lead=["query_id", "rank"])

    def find(self, query: str, k: int = SCENE_RESULTS, metric: str = "cosine", nprobe: int | None = None) -> DataFrame:
        """Nearest scenes for one query, as ``search``. Texts are read only from the files that hold one of them."""
        one = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        vector = self._vectors(one).select("query_embedding").first()
        values = list(vector[0]) if vector else []
        table = self._clustered(_SCENES) if metric == "cosine" else None
        if table is None or table.about.dims != len(values):
            return scene_search_places(self._table("scenes", SCENES, "batch", True), values, k, metric, self.bucket)
        find = ivf.ivf_search_exact if nprobe is None else ivf.ivf_search
        return find(self.spark, table, values, k, bucket=self.bucket, nprobe=nprobe)

    def prompt_search(self, queries: DataFrame, k: int = PROMPT_RESULTS) -> DataFrame:
        """Nearest prompts for queries ``(query_id, query)``; with both indexes, from the cells that may hold one of them."""
        tables = [self._clustered(index) for index in _PROMPT_INDEXES]
        if any(t is None or t.about.dims is None for t in tables):
            return prompt_search_batch(self.prompts, self._vectors(queries), k=k)
        return ivf.ivf_prompt_search_batch(self.spark, *tables, self._vectors(queries), k=k)

    def assets(self) -> DataFrame:
        return catalog.list_assets(self.scenes)

    def asset(self, video_id: str) -> DataFrame:
        return catalog.asset_detail(self.scenes, video_id, self.bucket)

    def first_scenes(self) -> DataFrame:
        """The earliest scene of every video, with the link that plays it."""
        first = catalog.first_scene(self.scenes)
        url = scene_video_url(F.col("source"), F.col("video_id"), self.bucket)
        return first.withColumn("play_url", playback_url(url, F.col("video_id"), F.col("timestamp_start")))

    def compact(self, root: str) -> Library:
        """A copy of the scenes, prompts and rejects in ``root``, in few files; scenes of a video lie together.

        Streams keep writing where they are; move them to the copy by starting them there with the old checkpoint
        once the copy is made.
        """
        copy = Library(self.spark, root, self.bucket, self.load, self.load_image, self.dims)
        folders = {name: fresh(f"{name}/compacted") for name in ("scenes", "rejects", "prompts", "figures")}
        stats.partial_figures(self.scenes).write.parquet(f"{copy.root}/{folders['figures']}")
        append_scenes(self.scenes, f"{copy.root}/{folders['scenes']}", by_video=True, required=())
        for name, rows in (("prompts", self.prompts), ("rejects", self.rejects)):
            rows.hint("rebalance").write.parquet(f"{copy.root}/{folders[name]}")
        commit(self.spark, copy.root, "prompts", "compacted", {"prompts": folders.pop("prompts")})
        commit(self.spark, copy.root, "batch", "compacted", folders)
        return copy

    def stats(self) -> DataFrame:
        """All figures, added up from those that were stored with each batch; no scene is read."""
        snapshot = self.snapshot
        partials = snapshot.read("figures", stats.FIGURES, snapshot.of("batch"))
        return stats.stats_of(partials, snapshot.read("prompts", PROMPTS, snapshot.of("prompts")))
