"""Scans, responses, requests, embeddings, appends and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.functions.vectors import encode_embedding, usable
from clipatlas.operators.embed import HASH_DIMS, embed, embed_queries
from clipatlas.operators.search import scene_search_batch
from clipatlas.plans.registry import query
from clipatlas.plans.relations import (
    check_sql,
    relation,
    responses,
    spread,
    stored_scenes,
    table,
)
from clipatlas.schemas import PROMPTS, SCENE_REQUIRED, SCENE_TEXT_COLUMNS
from clipatlas.sources.requests import decode_queries, plan_requests, select_query_input
from clipatlas.sources.responses import parse_responses, to_scene_rows
from clipatlas.sources.tables import (
    append_prompts,
    append_scenes,
    ensure_tables,
    from_text_vectors,
    read_prompts,
    read_scenes,
    scene_columns,
    split_required,
)
from clipatlas.streaming.ingest import ingested, stream_ingest
from clipatlas.workdir import work_folder

_ALL_TEXT = ", ".join(SCENE_TEXT_COLUMNS)


def _vector_facts(name: str) -> list[F.Column]:
    total = F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x)
    return [F.size(name).cast("bigint").alias(f"{name}_dims"), F.round(total, 6).alias(f"{name}_total")]


def _vector_sql(name: str) -> str:
    return f"len({name}) AS {name}_dims, round(list_sum({name}::DOUBLE[]), 6) + 0 AS {name}_total"


@query("scan_scenes", check_sql(f"SELECT {_ALL_TEXT}, {_vector_sql('embedding')} FROM scenes", "scenes"))
def scan_scenes(spark: SparkSession, sf: str) -> DataFrame:
    scenes = read_scenes(spark, stored_scenes(spark, sf))
    return scenes.select(*SCENE_TEXT_COLUMNS, *_vector_facts("embedding"))


@query("scan_scenes_pruned", check_sql(f"SELECT {_ALL_TEXT} FROM scenes", "scenes"))
def scan_scenes_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return scene_columns(read_scenes(spark, stored_scenes(spark, sf)))


@query(
    "scan_scenes_text_vectors",
    check_sql(
        f"""SELECT {_ALL_TEXT}, {_vector_sql('embedding')} FROM scenes
        WHERE right(title, 1) NOT IN ('7', '8', '9')""",
        "scenes",
    ),
)
def scan_scenes_text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The variant with vectors as JSON text; texts that are broken, empty or missing drop out."""
    last = F.expr("right(title, 1)")
    text = F.when(last == "7", F.lit("[0.5, oops")).when(last == "8", F.lit("")).when(
        last != "9", encode_embedding(F.col("embedding"))
    )
    stored = relation(spark, sf, "scenes").withColumn("embedding_json", text).drop("embedding")
    scenes = from_text_vectors(stored).filter(usable(F.col("embedding")))
    return scenes.select(*SCENE_TEXT_COLUMNS, *_vector_facts("embedding"))


_PROMPT_VECTORS = f"{_vector_sql('video_embedding')}, {_vector_sql('prompt_embedding')}"


@query(
    "scan_prompts",
    check_sql(
        f"""SELECT id, gcs_video_path, prompt_text, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
        {_PROMPT_VECTORS} FROM prompts""",
        "prompts",
    ),
)
def scan_prompts(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "prompts")
    prompts = relation(spark, sf, "prompts").withColumn("created_at", F.col("created_at").cast("timestamp"))
    prompts.select(*PROMPTS.fieldNames()).write.parquet(path)
    return read_prompts(spark, path).select(
        "id",
        "gcs_video_path",
        "prompt_text",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        *_vector_facts("video_embedding"),
        *_vector_facts("prompt_embedding"),
    )


_RESPONSE_ID = "d.video_id || '#' || d.summary || '#' || d.hundred"


@query(
    "parse_responses",
    check_sql(
        f"""SELECT {_RESPONSE_ID} AS response_id, d.kind >= 6 AS valid,
          CASE WHEN d.kind >= 6 THEN d.n_scenes END AS n_scenes, CASE WHEN d.kind >= 6 THEN d.summary END AS summary,
          CASE WHEN d.kind >= 6 THEN replace(d.tags, ',', '|') END AS tags FROM documents_of d""",
        "scenes",
        "documents_of",
    ),
)
def parse_responses_query(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_responses(responses(spark, sf))
    n_scenes = F.when(F.col("valid"), F.size("analysis.scenes").cast("bigint"))
    return parsed.select(
        "response_id",
        "valid",
        n_scenes.alias("n_scenes"),
        F.col("analysis.summary").alias("summary"),
        F.array_join("analysis.tags", "|").alias("tags"),
    )


def _stored_text(prefix: str) -> str:
    own = {"video_id": "d.video_id", "source": "d.source", "summary": "d.summary", "tags": "d.tags"}
    return ", ".join(f"{own.get(c, f'coalesce(s.{c}, {chr(39) * 2})')} AS {c}" for c in SCENE_TEXT_COLUMNS)


_SCENE_ROWS = """FROM documents_of d JOIN scenes s ON s.video_id = d.video_id AND s.summary = d.summary
  AND substr(s.title, 1, length(s.title) - 2) = d.hundred WHERE d.kind >= 6"""
# Columns and rows of the scenes that are stored from the responses.
STORED_SCENES = (_stored_text("s"), _SCENE_ROWS)


@query(
    "scenes_from_responses",
    check_sql(
        f"""SELECT {_RESPONSE_ID} AS response_id, {_stored_text('s')},
        row_number() OVER (PARTITION BY d.video_id, d.summary, d.hundred ORDER BY s.title) - 1 AS position
        {_SCENE_ROWS}""",
        "scenes",
        "documents_of",
    ),
)
def scenes_from_responses(spark: SparkSession, sf: str) -> DataFrame:
    valid = parse_responses(responses(spark, sf)).filter("valid")
    rows = to_scene_rows(valid, keep=("response_id",))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query(
    "append_scenes",
    check_sql(f"SELECT {_ALL_TEXT}, {_vector_sql('embedding')}, source IS NOT NULL AS accepted FROM scenes", "scenes"),
)
def append_scenes_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of stored scenes, one per half of the sources, read back as one table; scenes without a source are rejects."""
    path = work_folder(spark, "appended")
    scenes = read_scenes(spark, stored_scenes(spark, sf))
    hosted = F.coalesce(F.col("source").startswith("http"), F.lit(False))
    append_scenes(scenes.filter(hosted), f"{path}/scenes", rejects=f"{path}/rejects")
    append_scenes(scenes.filter(~hosted), f"{path}/scenes", rejects=f"{path}/rejects")
    stored, rejects = (read_scenes(spark, f"{path}/{name}") for name in ("scenes", "rejects"))
    both = stored.withColumn("accepted", F.lit(True)).unionByName(rejects.withColumn("accepted", F.lit(False)))
    return both.select(*SCENE_TEXT_COLUMNS, *_vector_facts("embedding"), "accepted")


@query(
    "append_prompts",
    check_sql(
        f"""SELECT gcs_video_path, prompt_text, 36 AS id_length, true AS stamped, {_PROMPT_VECTORS} FROM prompts""",
        "prompts",
    ),
)
def append_prompts_query(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "prompts")
    append_prompts(relation(spark, sf, "prompts").drop("id", "created_at"), path)
    return read_prompts(spark, path).select(
        "gcs_video_path",
        "prompt_text",
        F.length("id").alias("id_length"),
        F.col("created_at").isNotNull().alias("stamped"),
        *_vector_facts("video_embedding"),
        *_vector_facts("prompt_embedding"),
    )


@query(
    "ensure_tables",
    check_sql(
        """SELECT 'scenes' AS table_name, 16 AS n_columns, count(*) AS n_rows FROM scenes
        UNION ALL SELECT 'prompts', 6, count(*) FROM prompts""",
        "scenes",
        "prompts",
    ),
)
def ensure_tables_query(spark: SparkSession, sf: str) -> DataFrame:
    """Create both tables, ask again, fill them, count, and remove them."""
    database = f"clipatlas_{uuid.uuid4().hex}"
    ensure_tables(spark, database, work_folder(spark, "database"))
    listing = ensure_tables(spark, database)
    scenes, prompts = relation(spark, sf, "scenes"), relation(spark, sf, "prompts")
    scenes = scenes.fillna("local", ["source"])
    prompts = prompts.withColumn("created_at", F.col("created_at").cast("timestamp"))
    counts = None
    for name, rows in (("scenes", scenes), ("prompts", prompts)):
        stored = spark.table(f"{database}.{name}")
        rows.select(*stored.columns).write.insertInto(f"{database}.{name}")
        n_rows = spark.table(f"{database}.{name}").agg(F.count("*").alias("n_rows"))
        n_rows = n_rows.withColumn("table_name", F.lit(name))
        counts = n_rows if counts is None else counts.unionByName(n_rows)
    columns = listing.groupBy("table_name").agg(F.count("*").cast("int").alias("n_columns"))
    found = columns.join(counts, "table_name").select("table_name", "n_columns", "n_rows")
    rows = [tuple(r) for r in found.collect()]  # one for each of the two tables
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(rows, found.schema)


@query(
    "plan_requests",
    check_sql(
        """SELECT request_id, gcs_uri IS NOT NULL OR youtube_url IS NOT NULL AS accepted,
        coalesce(list_last(string_split(gcs_uri, '/')), youtube_url) AS video_id,
        coalesce(youtube_url, gcs_uri) AS source,
        CASE WHEN youtube_url IS NOT NULL THEN 'youtube' WHEN gcs_uri IS NOT NULL THEN 'gcs' END AS source_type
        FROM requests""",
        "requests",
    ),
)
def plan_requests_query(spark: SparkSession, sf: str) -> DataFrame:
    planned = plan_requests(relation(spark, sf, "requests"))
    return planned.select("request_id", "accepted", "video_id", "source", "source_type")


_INPUT = """SELECT request_id, coalesce(nullif(query_image, ''), nullif(query_text, '')) AS query
  FROM search_requests WHERE coalesce(nullif(query_image, ''), nullif(query_text, '')) IS NOT NULL"""


@query("select_query_input", check_sql(_INPUT, "search_requests"))
def select_query_input_query(spark: SparkSession, sf: str) -> DataFrame:
    return select_query_input(relation(spark, sf, "search_requests")).select("request_id", "query")


@query(
    "decode_queries",
    check_sql(
        f"""SELECT request_id, CASE WHEN image THEN 'image' ELSE 'text' END AS kind,
        CASE WHEN image THEN string_split(string_split(query, ';')[1], ':')[2] END AS mime_type,
        CASE WHEN image THEN octet_length(from_base64(string_split(query, ',')[2])) END AS n_bytes
        FROM (SELECT *, query LIKE 'data:image/%,%' AS image FROM ({_INPUT}))""",
        "search_requests",
    ),
)
def decode_queries_query(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_queries(select_query_input(relation(spark, sf, "search_requests")))
    n_bytes = F.octet_length("image").cast("bigint").alias("n_bytes")
    return decoded.select("request_id", "kind", "mime_type", n_bytes)


_BREAKS_SQL = r"[\x00-/:-@\[-`{-~]+"


def _hash_embedding_sql(rows: str) -> str:
    """Non-zero entries of the hash embedding of ``rows(id, text)``."""
    return f"""
      SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) + 0 AS value FROM (
        SELECT id, ('0x' || left(md5(word), 8))::BIGINT % {HASH_DIMS} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (
          SELECT id, unnest(string_split_regex(lower(text), '{_BREAKS_SQL}')) AS word FROM ({rows}))
        WHERE word <> '' GROUP BY 1, 2)"""


def _entries(rows: DataFrame, name: str) -> DataFrame:
    long = rows.select("id", F.posexplode_outer(name).alias("bucket", "value")).filter(F.col("value") > 0)
    return long.select("id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))


@query("embed_text", _hash_embedding_sql("SELECT doc_id AS id, text FROM documents"))
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(table(spark, sf, "documents"), spark.sparkContext.applicationId, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return _entries(embed(documents, "text", "embedding"), "embedding")


@query(
    "embed_descriptions",
    check_sql(_hash_embedding_sql("SELECT title AS id, description AS text FROM scenes"), "scenes"),
)
def embed_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    scenes = relation(spark, sf, "scenes", heavy=True).select(F.col("title").alias("id"), "description")
    return _entries(embed(scenes, "description", "embedding"), "embedding")


def _drained(spark: SparkSession, sf: str) -> str:
    """Write the responses as files, drain the stream over them, and start it once more."""
    inbox, target = work_folder(spark, "inbox"), work_folder(spark, "ingested")
    checkpoint = work_folder(spark, "progress")
    responses(spark, sf).write.json(inbox)
    for _ in range(2):
        stream_ingest(spark, inbox, target, checkpoint, available_now=True).awaitTermination()
    return target


@query(
    "stream_ingest",
    check_sql(f"SELECT {_stored_text('s')}, {HASH_DIMS} AS dims {_SCENE_ROWS}", "scenes", "documents_of"),
)
def stream_ingest_query(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, _drained(spark, sf)).select(*SCENE_TEXT_COLUMNS, F.size("embedding").alias("dims"))


@query(
    "stream_rejects",
    check_sql(
        f"SELECT {_RESPONSE_ID} AS response_id, d.source FROM documents_of d WHERE d.kind < 6",
        "scenes",
        "documents_of",
    ),
)
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, _drained(spark, sf), "rejects").select("response_id", "source")


@query(
    "required_fields",
    check_sql(
        """SELECT title, video_id IS NOT NULL AND source IS NOT NULL AND timestamp_start IS NOT NULL
        AND timestamp_end IS NOT NULL AS accepted FROM scenes""",
        "scenes",
    ),
)
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = split_required(relation(spark, sf, "scenes"), SCENE_REQUIRED)
    kept = accepted.select("title", F.lit(True).alias("accepted"))
    return kept.unionByName(rejected.select("title", F.lit(False).alias("accepted")))


def _words_sql(rows: str) -> str:
    return f"""SELECT id, ('0x' || left(md5(word), 8))::BIGINT % {HASH_DIMS} AS bucket, count(*) AS n FROM (
      SELECT id, unnest(string_split_regex(lower(text), '{_BREAKS_SQL}')) AS word FROM ({rows}))
      WHERE word <> '' GROUP BY 1, 2"""


def _dense_sql(rows: str) -> str:
    """One list of word counts per bucket for every row of ``rows(id, text)``."""
    return f"""SELECT g.id, list(coalesce(w.n, 0)::DOUBLE ORDER BY g.bucket) AS v
      FROM (SELECT id, bucket FROM ({rows}), range({HASH_DIMS}) AS b(bucket)) g
      LEFT JOIN ({_words_sql(rows)}) w USING (id, bucket) GROUP BY g.id"""


_TEXTS = f"SELECT request_id AS id, query AS text FROM ({_INPUT}) WHERE NOT query LIKE 'data:image/%,%'"
_DESCRIPTIONS = "SELECT DISTINCT description AS id, description AS text FROM scenes"


@query(
    "text_search",
    check_sql(
        f"""SELECT request_id, rank, round(d, 6) + 0 AS distance FROM (
          SELECT request_id, d, row_number() OVER (PARTITION BY request_id ORDER BY d) AS rank FROM scenes s JOIN (
            SELECT q.id AS request_id, t.id AS description,
              CASE WHEN list_sum(q.v) = 0 OR list_sum(t.v) = 0 THEN 1 ELSE 1 - list_cosine_similarity(q.v, t.v) END AS d
            FROM ({_dense_sql(_TEXTS)}) q, ({_dense_sql(_DESCRIPTIONS)}) t) USING (description))
        WHERE rank <= 5""",
        "scenes",
        "search_requests",
    ),
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search requests from the form to the results, over scenes embedded by the same model.

    Scenes of one description tie, and vectors that tie on paper may differ in the last bit, so the
    distances are compared and not the scenes.
    """
    path = work_folder(spark, "embedded")
    append_scenes(embed(relation(spark, sf, "scenes", heavy=True), "description", "embedding"), path, required=())
    decoded = decode_queries(select_query_input(relation(spark, sf, "search_requests", heavy=True)))
    found = scene_search_batch(
        read_scenes(spark, path), embed_queries(decoded).withColumnRenamed("request_id", "query_id"), key=["title"]
    )
    return found.select(F.col("query_id").alias("request_id"), "rank", F.round("distance", 6).alias("distance"))
