"""Public byte-level vocabularies: read once on the driver, sent to the tasks as bytes.

A vocabulary has a fixed size (about 50,000 tokens, under 1 MB), so it may be broadcast.
"""

from __future__ import annotations

import base64

from pyspark import Broadcast
from pyspark.sql import SparkSession


def send(spark: SparkSession, path: str) -> Broadcast:
    """The rank file at ``path``, a parameter of the caller, for all tasks."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def encoder(sent: Broadcast, pattern: str):
    """The encoding of a sent rank file, without special tokens; a task builds it once."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(sent.value), special_tokens={})
