"""Sources, object addresses and playback links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipatlas.functions.timecodes import timestamp_seconds_lenient

# The address forms of the services the tables refer to.
OBJECT_HOST = "https://storage.mtls.cloud.google.com"
OBJECT_SCHEME = "gs://"
EMBED_PREFIX = "https://www.youtube.com/embed/"
PROMPT_VIDEO_PREFIX = "genAI_videos/"


def storage_uri(bucket: str, name: Column, prefix: str = "") -> Column:
    """Object address of a file name in a bucket."""
    return F.concat(F.lit(f"{OBJECT_SCHEME}{bucket}/{prefix}"), name)


def source_class(source: Column) -> Column:
    """``YouTube``, ``GCS`` or ``Local``; the first rule that fits wins."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(s.startswith("http") | s.contains("youtube"), F.lit("YouTube"))
        .when(s.startswith(OBJECT_SCHEME) | (s == "gcs"), F.lit("GCS"))
        .otherwise(F.lit("Local"))
    )


def _object_url(uri: Column, host: str) -> Column:
    return F.concat(F.lit(f"{host}/"), F.replace(uri, F.lit(OBJECT_SCHEME), F.lit("")))


def scene_video_url(source: Column, video_id: Column, bucket: str | None = None, host: str = OBJECT_HOST) -> Column:
    """Address a scene's video can be fetched from; '' when the source is missing."""
    url = F.when(source.startswith(OBJECT_SCHEME), _object_url(source, host))
    if bucket:
        # A missing id is spelled out, as text formatting does.
        name = F.coalesce(video_id, F.lit("None"))
        url = url.when(source == "gcs", _object_url(storage_uri(bucket, name), host))
    return url.otherwise(F.coalesce(source, F.lit("")))


def prompt_video_url(path: Column, host: str = OBJECT_HOST) -> Column:
    """Address of a prompt's video; '' unless it is an object address."""
    return F.when(path.startswith(OBJECT_SCHEME), _object_url(path, host)).otherwise(F.lit(""))


def _seconds_text(timestamp: Column) -> Column:
    seconds = timestamp_seconds_lenient(timestamp)
    whole = seconds.try_cast("bigint")
    text = F.when(seconds == whole, whole.cast("string")).otherwise(seconds.cast("string"))
    return F.coalesce(text, F.lit("NaN"))


def youtube_embed_url(url: Column, timestamp: Column) -> Column:
    """Embed link for a video page, short link or bare id, starting at ``timestamp``."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))
    v = F.regexp_extract(url, r"^[^?#]*\?(?:(?!v=)[^&#]*&)*v=([^&#]*)", 1)
    v = F.coalesce(F.try_url_decode(v), v)
    segment = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*+[^/?#\\]*[/\\]([^/?#\\]*)", 1)
    video = (
        F.when(host.contains("youtube.com"), v)
        .when(host.contains("youtu.be"), segment)
        .when(url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(""))
        .when(~url.contains("/"), url)
    )
    return F.when(
        F.coalesce(video, F.lit("")) != "",
        F.concat(F.lit(EMBED_PREFIX), video, F.lit("?start="), _seconds_text(timestamp)),
    ).otherwise(F.lit(""))


def playback_url(video_url: Column, video_id: Column, timestamp: Column) -> Column:
    """Link the player opens: an embed link, or the file with a start offset; '' if none."""
    stream = F.when(video_url.startswith("http"), video_url).when(video_id.startswith("http"), video_id)
    hosted = stream.contains("youtube.com") | stream.contains("youtu.be")
    return (
        F.when(hosted, youtube_embed_url(stream, timestamp))
        .when(stream.isNotNull(), F.concat(stream, F.lit("#t="), _seconds_text(timestamp)))
        .otherwise(F.lit(""))
    )
