"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    schema = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        schema = schema.add(name, kind)
    return schema


SUBMISSIONS = _struct(
    "id string, author string, title string, created_utc timestamp, selftext string, subreddit string, "
    "link_flair_text string, link string, num_comments integer, score integer"
)
COMMENTS = _struct(
    "id string, post_id string, parent_id string, author string, created_utc timestamp, body string, depth integer"
)
LINES = _struct("path string, file_name string, value string")
DATASET_RAW = _struct("text string, label_post string")
DATASET_CLEAN = _struct("label_post string, text_clean string")
FILES = _struct("path string, file_name string, length long, entity string, month string")
MANIFEST = _struct(
    "input_path string, output_path string, complete boolean, lines_processed long, error_lines long, "
    "lines_matched long, file_size long, error_message string, args string, type string"
)
