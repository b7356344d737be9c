"""Declared schemas of the driver tables, as DDL text."""

from __future__ import annotations

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}
