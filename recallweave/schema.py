"""Fixed schemas as DDL."""

from __future__ import annotations

MESSAGES = ("chat_id string, turn int, id string, role string, text string, status string")
LORE = (
    "id string, title string, keywords array<string>, content string, relations array<struct<subject: string, predicate: string, object: string>>, "
    "alwaysInclude boolean, enabled boolean, triggerType string"
)
FACTS = (
    "chat_id string, id string, keyword string, fact string, domain string, kind string, who array<string>, turn int, sourceId string, source string, enabled boolean, pinned boolean"
)
OVERRIDES = ("chat_id string, fact_id string, seq long, keyword string, fact string, domain string, enabled boolean, pinned boolean, deleted boolean")
PINS = ("chat_id string, messageId string, turn int, text string, at timestamp, deleted boolean")
QUERIES = ("query_id string, chat_id string, draft string, recent_context string, turn int")
MODEL_SCORES = ("id string, display string, provider string, status string, latencyMs double, tps double, score double, failureCount int, measuredAt string")
UNITS = ("chat_id string, unit_id string, message_id string, role string, pos int, ord long, text string, len int")
