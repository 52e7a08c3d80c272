"""Schemas of the tables and wire records, as DDL text: reading it as types needs a session."""

from __future__ import annotations

SEGMENTS = "id string, store_id string, camera_id string, start_time timestamp, end_time timestamp, duration_sec double, storage_path string, codec string, fps double, width int, height int, checksum string, health_json string, status string"
WINDOWS = "id string, segment_id string, camera_id string, window_start_sec double, window_end_sec double, clip_path string, status string"
DETECTIONS = "id string, ai_window_id string, model_name string, label string, confidence double, bbox array<double>, frame_time_sec double"
TRACKS = "id string, camera_id string, track_external_id string, label string, first_seen double, last_seen double, hits long"
EVENTS = "id string, store_id string, camera_id string, segment_id string, ai_window_id string, event_type string, severity string, confidence double, source_engine string, event_time timestamp, metadata_json string"
OBSERVATIONS = "id string, event_id string, model_name string, prompt_version string, parsed_json string, parse_success boolean, latency_ms double, created_at timestamp"
INCIDENTS = "id string, store_id string, title string, incident_type string, severity string, status string, start_time timestamp, end_time timestamp, summary string"
ZONES = "id string, store_id string, camera_id string, name string, zone_type string, polygon array<array<double>>"
AUDIT = "ts timestamp, action string, actor string, target string, fields map<string, string>"
#: Samples of label-keyed time series.
SAMPLES = "metric string, labels map<string, string>, ts timestamp, value double"
#: Wire records: what a subject did, as the rules read it.
TRACK_EVENT = "event_id string, store_id string, camera_id string, track_id string, track_ids array<string>, event_type string, ts double, zones array<string>, zone_types array<string>, objects array<string>, object_near_hand boolean, has_item boolean, camera_health_score double"
VERIFICATION = "event_id string, verdict string, confidence double, observed_actions array<string>, missing_evidence array<string>, recommended_next_step string, structured_event_type string, explanation string"
