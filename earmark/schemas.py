"""Explicit schemas of the data sets; readers never infer."""

METADATA = "audio STRING, text STRING, mood STRING, confidence DOUBLE"
SEGMENT_MAP = (
    "segment_path STRING, source_path STRING, segment_index INT, start_sec DOUBLE, end_sec DOUBLE,"
    " duration_sec DOUBLE"
)
MANIFEST = (
    "audio_path STRING, text STRING, mood STRING, confidence DOUBLE, source_path STRING, segment_index INT,"
    " start_sec DOUBLE, end_sec DOUBLE, duration_sec DOUBLE"
)
MIXED_MANIFEST = MANIFEST + (
    ", domain STRING, text_source STRING, clip_id STRING, sample_key STRING, gold_pub_piano INT,"
    " gold_pub_vocal INT, gold_pub_relaxing INT"
)
SELF_TRAIN_MANIFEST = (
    "audio_path STRING, text STRING, text_orig STRING, text_source STRING, source STRING, weight DOUBLE,"
    " iter INT, sim DOUBLE, error_score DOUBLE"
)
QUERY_SET = "query_id STRING, query_type STRING, label STRING, query_text STRING"
CAPTION_LEDGER = "source_path STRING, text STRING, text_orig STRING, text_source STRING"
TEMPO_LEDGER = "audio STRING, bpm DOUBLE, gt_tempo STRING, pred_tempo STRING, status STRING"
TRAINING_LOG = (
    "seed INT, epoch INT, loss DOUBLE, train_similarity DOUBLE, val_similarity DOUBLE,"
    " checkpoint_metric DOUBLE, monitor STRING"
)
METRIC_MATRIX = (
    "query_id STRING, query_text STRING, gold_column STRING, top_k INT, n_pool INT, n_positive INT,"
    " prevalence DOUBLE, precision_at_k DOUBLE, precision_delta DOUBLE, ndcg_at_k DOUBLE,"
    " ndcg_random_mean DOUBLE, ndcg_delta DOUBLE"
)
# Superset of the record shapes that earlier versions of the metadata wrote.
LEGACY_METADATA = (
    "audio STRING, text STRING, mood STRING, confidence DOUBLE, tags STRUCT<mood: STRING>,"
    " S DOUBLE, R DOUBLE, D DOUBLE, filename STRING"
)
