"""Schemas of what is read from outside; declared, never inferred."""

RUN = (
    "schema_version BIGINT, timestamp STRING, command STRING, status STRING, repo STRING, base_sha STRING, head_sha STRING, pr_number BIGINT, pr_title STRING, pr_url STRING, "
    "counts MAP<STRING, BIGINT>, pages ARRAY<STRUCT<page_path: STRING, applied: BOOLEAN, note: STRING, edit_count: BIGINT, rationales: ARRAY<STRING>, diff: STRING, validation_passed: BOOLEAN, warnings: ARRAY<STRING>>>, "
    "usage STRUCT<cost_usd: DOUBLE, calls: BIGINT, input_tokens: BIGINT, output_tokens: BIGINT, cache_hit_rate: DOUBLE, estimated: BOOLEAN, by_model: ARRAY<STRUCT<model: STRING, stage: STRING, calls: BIGINT, tokens: BIGINT, cost_usd: DOUBLE>>>"
)
CI_EVENT = (
    "client_payload STRUCT<repo: STRING, base_sha: STRING, head_sha: STRING, pr_number: STRING, pr_title: STRING>, "
    "before STRING, after STRING, repository STRUCT<full_name: STRING>, head_commit STRUCT<message: STRING>"
)
COMPARE = "files ARRAY<STRUCT<filename: STRING, status: STRING, previous_filename: STRING, patch: STRING>>"
GOLDEN_CASE = "repo STRING, base STRING, head STRING, label STRING, expected_pages ARRAY<STRING>"
