"""Independent ANSI SQL for the registered queries, runnable by DuckDB on the same tables.

The common table expressions mirror the derived log, not the Spark implementation.
"""

_CODES = "['CZ','MU','CA','HX','CX','KA','HU','KL','MF','3U']"
_ANY_DIM = "event_date, event_hour, airline_code"
_SUMS = (
    "CAST(SUM(successful_response_records) AS BIGINT) AS successful_response_records, "
    "CAST(SUM(success_token_count) AS BIGINT) AS success_token_count"
)


def _code(key: str) -> str:
    return f"list_extract({_CODES}, CAST(({key}) % 10 AS INTEGER) + 1)"


_DAY = "strftime(ts, '%Y%m%d')"
_CLOCK = "strftime(ts, '%H:%M:%S:%g')"
_OK = f"({_code('user_id')} || ':success;')"

_LINES = f"""
lines AS (
  SELECT event_id, ts, event_id + 1 AS line_number,
    CASE event_id % 101
      WHEN 0 THEN ''
      WHEN 1 THEN 'A,ITARES,20180830'
      WHEN 2 THEN ',ITARES,' || {_DAY} || ',19,19:00:00:000'
      WHEN 3 THEN 'A,,' || {_DAY} || ',19,19:00:00:000'
      WHEN 4 THEN 'A,ITARES,20181340,19,19:00:00:000'
      WHEN 5 THEN 'A,ITARES,' || {_DAY} || ',24,19:00:00:000'
      WHEN 6 THEN 'A,OTHER,' || {_DAY} || ',19,19:00:00:000'
      ELSE 'TB.P' || user_id || ',' ||
        CASE WHEN event_type IN ('view', 'click') THEN 'ITAREQ' ELSE 'ITARES' END || ',' ||
        {_DAY} || ',' || CAST(hour(ts) AS VARCHAR) || ',' || {_CLOCK} || ',' ||
        CASE event_type
          WHEN 'purchase' THEN ',,1,' || repeat({_OK}, CAST(1 + event_id % 3 AS INTEGER))
          WHEN 'signup' THEN ',,1,' || {_OK} || {_code('user_id + 3')} || ':success;'
          WHEN 'error' THEN ',,1,' || {_code('user_id')} || ':fail;'
          ELSE 'payload,' || {_code('user_id')} || ';,,' END
    END AS raw_line
  FROM events)"""


def _classified(name: str, source: str) -> str:
    """Parsed and classified rows of a relation with a ``raw_line`` column."""
    return f"""
{name}_split AS (SELECT *, string_split(raw_line, ',') AS f FROM {source}),
{name}_fields AS (
  SELECT * EXCLUDE (f), CAST(len(f) AS INTEGER) AS field_count, trim(f[1]) AS field_group_id,
    trim(f[2]) AS log_type, trim(f[3]) AS event_date, trim(f[4]) AS event_hour_text,
    trim(f[5]) AS event_time FROM {name}_split),
{name} AS (
  SELECT *, TRY_CAST(event_hour_text AS INTEGER) AS event_hour,
    CASE WHEN regexp_full_match(event_date, '[0-9]{{8}}')
      THEN try_strptime(event_date, '%Y%m%d') END AS parsed_date,
    CASE WHEN trim(raw_line) = '' THEN 'blank_line'
      WHEN field_count < 5 THEN 'too_few_fields'
      WHEN field_group_id = '' THEN 'missing_group_id'
      WHEN log_type = '' THEN 'missing_log_type'
      WHEN parsed_date IS NULL THEN 'invalid_date'
      WHEN event_hour IS NULL OR event_hour NOT BETWEEN 0 AND 23 THEN 'invalid_hour'
      WHEN log_type NOT IN ('ITARES', 'ITAREQ') THEN 'unsupported_log_type' END AS record_reason
  FROM {name}_fields)"""


def _tokens(name: str, source: str) -> str:
    """One row per token. The engine's regex has no lookaround, so separators are doubled."""
    return f"""
{name}_lists AS (
  SELECT *, regexp_extract_all(regexp_replace(raw_line, '([^A-Za-z0-9:])', '\\1\\1', 'g'),
    '(?:^|[^A-Z0-9])([A-Z0-9]{{2}}):success(?:[^A-Za-z]|$)', 1) AS found
  FROM {source} WHERE record_reason IS NULL AND log_type = 'ITARES'),
{name} AS (
  SELECT * EXCLUDE (found), unnest(found) AS airline_code,
    unnest(range(len(found))) AS token_ordinal FROM {name}_lists)"""


def _cube(name: str, source: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {_ANY_DIM}, COUNT(DISTINCT {key}) AS successful_response_records,
    COUNT(*) AS success_token_count FROM {source} GROUP BY {_ANY_DIM})"""


_LOG = f"{_LINES},{_classified('log', 'lines')}"
_LOG_TOKENS = f"{_LOG},{_tokens('tokens', 'log')}"
_LOG_CUBE = f"{_LOG_TOKENS},{_cube('cube', 'tokens', 'line_number')}"
_SERVING = f"""{_LOG_CUBE},
serving AS (SELECT strptime(event_date, '%Y%m%d')::DATE AS stat_date, event_hour AS stat_hour,
  airline_code, successful_response_records, success_token_count,
  'current' AS publication_id FROM cube)"""
_TOTALS = f"""{_SERVING},
totals AS (SELECT airline_code, {_SUMS} FROM serving GROUP BY airline_code),
ranked AS (SELECT *, CAST(row_number() OVER (
  ORDER BY successful_response_records DESC, airline_code) AS INTEGER) AS airline_rank
  FROM totals)"""


def _records_queries() -> dict[str, str]:
    return {
        "rec_split_fields": f"""WITH {_LOG} SELECT line_number, field_count, field_group_id,
            log_type, event_date, event_hour_text, event_time FROM log""",
        "rec_parse_hour": f"""WITH {_LOG} SELECT event_hour_text, event_hour, COUNT(*) AS records
            FROM log GROUP BY ALL""",
        "rec_parse_date": f"""WITH {_LOG} SELECT event_date,
            strftime(parsed_date, '%Y-%m-%d') AS parsed_date, COUNT(*) AS records
            FROM log GROUP BY ALL""",
        "rec_classify": f"""WITH {_LOG} SELECT line_number, raw_line, record_reason FROM log""",
        "rec_status": f"""WITH {_LOG} SELECT CASE WHEN record_reason IS NULL THEN 'valid'
              WHEN record_reason = 'unsupported_log_type' THEN 'unsupported'
              ELSE 'invalid' END AS parse_status, COUNT(*) AS records
            FROM log GROUP BY ALL""",
        "rec_split_clean": f"""WITH {_LOG} SELECT line_number, raw_line, log_type, event_date,
            event_hour, event_time FROM log WHERE record_reason IS NULL""",
        "rec_split_dead": f"""WITH {_LOG} SELECT line_number, raw_line, 'gds' AS failure_stage,
            record_reason AS failure_reason FROM log WHERE record_reason IS NOT NULL""",
        "tok_explode": f"""WITH {_LOG_TOKENS} SELECT line_number, event_date, event_hour,
            CAST(token_ordinal AS INTEGER) AS token_ordinal, airline_code FROM tokens""",
    }


def _serving_queries() -> dict[str, str]:
    inner = f"""{_SERVING}, inner_days AS (SELECT * FROM serving WHERE
        stat_date > (SELECT MIN(stat_date) FROM serving)
        AND stat_date < (SELECT MAX(stat_date) FROM serving))"""
    return {
        "q_timeline_range": f"""WITH {inner} SELECT strftime(stat_date, '%Y-%m-%d') AS stat_date,
            stat_hour, {_SUMS} FROM inner_days GROUP BY ALL""",
        "q_heatmap_range": f"""WITH {inner}, best AS (SELECT airline_code, CAST(row_number() OVER (
              ORDER BY SUM(successful_response_records) DESC, airline_code) AS INTEGER) AS airline_rank
              FROM inner_days GROUP BY airline_code)
            SELECT airline_rank, airline_code, stat_hour, {_SUMS} FROM inner_days
            JOIN best USING (airline_code) WHERE airline_rank <= 4 GROUP BY ALL""",
        "q_ranking_by_tokens": f"""WITH {_TOTALS} SELECT airline_code, successful_response_records,
            success_token_count FROM totals ORDER BY success_token_count DESC, airline_code LIMIT 20""",
        "q_airline_share": f"""WITH {_TOTALS} SELECT airline_code, successful_response_records,
            success_token_count, successful_response_records /
            (SELECT CAST(SUM(successful_response_records) AS DOUBLE) FROM totals)
            AS successful_response_share, success_token_count /
            (SELECT CAST(SUM(success_token_count) AS DOUBLE) FROM totals) AS success_token_share
            FROM totals""",
        "q_overview": f"""WITH {_SERVING} SELECT COUNT(*) AS metric_rows,
            COUNT(DISTINCT airline_code) AS airline_count, {_SUMS},
            strftime(MIN(stat_date), '%Y-%m-%d') AS start_date,
            strftime(MAX(stat_date), '%Y-%m-%d') AS end_date,
            MIN(publication_id) AS publication_id FROM serving""",
        "q_timeline": f"""WITH {_SERVING} SELECT strftime(stat_date, '%Y-%m-%d') AS stat_date,
            stat_hour, {_SUMS} FROM serving GROUP BY ALL ORDER BY 1, 2""",
        "q_airline_count": f"""WITH {_SERVING} SELECT COUNT(DISTINCT airline_code) AS total_airlines
            FROM serving""",
        "q_airline_ranking": f"""WITH {_TOTALS} SELECT airline_code, successful_response_records,
            success_token_count FROM totals
            ORDER BY successful_response_records DESC, airline_code LIMIT 20""",
        "q_airline_timeline": f"""WITH {_SERVING} SELECT strftime(stat_date, '%Y-%m-%d') AS stat_date,
            stat_hour, successful_response_records, success_token_count
            FROM serving WHERE airline_code = 'CA' ORDER BY 1, 2""",
        "q_heatmap": f"""WITH {_TOTALS} SELECT airline_rank, airline_code, stat_hour,
            CAST(SUM(s.successful_response_records) AS BIGINT) AS successful_response_records,
            CAST(SUM(s.success_token_count) AS BIGINT) AS success_token_count
            FROM serving s JOIN ranked r USING (airline_code) WHERE airline_rank <= 4
            GROUP BY ALL ORDER BY 1, 3""",
        "set_heatmap_axes": f"""WITH {_TOTALS}, cells AS (SELECT airline_rank, airline_code,
              stat_hour FROM serving JOIN ranked USING (airline_code) WHERE airline_rank <= 4)
            SELECT DISTINCT 'airline' AS axis, airline_rank AS position, airline_code AS label
            FROM cells UNION ALL SELECT DISTINCT 'hour', stat_hour, CAST(stat_hour AS VARCHAR)
            FROM cells""",
        "win_airline_rank": f"""WITH {_TOTALS} SELECT airline_code, airline_rank,
            successful_response_records, success_token_count FROM ranked WHERE airline_rank <= 4""",
        "join_ranked_airlines": f"""WITH {_TOTALS} SELECT airline_rank, airline_code,
            strftime(stat_date, '%Y-%m-%d') AS stat_date, stat_hour,
            s.successful_response_records, s.success_token_count
            FROM serving s JOIN ranked r USING (airline_code) WHERE airline_rank <= 4""",
    }


_ENVELOPES = f"""{_LINES},
envelopes AS (
  SELECT raw_line, line_number, event_id % 103 AS slot, ts,
    sha256('events') AS source_sha,
    sha256('1' || chr(10) || sha256('events') || chr(10) || line_number || chr(10) || raw_line)
      AS true_id,
    nullif(trim(split_part(raw_line, ',', 1)), '') AS true_group,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS produced,
    CAST(event_id % 3 AS INTEGER) AS "partition", event_id // 3 AS "offset"
  FROM lines),
encoded AS (
  SELECT *, coalesce(true_group, true_id) AS true_key,
    '{{"event_id":"' || CASE slot WHEN 3 THEN repeat('0', 64) ELSE true_id END ||
    '","group_id":' || coalesce('"' || true_group || '"', 'null') ||
    ',"produced_at":"' || produced || '","raw_line":"' || raw_line ||
    '","schema_version":' || CASE slot WHEN 2 THEN 2 ELSE 1 END ||
    ',"source_file":"events","source_file_sha256":"' || source_sha ||
    '","source_line_number":' || line_number || '}}' AS document
  FROM envelopes),
broker AS (
  SELECT *, CASE slot WHEN 4 THEN 'WRONG' ELSE true_key END AS kafka_key,
    CASE slot WHEN 0 THEN 'not-json' WHEN 1 THEN '{{}}' ELSE document END AS value_text
  FROM encoded),
parsed AS (
  SELECT "partition", "offset", kafka_key, value_text, 'gds.raw.v1' AS topic,
    epoch_us(ts) AS kafka_timestamp, json_valid(value_text) AS is_json,
    CASE WHEN json_valid(value_text) THEN value_text::JSON END AS doc
  FROM broker),
decoded AS (
  SELECT * EXCLUDE (doc),
    TRY_CAST(doc->>'$.schema_version' AS INTEGER) AS schema_version,
    doc->>'$.event_id' AS event_id, doc->>'$.source_file' AS source_file,
    doc->>'$.source_file_sha256' AS source_file_sha256,
    TRY_CAST(doc->>'$.source_line_number' AS BIGINT) AS source_line_number,
    doc->>'$.group_id' AS group_id, doc->>'$.raw_line' AS raw_line,
    doc->>'$.produced_at' AS produced_at
  FROM parsed),
judged AS (
  SELECT *, sha256('1' || chr(10) || source_file_sha256 || chr(10) || source_line_number ||
      chr(10) || raw_line) AS expected_id,
    CASE WHEN NOT is_json THEN 'invalid_json'
      WHEN schema_version IS NULL OR event_id IS NULL OR source_file IS NULL
        OR source_file_sha256 IS NULL OR source_line_number IS NULL OR raw_line IS NULL
        OR produced_at IS NULL THEN 'missing_required_fields'
      WHEN schema_version <> 1 THEN 'unsupported_schema_version'
      WHEN event_id <> expected_id THEN 'event_id_mismatch'
      WHEN kafka_key IS DISTINCT FROM coalesce(nullif(group_id, ''), expected_id)
        THEN 'kafka_key_mismatch' END AS envelope_reason
  FROM decoded),
trusted AS (SELECT * FROM judged WHERE envelope_reason IS NULL)"""
_ACCEPTED = f"{_ENVELOPES},{_classified('accepted', 'trusted')}"
_ACCEPTED_TOKENS = f"{_ACCEPTED},{_tokens('accepted_tokens', 'accepted')}"
_EVENT_CUBE = f"{_ACCEPTED_TOKENS},{_cube('event_cube', 'accepted_tokens', 'event_id')}"
_RAW = """schema_version, event_id, source_file, source_file_sha256, source_line_number,
  group_id, raw_line, produced_at, topic, "partition", "offset", kafka_timestamp"""
_DEAD = f"""{_ACCEPTED},
dead AS (
  SELECT {_RAW}, value_text, 'envelope' AS failure_stage, envelope_reason AS failure_reason
  FROM judged WHERE envelope_reason IS NOT NULL
  UNION ALL SELECT {_RAW}, NULL, 'gds', record_reason FROM accepted
  WHERE record_reason IS NOT NULL)"""
_QUALITY = f"""{_DEAD},
quality AS (
  SELECT 'input_count' AS metric_name, NULL::VARCHAR AS failure_stage,
    NULL::VARCHAR AS failure_reason, COUNT(*) AS metric_value FROM judged
  UNION ALL SELECT 'envelope_valid_count', NULL, NULL, COUNT(*) FROM trusted
  UNION ALL SELECT 'business_valid_count', NULL, NULL, COUNT(*) FROM accepted
    WHERE record_reason IS NULL
  UNION ALL SELECT 'dead_letter_count', failure_stage, failure_reason, COUNT(*)
    FROM dead GROUP BY ALL)"""


def _envelope_queries() -> dict[str, str]:
    return {
        "env_event_id": f"""WITH {_ENVELOPES} SELECT line_number AS source_line_number,
            true_id AS event_id FROM encoded""",
        "env_group_id": f"""WITH {_ENVELOPES} SELECT line_number AS source_line_number,
            true_group AS group_id FROM encoded""",
        "env_kafka_key": f"""WITH {_ENVELOPES} SELECT "partition", "offset", true_key AS "key"
            FROM encoded""",
        "env_build": f"""WITH {_LINES} SELECT
            coalesce(nullif(trim(split_part(raw_line, ',', 1)), ''), id) AS "key",
            '{{"event_id":"' || id || '","group_id":' ||
            coalesce('"' || nullif(trim(split_part(raw_line, ',', 1)), '') || '"', 'null') ||
            ',"produced_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","raw_line":"' ||
            raw_line || '","schema_version":1,"source_file":"events","source_file_sha256":"' ||
            sha256('events') || '","source_line_number":' || line_number || '}}' AS "value"
            FROM (SELECT *, sha256('1' || chr(10) || sha256('events') || chr(10) || line_number
              || chr(10) || raw_line) AS id FROM lines)""",
        "env_decode": f"""WITH {_ENVELOPES} SELECT kafka_key, value_text, {_RAW} FROM decoded""",
        "env_classify": f"""WITH {_ENVELOPES} SELECT "partition", "offset", envelope_reason
            FROM judged""",
        "env_split_valid": f"WITH {_ENVELOPES} SELECT {_RAW} FROM trusted",
        "env_split_dead": f"""WITH {_ENVELOPES} SELECT {_RAW}, value_text,
            'envelope' AS failure_stage, envelope_reason AS failure_reason
            FROM judged WHERE envelope_reason IS NOT NULL""",
        "env_strict_check": f"""WITH {_ENVELOPES} SELECT "partition", "offset",
            CASE WHEN envelope_reason IS NULL THEN event_id END AS verified_id,
            CASE envelope_reason WHEN 'missing_required_fields' THEN 'missing_fields'
              ELSE envelope_reason END AS violation FROM judged""",
    }


def _metric_queries() -> dict[str, str]:
    cube = f"{_ANY_DIM}, successful_response_records, success_token_count"
    return {
        "agg_token_counts": f"""WITH {_ACCEPTED_TOKENS} SELECT {_ANY_DIM},
            COUNT(*) AS success_token_count FROM accepted_tokens GROUP BY ALL""",
        "set_dedupe_event_airline": f"""WITH {_ACCEPTED_TOKENS}
            SELECT DISTINCT {_ANY_DIM}, event_id FROM accepted_tokens""",
        "agg_response_counts": f"""WITH {_ACCEPTED_TOKENS} SELECT {_ANY_DIM},
            COUNT(DISTINCT event_id) AS successful_response_records
            FROM accepted_tokens GROUP BY ALL""",
        "join_delta_metrics": f"""WITH {_ACCEPTED_TOKENS},
            r AS (SELECT {_ANY_DIM}, COUNT(*) AS successful_response_records FROM
              (SELECT DISTINCT {_ANY_DIM}, event_id FROM accepted_tokens) GROUP BY ALL),
            t AS (SELECT {_ANY_DIM}, COUNT(*) AS success_token_count
              FROM accepted_tokens GROUP BY ALL)
            SELECT {cube} FROM r JOIN t USING ({_ANY_DIM})""",
        "agg_hourly_deltas": f"""WITH {_EVENT_CUBE} SELECT CAST(7 AS BIGINT) AS batch_id, {cube}
            FROM event_cube""",
        "agg_merge_metrics": f"""WITH {_ACCEPTED_TOKENS}, deltas AS (
              SELECT "partition", {_ANY_DIM}, COUNT(DISTINCT event_id) AS
              successful_response_records, COUNT(*) AS success_token_count
              FROM accepted_tokens GROUP BY ALL)
            SELECT {_ANY_DIM}, {_SUMS} FROM deltas GROUP BY ALL""",
        "agg_quality": f"WITH {_QUALITY} SELECT CAST(7 AS BIGINT) AS batch_id, * FROM quality",
        "set_quality_union": f"""WITH {_QUALITY} SELECT CAST(7 AS BIGINT) AS batch_id, *
            FROM quality""",
        "agg_batch_summary": f"""WITH {_QUALITY} SELECT CAST(7 AS BIGINT) AS batch_id,
            {", ".join(
                f"CAST(SUM(metric_value) FILTER (metric_name = '{name}') AS BIGINT) AS {name}"
                for name in ("input_count", "envelope_valid_count", "business_valid_count",
                             "dead_letter_count"))} FROM quality""",
        "set_dead_union": f"WITH {_DEAD} SELECT * FROM dead",
        "set_kafka_locations": f"""WITH {_ENVELOPES} SELECT DISTINCT "partition", "offset"
            FROM judged""",
    }


def _audit_queries() -> dict[str, str]:
    sources = """landed AS (
      SELECT source_file, source_line_number FROM trusted
      UNION ALL SELECT source_file || '-' || (source_line_number % 7),
        (source_line_number + 6) // 7 FROM trusted)"""
    return {
        "agg_topic_verify": f"""WITH {_ENVELOPES} SELECT COUNT(*) AS total,
            COUNT(*) FILTER (envelope_reason IS NULL) AS valid,
            COUNT(*) FILTER (envelope_reason IS NOT NULL) AS invalid,
            COUNT(*) FILTER (envelope_reason IS NULL) - COUNT(DISTINCT
              CASE WHEN envelope_reason IS NULL THEN event_id END) AS duplicate_event_ids
            FROM judged""",
        "agg_partition_counts": f"""WITH {_ENVELOPES} SELECT "partition", COUNT(*) AS records
            FROM judged GROUP BY ALL""",
        "agg_pipeline_inspect": f"""WITH {_DEAD}, counts AS (SELECT
              (SELECT COUNT(*) FROM judged) AS input_count,
              (SELECT COUNT(*) FROM trusted) AS envelope_valid_count,
              (SELECT COUNT(*) FROM accepted WHERE record_reason IS NULL) AS business_valid_count,
              (SELECT COUNT(*) FROM dead) AS dead_letter_count,
              (SELECT COUNT(*) FROM dead WHERE failure_stage = 'envelope') AS e,
              (SELECT COUNT(*) FROM dead WHERE failure_stage = 'gds') AS g,
              (SELECT COUNT(DISTINCT ("partition", "offset")) FROM judged)
                AS unique_kafka_locations)
            SELECT * EXCLUDE (e, g), envelope_valid_count + e AS raw_plus_envelope_dead_count,
              business_valid_count + g AS clean_plus_business_dead_count FROM counts""",
        "agg_partition_offsets": f"""WITH {_ENVELOPES} SELECT "partition", COUNT(*) AS records,
            MIN("offset") AS first_offset, MAX("offset") AS last_offset FROM broker GROUP BY 1""",
        "join_reconcile": f"""WITH {_EVENT_CUBE},{_classified('log', 'lines')},
            {_tokens('tokens', 'log')},{_cube('cube', 'tokens', 'line_number')}
            SELECT {_ANY_DIM}, a.successful_response_records AS actual_successful_response_records,
              a.success_token_count AS actual_success_token_count,
              e.successful_response_records AS expected_successful_response_records,
              e.success_token_count AS expected_success_token_count
            FROM event_cube a FULL JOIN cube e USING ({_ANY_DIM})
            WHERE a.successful_response_records IS DISTINCT FROM e.successful_response_records
              OR a.success_token_count IS DISTINCT FROM e.success_token_count""",
        "win_contiguous_prefix": f"""WITH {_ENVELOPES}, {sources},
            numbered AS (SELECT source_file, source_line_number AS n, row_number() OVER (
                PARTITION BY source_file ORDER BY source_line_number) AS rn
              FROM (SELECT DISTINCT * FROM landed))
            SELECT source_file, COALESCE(MAX(n) FILTER (n = rn), 0) AS confirmed_line,
              COUNT(*) AS distinct_lines FROM numbered GROUP BY source_file""",
        "win_line_gaps": f"""WITH {_ENVELOPES},
            steps AS (SELECT source_file, source_line_number AS n, COALESCE(
                lag(source_line_number) OVER (PARTITION BY source_file
                ORDER BY source_line_number), 0) AS p
              FROM (SELECT DISTINCT source_file, source_line_number FROM trusted))
            SELECT source_file, p + 1 AS first_missing, n - 1 AS last_missing
            FROM steps WHERE n - p > 1""",
    }


_COPIES = f"""{_LINES}, copies AS (
  SELECT sha256(raw_line) AS sha256, COUNT(*) AS occurrences FROM lines GROUP BY ALL)"""
_DUPLICATES = """CAST(COALESCE(SUM(occurrences - 1) FILTER (occurrences > 1), 0) AS BIGINT)
    AS duplicate_record_count, COUNT(*) FILTER (occurrences > 1) AS duplicate_group_count"""


def _profile_queries() -> dict[str, str]:
    return {
        "agg_profile_totals": f"""WITH {_LOG_CUBE}, copies AS (
              SELECT raw_line, COUNT(*) AS occurrences FROM lines GROUP BY ALL)
            SELECT * FROM (SELECT COUNT(*) AS physical_line_count,
              COUNT(*) FILTER (record_reason = 'blank_line') AS blank_line_count,
              COUNT(*) FILTER (record_reason IS NULL) AS valid_count,
              COUNT(*) FILTER (record_reason <> 'unsupported_log_type') AS invalid_count,
              COUNT(*) FILTER (record_reason = 'unsupported_log_type') AS unsupported_count,
              MIN(event_date) FILTER (record_reason IS NULL) AS earliest_date,
              MAX(event_date) FILTER (record_reason IS NULL) AS latest_date,
              array_to_string(list_sort(list(DISTINCT event_hour)
                FILTER (record_reason IS NULL)), ',') AS observed_hours FROM log),
            (SELECT array_to_string(list_sort(list(DISTINCT airline_code)), ',')
              AS airline_codes, CAST(SUM(success_token_count) AS BIGINT) AS total_success_tokens,
              CAST(SUM(successful_response_records) AS BIGINT) AS successful_response_records
              FROM cube),
            (SELECT {_DUPLICATES} FROM copies)""",
        "agg_log_types": f"""WITH {_LOG} SELECT log_type, COUNT(*) AS records FROM log
            WHERE field_count >= 5 AND log_type <> '' GROUP BY ALL""",
        "agg_failure_reasons": f"""WITH {_LOG} SELECT record_reason AS failure_reason,
            COUNT(*) AS records FROM log WHERE record_reason IS NOT NULL GROUP BY ALL""",
        "agg_fingerprints": f"WITH {_COPIES} SELECT {_DUPLICATES} FROM copies",
        "sort_duplicates": f"""WITH {_COPIES} SELECT sha256, occurrences FROM copies
            WHERE occurrences > 1 ORDER BY occurrences DESC, sha256""",
        "lim_invalid_records": f"""WITH {_LOG} SELECT line_number, record_reason AS failure_reason,
            raw_line FROM log WHERE record_reason <> 'unsupported_log_type'
            ORDER BY line_number LIMIT 1000""",
    }


_SNAPSHOT = f"""{_LOG_CUBE}, snapshot AS (
  SELECT event_date AS stat_date, event_hour AS stat_hour, airline_code,
    successful_response_records, success_token_count AS successful_booking_tokens FROM cube)"""
_DAYS = f"""{_LOG_CUBE},
days AS (SELECT event_date, strptime(event_date, '%Y%m%d') AS started, COUNT(*) AS
  source_row_count, {_SUMS} FROM cube GROUP BY event_date),
publication_log AS (
  SELECT 'day-' || event_date AS publication_id, 'root-' || (day(started) % 2) AS
    source_hdfs_root, 'v1' AS output_version, source_row_count, successful_response_records,
    success_token_count, sha256(substr(event_date, 1, 7)) AS metrics_sha256,
    CASE WHEN day(started) % 5 = 0 THEN 'failed' ELSE 'published' END AS status,
    CASE WHEN day(started) % 5 = 0 THEN 'refused' END AS failure_message,
    strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at,
    strftime(started + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS completed_at FROM days),
daily AS (SELECT 'day-' || event_date AS publication_id,
  strftime(strptime(event_date, '%Y%m%d'), '%Y-%m-%d') AS stat_date, event_hour AS stat_hour,
  airline_code, successful_response_records, success_token_count FROM cube)"""
_STAGED = """COUNT(*) AS row_count,
    CAST(COALESCE(SUM(successful_response_records), 0) AS BIGINT) AS successful_response_records,
    CAST(COALESCE(SUM(success_token_count), 0) AS BIGINT) AS success_token_count"""


def _snapshot_queries() -> dict[str, str]:
    newest = "WHERE status = 'published' ORDER BY completed_at DESC LIMIT 1"
    return {
        "snap_check_row": f"""WITH {_SNAPSHOT}, damaged AS (SELECT
              CASE stat_hour WHEN 1 THEN substr(stat_date, 1, 7) ELSE stat_date END AS stat_date,
              CASE stat_hour WHEN 5 THEN 24 ELSE stat_hour END AS stat_hour,
              CASE stat_hour WHEN 2 THEN lower(airline_code) ELSE airline_code END AS airline_code,
              CASE stat_hour WHEN 3 THEN -successful_response_records
                ELSE successful_response_records END AS successful_response_records,
              CASE stat_hour WHEN 4 THEN successful_response_records - 1
                ELSE successful_booking_tokens END AS successful_booking_tokens FROM snapshot)
            SELECT *, CASE WHEN length(stat_date) <> 8 THEN 'invalid_stat_date'
              WHEN stat_hour NOT BETWEEN 0 AND 23 THEN 'hour_out_of_range'
              WHEN NOT regexp_full_match(airline_code, '[A-Z0-9]{{1,8}}')
                THEN 'invalid_airline_code'
              WHEN least(successful_response_records, successful_booking_tokens) < 0
                THEN 'negative_metric'
              WHEN successful_booking_tokens < successful_response_records
                THEN 'tokens_below_responses' END AS violation FROM damaged""",
        "snap_check_keys": f"""WITH {_SNAPSHOT} SELECT stat_date,
            CAST(CASE stat_hour WHEN 13 THEN 12 ELSE stat_hour END AS INTEGER) AS stat_hour,
            airline_code, COUNT(*) AS copies FROM snapshot GROUP BY ALL HAVING COUNT(*) > 1""",
        "agg_snapshot_totals": f"""WITH {_SNAPSHOT} SELECT COUNT(*) AS row_count,
            CAST(SUM(successful_response_records) AS BIGINT) AS successful_response_records,
            CAST(SUM(successful_booking_tokens) AS BIGINT) AS success_token_count FROM snapshot""",
        "sort_canonical": f"""WITH {_SNAPSHOT} SELECT sha256('stat_date,stat_hour,airline_code,' ||
            'successful_response_records,successful_booking_tokens' || chr(10) ||
            string_agg(stat_date || ',' || stat_hour || ',' || airline_code || ',' ||
              successful_response_records || ',' || successful_booking_tokens, chr(10)
              ORDER BY stat_date, stat_hour, airline_code) || chr(10)) AS metrics_sha256
            FROM snapshot""",
        "src_serving": f"""WITH {_SERVING} SELECT strftime(stat_date, '%Y-%m-%d') AS stat_date,
            stat_hour, airline_code, successful_response_records, success_token_count
            FROM serving""",
        "q_latest_publication": f"WITH {_DAYS} SELECT * FROM publication_log {newest}",
        "q_recent_publications": f"""WITH {_DAYS} SELECT publication_id, status,
            source_row_count AS row_count, metrics_sha256, completed_at
            FROM publication_log ORDER BY started_at DESC LIMIT 10""",
        "q_find_publication": f"""WITH {_DAYS} SELECT * FROM publication_log
            WHERE source_hdfs_root = 'root-1' AND status = 'published' AND metrics_sha256 =
              (SELECT arg_min(metrics_sha256, started_at) FROM publication_log)
            ORDER BY completed_at DESC LIMIT 1""",
        "join_exists_current": f"""WITH {_DAYS} SELECT publication_id, status
            FROM publication_log l WHERE EXISTS (SELECT 1 FROM daily d
              WHERE d.publication_id = l.publication_id)""",
        "join_scalar_current_hash": f"""WITH {_DAYS} SELECT metrics_sha256 FROM publication_log
            WHERE publication_id = (SELECT MIN(publication_id) FROM daily)
              AND status = 'published'""",
        "agg_stage_verify": f"""WITH {_DAYS} SELECT {_STAGED} FROM daily WHERE publication_id =
            (SELECT publication_id FROM publication_log {newest})""",
        "agg_serving_verify": f"""WITH {_DAYS} SELECT {_STAGED},
            COUNT(DISTINCT publication_id) AS publication_count FROM daily""",
    }


_SIZES = """SELECT 'raw_events' AS dataset, COUNT(*) AS records FROM trusted
  UNION ALL SELECT 'clean_events', COUNT(*) FROM accepted WHERE record_reason IS NULL
  UNION ALL SELECT 'dead_letter', COUNT(*) FROM dead
  UNION ALL SELECT 'hourly_airline_deltas', COUNT(*) FROM event_cube"""
_DEAD_AND_CUBE = f"""{_DEAD},{_tokens('accepted_tokens', 'accepted')},
  {_cube('event_cube', 'accepted_tokens', 'event_id')}"""


def _pipeline_queries() -> dict[str, str]:
    cube = f"{_ANY_DIM}, successful_response_records, success_token_count"
    inspected = _audit_queries()["agg_pipeline_inspect"]
    digest = _snapshot_queries()["sort_canonical"]
    manifest = f"""SELECT (SELECT metrics_sha256 FROM digest) AS metrics_sha256,
        'v1' AS output_version, COUNT(*) AS row_count, 1 AS schema_version,
        'events-root' AS source_hdfs_root,
        CAST(SUM(successful_booking_tokens) AS BIGINT) AS success_token_count,
        CAST(SUM(successful_response_records) AS BIGINT) AS successful_response_records"""
    digest_cte = f"digest AS ({digest})"
    words = [f"CAST(SUM(CAST('0x' || substr(sha, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)]
    tree = f"""{_LINES}, hashed AS (SELECT (line_number - 1) // 4096 AS number,
          sha256(line_number || ':' || raw_line) AS sha FROM lines),
        leaves AS (SELECT number, sha256(CAST(COUNT(*) AS VARCHAR) || ',' || {" || ',' || ".join(words)})
          AS digest FROM hashed GROUP BY number)"""
    for below, nodes in (("leaves", "middle"), ("middle", "upper"), ("upper", "top")):
        tree += f""", {nodes} AS (SELECT number // 1024 AS number,
          sha256(string_agg(digest, '' ORDER BY number)) AS digest FROM {below} GROUP BY number // 1024)"""
    return {
        "src_log_lines": f"WITH {_LINES} SELECT line_number, raw_line FROM lines",
        "src_tree_digest": f"""WITH {tree}, totals AS (
              SELECT CAST(SUM(strlen(raw_line) + 1) AS BIGINT) AS byte_size, COUNT(*) AS line_count FROM lines)
            SELECT byte_size, line_count, sha256(byte_size || ',' || line_count || ',' || digest)
            AS tree_sha256 FROM totals, top""",
        "src_file_identity": f"""WITH {_SNAPSHOT}, body AS (SELECT
            'stat_date,stat_hour,airline_code,successful_response_records,successful_booking_tokens'
            || chr(10) || string_agg(stat_date || ',' || stat_hour || ',' || airline_code || ',' ||
              successful_response_records || ',' || successful_booking_tokens, chr(10)
              ORDER BY stat_date, stat_hour, airline_code) || chr(10) AS text FROM snapshot)
            SELECT 'metrics.csv' AS path, CAST(strlen(text) AS BIGINT) AS byte_size,
            sha256(text) AS sha256 FROM body""",
        "src_parquet_batches": f"""WITH {_ENVELOPES} SELECT {_RAW.replace(', kafka_timestamp', '')},
            CAST(0 AS BIGINT) AS batch_id FROM trusted""",
        "src_snapshot_csv": f"""WITH {_SNAPSHOT} SELECT 1 + row_number() OVER (
            ORDER BY stat_date, stat_hour, airline_code) AS line_number, *,
            NULL::VARCHAR AS violation FROM snapshot""",
        "src_manifest": f"""WITH {_SNAPSHOT}, {digest_cte} {manifest},
            NULL::VARCHAR AS violation FROM snapshot""",
        "src_kafka_stream": f"""WITH {_ENVELOPES} SELECT "partition", "offset" FROM broker""",
        "sink_envelope_kafka": f"""WITH {_LINES}, own AS (SELECT *,
              nullif(trim(split_part(raw_line, ',', 1)), '') AS g, sha256('1' || chr(10) ||
              repeat('e', 64) || chr(10) || line_number || chr(10) || raw_line) AS id FROM lines)
            SELECT coalesce(g, id) AS "key", '{{"event_id":"' || id || '","group_id":' ||
            coalesce('"' || g || '"', 'null') || ',"produced_at":"","raw_line":"' || raw_line ||
            '","schema_version":1,"source_file":"events","source_file_sha256":"' ||
            repeat('e', 64) || '","source_line_number":' || line_number || '}}' AS "value"
            FROM own""",
        "sink_batch_outputs": f"""WITH {_DEAD} SELECT failure_stage, failure_reason,
            COUNT(*) AS records FROM dead GROUP BY ALL""",
        "sink_replace_batch": f"""WITH {_ENVELOPES} SELECT 'dead_letter' AS dataset,
              COUNT(*) AS records FROM broker WHERE value_text = 'not-json'
            UNION ALL SELECT unnest(['raw_events', 'clean_events', 'hourly_airline_deltas']), 0""",
        "sink_commit_marker": f"""WITH {_DEAD} SELECT CAST(0 AS BIGINT) AS batch_id,
            (SELECT COUNT(*) FROM judged) AS input_count,
            (SELECT COUNT(*) FROM trusted) AS envelope_valid_count,
            (SELECT COUNT(*) FROM accepted WHERE record_reason IS NULL) AS business_valid_count,
            (SELECT COUNT(*) FROM dead) AS dead_letter_count""",
        "sink_publish_metrics": f"WITH {_EVENT_CUBE} SELECT {cube} FROM event_cube",
        "agg_levelled_merge": f"WITH {_EVENT_CUBE} SELECT {cube} FROM event_cube",
        "sink_ledger_snapshot": f"""WITH {_ENVELOPES} SELECT CAST("offset" % 5 AS BIGINT) AS batch_id,
            COUNT(*) AS input_count FROM broker GROUP BY ALL""",
        "sink_snapshot_csv": f"WITH {_SNAPSHOT}, {digest_cte} {manifest} FROM snapshot",
        "sink_snapshot_parts": f"""WITH {_SNAPSHOT}, text AS (SELECT 1 AS line_number,
              'stat_date,stat_hour,airline_code,successful_response_records,successful_booking_tokens'
              AS raw_line UNION ALL SELECT 1 + row_number() OVER (ORDER BY stat_date, stat_hour,
              airline_code), stat_date || ',' || stat_hour || ',' || airline_code || ',' ||
              successful_response_records || ',' || successful_booking_tokens FROM snapshot),
            totals AS (SELECT COUNT(*) AS row_count, {_SUMS} FROM cube)
            SELECT *, (SELECT CAST(SUM(strlen(raw_line) + 1) AS BIGINT) FROM text) AS byte_size
            FROM text, totals""",
        "join_reconcile_ranges": _audit_queries()["join_reconcile"],
        "str_confirmed_prefix": _audit_queries()["win_contiguous_prefix"],
        "sink_publication": f"""WITH {_SNAPSHOT}, {digest_cte}, totals AS (
              SELECT COUNT(*) AS source_row_count, {_SUMS} FROM cube)
            SELECT 'events-root' AS source_hdfs_root, totals.*,
              (SELECT metrics_sha256 FROM digest) AS metrics_sha256, 'published' AS status,
              served FROM totals, (VALUES (true), (false)) AS v(served)""",
        "sink_profile": f"""SELECT * EXCLUDE (earliest_date, latest_date, observed_hours,
            airline_codes) FROM ({_profile_queries()["agg_profile_totals"]})""",
        "str_start_query": inspected,
        "str_trigger_available_now": f"WITH {_EVENT_CUBE} SELECT {cube} FROM event_cube",
        "str_trigger_processing_time": inspected,
        "str_resume": f"""WITH {_ENVELOPES} SELECT CASE WHEN "offset" % 5 < 2 THEN 0 ELSE 1
            END::BIGINT AS batch_id, COUNT(*) AS input_count FROM broker GROUP BY ALL""",
        "str_persist_batch": f"WITH {_DEAD_AND_CUBE} {_SIZES}",
        "str_single_scan": f"""WITH {_DEAD} SELECT 'clean_events' AS dataset, COUNT(*) AS records,
            COUNT(*) AS same_reading FROM accepted WHERE record_reason IS NULL
            UNION ALL SELECT 'dead_letter', COUNT(*), COUNT(*) FROM dead WHERE failure_stage = 'gds'
            HAVING COUNT(*) > 0""",
        "set_first_batches": f"""WITH {_ACCEPTED_TOKENS} SELECT {_ANY_DIM}, event_id,
            CAST(MIN(greatest("offset" % 4 - 1, 0)) AS BIGINT) AS first_batch
            FROM accepted_tokens GROUP BY ALL""",
        "set_fresh_events": f"""WITH {_ACCEPTED_TOKENS} SELECT {_ANY_DIM}, event_id
            FROM accepted_tokens GROUP BY ALL HAVING MIN("offset" % 4) = 2""",
        "agg_distinct_responses": f"""WITH {_ACCEPTED_TOKENS} SELECT {_ANY_DIM},
            COUNT(DISTINCT event_id) AS successful_response_records FROM accepted_tokens GROUP BY ALL""",
        "sink_clean_by_date": f"""WITH {_ACCEPTED}, filed AS (
              SELECT CAST("offset" % 2 AS BIGINT) AS batch_id, event_date, event_hour, event_id, log_type
              FROM accepted WHERE record_reason IS NULL AND "offset" % 4 <> 3)
            SELECT * FROM filed WHERE strptime(event_date, '%Y%m%d') >
                (SELECT MIN(strptime(event_date, '%Y%m%d')) FROM filed)
              AND strptime(event_date, '%Y%m%d') <
                (SELECT MAX(strptime(event_date, '%Y%m%d')) FROM filed)""",
        "str_progress": f"""WITH {_DEAD} SELECT (SELECT COUNT(*) FROM judged) AS input_count,
            COUNT(*) AS dead_letter_count FROM dead""",
        "agg_validate_outputs": f"""WITH {_QUALITY},{_tokens('accepted_tokens', 'accepted')},
            {_cube('event_cube', 'accepted_tokens', 'event_id')}
            SELECT (SELECT COUNT(*) FROM trusted) AS raw,
            (SELECT COUNT(*) FROM accepted WHERE record_reason IS NULL) AS clean,
            (SELECT COUNT(*) FROM dead) AS dead, (SELECT COUNT(*) FROM quality) AS quality_rows,
            (SELECT COUNT(*) FROM event_cube) AS final_metric_rows, true AS valid""",
        "str_refresh_cycle": f"""WITH {_EVENT_CUBE} SELECT event_date AS stat_date,
            event_hour AS stat_hour, airline_code, successful_response_records,
            success_token_count AS successful_booking_tokens FROM event_cube""",
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_records_queries(),
        **_serving_queries(),
        **_envelope_queries(),
        **_metric_queries(),
        **_audit_queries(),
        **_profile_queries(),
        **_snapshot_queries(),
        **_pipeline_queries(),
    }
