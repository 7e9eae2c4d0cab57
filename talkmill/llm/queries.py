"""The queries of the training-data problems, and SQL for those that it can say.

The others take models, tokenizers or iteration; tests/llm compares them with brute force, round trips and held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import dedup, mix, pages, repetition, residue, split, subjects, tokenize, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        subjects.p1_found, subjects.p1_composition, split.p2_found, split.p2_pieces, pages.p3_found, pages.p3_body, dedup.p4_found, turns.p5_found, turns.p5_turns,
        repetition.p6_found, repetition.p6_shares, tokenize.p7_ids, mix.p8_found, mix.p8_mix, mix.p8_shares, residue.p9_found, residue.p9_clean, residue.p9_messages,
    )
}

# White space and the other characters that part a text.
_PARTING = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]"
# The host of an address.
_HOST = r"lower(rtrim(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)', 1), '.'))"

SQL: dict[str, str] = {
    # The longest part between parting characters.
    "p2_found": rf"""WITH m AS (SELECT max(chars) AS most FROM split_settings WHERE setting = 'max_chars') SELECT row_id, CASE WHEN list_max(list_transform(string_split_regex(transcript, '{_PARTING}'), lambda x: length(x))) > most THEN 'forced' ELSE 'natural' END AS cut FROM videos, m WHERE length(transcript) > most""",
    # Forwarders followed, then the code or number of the video, then the first row that has it.
    "p4_found": rf"""WITH RECURSIVE h AS (SELECT lower(trim(host)) AS host, site FROM site_hosts WHERE host IS NOT NULL),
a AS (SELECT row_id, regexp_replace(replace(source_url, '&amp;', '&'), '^\s+|\s+$', '', 'g') AS url FROM videos WHERE source_url IS NOT NULL
UNION SELECT a.row_id, url_decode(regexp_extract(url, '[?&;][a-zA-Z_]+=((?:(?i:https?)(?::|%3A))?(?:/|%2F){{2}}[^&;#]*|[a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_-]+)+(?::\d+)?(?:/|%2F)[^&;#]*)', 1)) FROM a JOIN h ON h.host = {_HOST} AND h.site IS NULL WHERE regexp_matches(url, '=.*(/|%2F)')),
p AS (SELECT row_id, site, url_decode(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?[^/:?#]+(?::\d*)?([^?#]*)', 1)) AS path, url_decode(regexp_extract(url, '\?([^#]*)', 1)) AS query FROM a JOIN h ON h.host = {_HOST} AND h.site IS NOT NULL),
k AS (SELECT row_id, site, coalesce(nullif(regexp_extract(query, '(?i)(?:^|[&;])(?:ep|episode)=(\d+)(?:[&;]|$)', 1), ''), nullif(regexp_extract(path, '(?i)/(?:episodes?|ep)/(\d+)(?:/|$)', 1), '')) AS number,
coalesce(nullif(regexp_extract(query, '(?:^|[&;])[vV]=([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(path, '(?i)/(?:embed|live|item|v|watch|shorts)/([A-Za-z0-9_-]+)', 1), ''), nullif(CASE WHEN NOT regexp_matches(lower(path), '^/+(watch|embed|live|item|show|out)/*$') THEN regexp_extract(path, '^/+([A-Za-z0-9_-]+)[^/]*/*$', 1) END, '')) AS code FROM p),
f AS (SELECT row_id, min(row_id) OVER (PARTITION BY site, number IS NULL, coalesce(number::BIGINT::VARCHAR, code)) AS first_row_id FROM k WHERE number IS NOT NULL OR code IS NOT NULL)
SELECT DISTINCT first_row_id, row_id FROM f WHERE first_row_id < row_id""",
}
