"""The operators as queries over the test tables, and the SQL that DuckDB answers alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions.arrow import map_rows
from talkmill.functions.text import NO_CAPTIONS, collapse, preview, sentences, slug, strip
from talkmill.functions.timecode import ms_to_timecode, safe_seconds, timecode_to_ms
from talkmill.models import Heuristic
from talkmill.operators import classify as cl
from talkmill.operators import sequence as seq
from talkmill.operators.overlap import overlap_join, unprocessed
from talkmill.operators.summary import label_summary, subtopic_summary
from talkmill.operators.vocabulary import OTHER, first_spellings, label_key, override, slugged, with_other, with_position
from talkmill.plans import pipelines
from talkmill.session import shared_dir, spread, table
from talkmill.sinks import files
from talkmill.sources.tables import metadata, processed_urls, read_csv, read_labels, valid_segments, valid_videos
from talkmill.sources.transcripts import TEXT_FIELDS, TIME_FIELDS, UNSHOWN, from_word_tags, page_text, record_items, seconds_of, utterances

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The time a sentence takes in the queries over documents, and their chunks.
CHAR_MS, CHUNK_MS, OVERLAP_MS = 60, 12_000, 3_000
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+\z', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sentences of documents with times in proportion to their length, all in the rows of the documents.
_PARTS = r"""parts AS (SELECT doc_id, n_chars, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\f\r]+|[ \t\n\f\r]+\z', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"""
_U = f"""{_PARTS}, s AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS pos FROM parts),
u AS (SELECT doc_id, pos, text, ({CHAR_MS} * (sum(length(text)) OVER w - length(text)))::BIGINT AS start_ms, ({CHAR_MS} * sum(length(text)) OVER w)::BIGINT AS end_ms FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, min(start_ms) AS t0, max(end_ms) AS t1 FROM u GROUP BY doc_id)"""


def timed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, utterances, t0, t1) of the documents with at least one sentence."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text is not null").select("doc_id", sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    length = lambda x: (CHAR_MS * F.length(x)).cast("bigint")
    timed = lambda s, ends: F.zip_with(s, ends, lambda x, end: F.struct((end - length(x)).alias("start_ms"), end.alias("end_ms"), x.alias("text")))
    u = seq.let(timed, F.col("s"), seq.running_sum(F.transform("s", length)))
    d = seq.settled(d, utterances=u).select("doc_id", "utterances")
    t0, t1 = seq.extent(F.col("utterances"))
    return d.withColumns({"t0": t0, "t1": t1})


def _rows(df: DataFrame, column: str = "utterances", *keys: str) -> DataFrame:
    return df.select(*(keys or ("doc_id",)), F.posexplode(column).alias("pos", "_u")).select(*(keys or ("doc_id",)), "pos", "_u.*")


@query(
    f"""WITH {_PARTS}, e AS (SELECT doc_id, s, len(s) AS n, greatest(trunc(coalesce(n_chars, 0) / 15.0 * 1000)::BIGINT, len(s) * 1000) AS total FROM parts),
r AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS pos, n, total, greatest(total // n, 1) AS step FROM e WHERE n > 0)
SELECT doc_id, pos, pos * step AS start_ms, CASE WHEN pos = n - 1 THEN total ELSE (pos + 1) * step END AS end_ms, text FROM r"""
)
def sentences_even_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences spread evenly over a reading time."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")).filter("text is not null").select("doc_id", sentences(F.col("text")).alias("s"), (F.coalesce("n_chars", F.lit(0)) / 15.0).alias("seconds"))
    return _rows(d.select("doc_id", seq.even_spacing(F.col("s"), F.col("seconds")).alias("utterances")))


@query(
    f"""SELECT video_url, segment_id, timecode_in_ms, CASE WHEN timecode_in_ms // 3600000 > 0 THEN concat(timecode_in_ms // 3600000, ':', lpad((timecode_in_ms // 60000 % 60)::VARCHAR, 2, '0'), ':', lpad((timecode_in_ms // 1000 % 60)::VARCHAR, 2, '0'))
WHEN timecode_in_ms IS NOT NULL THEN concat(timecode_in_ms // 60000, ':', lpad((timecode_in_ms // 1000 % 60)::VARCHAR, 2, '0')) END AS rendered,
CASE len(p) WHEN 2 THEN (n1 * 60 + n2) * 1000 WHEN 3 THEN (n1 * 3600 + n2 * 60 + n3) * 1000 ELSE CASE WHEN timecode_in IS NOT NULL THEN 0 END END AS parsed
FROM (SELECT *, {", ".join(rf"CASE WHEN regexp_matches(p[{i}], '^[ ]*[+-]?[0-9]{{1,15}}[ ]*$') THEN try_cast(trim(p[{i}]) AS BIGINT) END AS n{i}" for i in (1, 2, 3))} FROM (SELECT *, string_split({_strip("timecode_in")}, ':') AS p FROM labeled_segments))"""
)
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as written and as read back."""
    d = table(spark, sf_dir, "labeled_segments")
    return d.select("video_url", "segment_id", "timecode_in_ms", ms_to_timecode(F.col("timecode_in_ms")).alias("rendered"), timecode_to_ms(F.col("timecode_in")).alias("parsed"))


_N = lambda c, i: rf"CASE WHEN regexp_matches(p_{c}[{i}], '^[ ]*[+-]?[0-9]{{1,15}}[ ]*$') THEN try_cast(trim(p_{c}[{i}]) AS BIGINT) END"
_MS = lambda c: f"CASE len(p_{c}) WHEN 2 THEN ({_N(c, 1)} * 60 + {_N(c, 2)}) * 1000 WHEN 3 THEN ({_N(c, 1)} * 3600 + {_N(c, 2)} * 60 + {_N(c, 3)}) * 1000 ELSE 0 END"


@query(
    f"""WITH t AS (SELECT video_url, segment_id, segment_duration_seconds, coalesce(nullif({_strip("timecode_in")}, ''), '0:00') AS timecode_in, coalesce(nullif({_strip("timecode_out")}, ''), '0:00') AS timecode_out FROM segments_review
WHERE coalesce({_strip("video_url")}, '') <> '' AND coalesce({_strip("segment_transcript")}, '') <> ''), p AS (SELECT *, string_split(timecode_in, ':') AS p_i, string_split(timecode_out, ':') AS p_o FROM t),
m AS (SELECT *, {_MS("i")} AS i, {_MS("o")} AS o FROM p)
SELECT video_url, segment_id, timecode_in, timecode_out, CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE i END AS timecode_in_ms, CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE o END AS timecode_out_ms, coalesce(segment_duration_seconds, 0) AS segment_duration_seconds FROM m"""
)
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid segments with derived times."""
    return valid_segments(spread(table(spark, sf_dir, "segments_review"))).select("video_url", "segment_id", "timecode_in", "timecode_out", "timecode_in_ms", "timecode_out_ms", "segment_duration_seconds")


@query(
    f"""SELECT row_id, {_strip("source_url")} AS source_url, round(CASE WHEN coalesce({_strip("duration_seconds")}, '') = '' THEN 0 WHEN regexp_matches({_strip("duration_seconds")}, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({_strip("duration_seconds")} AS DOUBLE) END, 3) AS seconds, length(transcript) AS n_chars
FROM videos WHERE coalesce({_strip("source_url")}, '') <> '' AND coalesce({_strip("transcript")}, '') <> '' AND NOT contains(transcript, '{NO_CAPTIONS}')"""
)
def video_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid videos with their durations."""
    return valid_videos(spread(table(spark, sf_dir, "videos"))).select("row_id", strip(F.col("source_url")).alias("source_url"), F.round(safe_seconds(F.col("duration_seconds")), 3).alias("seconds"), F.length("transcript").alias("n_chars"))


_ABOUT = ("source_url", "duration_seconds", "title", "creator_label", "upload_date", "view_count", "batch_no")
_SECONDS = rf"coalesce(CASE WHEN regexp_matches({_strip('duration_seconds')}, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({_strip('duration_seconds')} AS DOUBLE) END, 0)"


@query(
    f"""WITH v AS (SELECT * FROM videos WHERE coalesce({_strip("source_url")}, '') <> '' AND coalesce({_strip("transcript")}, '') <> '' AND NOT contains(transcript, '{NO_CAPTIONS}'))
{" UNION ALL ".join(f"SELECT row_id, '{c}' AS name, coalesce({_strip(f'{c}::VARCHAR')}, '') AS value FROM v" for c in _ABOUT)}
UNION ALL SELECT row_id, 'input_row_index', row_id::VARCHAR FROM v UNION ALL SELECT row_id, 'video_duration_seconds', CASE WHEN {_SECONDS} > 0 THEN round({_SECONDS}, 3)::VARCHAR ELSE '' END FROM v"""
)
def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with each segment of a valid video, a row each: its columns as strings, its place in the input and its length."""
    v = valid_videos(spread(table(spark, sf_dir, "videos").select("row_id", "transcript", *_ABOUT)))
    return v.select("row_id", F.explode(metadata(v, "row_id")).alias("name", "value"))


@query("SELECT row_id, source_url, creator_label FROM videos WHERE NOT EXISTS (SELECT 1 FROM segments_review s WHERE s.video_url = source_url)")
def skip_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos without segments so far."""
    return unprocessed(table(spark, sf_dir, "videos").select("row_id", "source_url", "creator_label"), table(spark, sf_dir, "segments_review").select("video_url"))


def _with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = F.transform("utterances", lambda u, i: F.struct(F.when(i % 5 != 2, u["start_ms"]).alias("start_ms"), F.when(i % 3 != 1, u["end_ms"]).alias("end_ms"), u["text"].alias("text")))
    return timed_documents(spark, sf_dir).withColumn("utterances", holes)


@query(
    f"""WITH RECURSIVE {_U}, h AS (SELECT doc_id, pos, CASE WHEN pos % 5 <> 2 THEN start_ms END AS s, CASE WHEN pos % 3 <> 1 THEN end_ms END AS e, text FROM u),
n AS (SELECT *, (SELECT k.s FROM h k WHERE k.doc_id = h.doc_id AND k.pos > h.pos AND k.s IS NOT NULL ORDER BY k.pos LIMIT 1) AS nxt FROM h),
f AS (SELECT doc_id, pos, coalesce(s, 0) AS start_ms, coalesce(e, CASE WHEN nxt <> 0 AND nxt > coalesce(s, 0) THEN nxt ELSE coalesce(s, 0) + 1000 END) AS end_ms, greatest(0, coalesce(e, CASE WHEN nxt <> 0 AND nxt > coalesce(s, 0) THEN nxt ELSE coalesce(s, 0) + 1000 END)) AS reached, text FROM n WHERE pos = 0
UNION ALL SELECT n.doc_id, n.pos, coalesce(n.s, f.reached), coalesce(n.e, CASE WHEN n.nxt <> 0 AND n.nxt > coalesce(n.s, f.reached) THEN n.nxt ELSE coalesce(n.s, f.reached) + 1000 END), greatest(f.reached, coalesce(n.e, CASE WHEN n.nxt <> 0 AND n.nxt > coalesce(n.s, f.reached) THEN n.nxt ELSE coalesce(n.s, f.reached) + 1000 END)), n.text FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, pos) - 1 AS pos, start_ms, greatest(end_ms, start_ms) AS end_ms, text FROM f"""
)
def fill_missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances some of whose starts and ends are missing, completed from left to right."""
    return _rows(_with_holes(spark, sf_dir).select("doc_id", seq.fill_times(F.col("utterances")).alias("utterances")))


@query(f"""WITH {_U}, h AS (SELECT doc_id, pos, start_ms, CASE WHEN pos % 3 <> 1 THEN end_ms END AS e, text FROM u) SELECT doc_id, pos, start_ms, greatest(coalesce(e, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, pos), start_ms + 1000), start_ms) AS end_ms, text FROM h""")
def utterance_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing ends taken from the next start."""
    holes = F.transform("utterances", lambda u, i: F.struct(u["start_ms"].alias("start_ms"), F.when(i % 3 != 1, u["end_ms"]).alias("end_ms"), u["text"].alias("text")))
    return _rows(timed_documents(spark, sf_dir).select("doc_id", seq.complete_ends(holes).alias("utterances")))


@query(
    f"""WITH RECURSIVE {_U}, g AS (SELECT doc_id, pos, start_ms AS anchor FROM u WHERE pos = 0 UNION ALL SELECT u.doc_id, u.pos, CASE WHEN u.start_ms >= g.anchor + 8000 THEN u.start_ms ELSE g.anchor END FROM g JOIN u ON u.doc_id = g.doc_id AND u.pos = g.pos + 1)
SELECT doc_id, anchor AS start_ms, max_by(end_ms, pos) AS end_ms, string_agg(text, ' ' ORDER BY pos) AS text FROM g JOIN u USING (doc_id, pos) GROUP BY doc_id, anchor"""
)
def coalesce_8s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances joined to blocks of eight seconds from their first start."""
    return _rows(timed_documents(spark, sf_dir).select("doc_id", seq.coalesce_windows(F.col("utterances"), 8000).alias("utterances"))).drop("pos")


_SPANS = f"""c AS (SELECT doc_id, t0, t1, unnest(range(CASE WHEN t1 - t0 <= 0 THEN 0 WHEN t1 - t0 <= {CHUNK_MS} THEN 1 ELSE (1 + ceil((t1 - t0 - {CHUNK_MS}) / {CHUNK_MS - OVERLAP_MS}::DOUBLE))::BIGINT END)) AS k FROM x),
spans AS (SELECT doc_id, k, t0, t1, t0 + k * {CHUNK_MS - OVERLAP_MS} AS a, least(t1, t0 + k * {CHUNK_MS - OVERLAP_MS} + {CHUNK_MS}) AS b, max(k) OVER (PARTITION BY doc_id) AS last FROM c),
owned AS (SELECT *, CASE WHEN k = last THEN b ELSE b - {OVERLAP_MS} END AS own_b FROM spans)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seq.settled(timed_documents(spark, sf_dir), spans=seq.chunk_spans(F.col("t0"), F.col("t1"), CHUNK_MS, OVERLAP_MS))
    return d.withColumn("own", seq.owned(F.col("spans"), OVERLAP_MS))


@query(f"WITH {_U}, {_SPANS} SELECT doc_id, k AS pos, a, b FROM spans")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of each document."""
    return _rows(_spans(spark, sf_dir), "spans")


@query(f"WITH {_U}, {_SPANS} SELECT doc_id, k AS pos, a, own_b AS b FROM owned")
def owned_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk speaks for."""
    return _rows(_spans(spark, sf_dir), "own")


def _reply(utterances: Column) -> Column:
    return F.transform(F.filter(utterances, lambda u, i: i % 3 == 0), lambda u: F.struct((u["start_ms"] - 200).alias("a"), (u["end_ms"] + 2500).alias("b")))


def _reconciled(key: str, source: str, lo: str, hi: str) -> str:
    return f"""i AS (SELECT {key}, greatest(a, {lo}) AS a, least(b, {hi}) AS b, {lo} AS lo, {hi} AS hi FROM {source}), p AS (SELECT * FROM i WHERE b > a),
r AS (SELECT *, greatest(lo, coalesce(max(b) OVER (PARTITION BY {key} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS cur FROM p), k2 AS (SELECT {key}, greatest(a, cur) AS a, b, cur, hi FROM r WHERE b > greatest(a, cur)),
tiles AS (SELECT {key}, a, b FROM k2 UNION ALL SELECT {key}, cur, a FROM k2 WHERE a > cur UNION ALL SELECT {key}, max(b), max(hi) FROM k2 GROUP BY {key} HAVING max(b) < max(hi) UNION ALL SELECT {key}, lo, hi FROM (SELECT DISTINCT {key}, {lo} AS lo, {hi} AS hi FROM {source}) z WHERE NOT EXISTS (SELECT 1 FROM k2 WHERE {" AND ".join(f"k2.{c} = z.{c}" for c in key.split(", "))}))"""


_REPLY = "reply AS (SELECT doc_id, start_ms - 200 AS a, end_ms + 2500 AS b, t0, t1 FROM u JOIN x USING (doc_id) WHERE pos % 3 = 0)"


@query(f"WITH {_U}, {_REPLY}, {_reconciled('doc_id', 'reply', 't0', 't1')} SELECT doc_id, a, b FROM tiles")
def reconcile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that overlap and leave gaps, made a tiling."""
    return _rows(timed_documents(spark, sf_dir).select("doc_id", seq.reconcile(_reply(F.col("utterances")), F.col("t0"), F.col("t1")).alias("r")), "r").drop("pos")


_MERGED = f"""{_U}, {_SPANS}, replies AS (SELECT o.doc_id, o.k, o.a AS lo0, o.b AS hi0, u.start_ms - 200 AS a, u.end_ms + 2500 AS b FROM owned o JOIN u USING (doc_id) WHERE u.pos % 3 = 0), {_reconciled('doc_id, k', 'replies', 'lo0', 'hi0')},
mine AS (SELECT t.doc_id, t.k, greatest(t.a, o.a) AS a, least(t.b, o.own_b) AS b FROM tiles t JOIN owned o ON o.doc_id = t.doc_id AND o.k = t.k), m AS (SELECT * FROM mine WHERE b > a),
f AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(k) OVER w <> k THEN 0 ELSE 1 END AS brk FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY a, b)), g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM f),
merged AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, island)"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spans(spark, sf_dir)
    replies = F.array_repeat(_reply(F.col("utterances")), F.size("spans"))
    return seq.settled(d, bounds=seq.merge_chunks(seq.reconcile_chunks(replies, F.col("spans"), F.col("own"))))


@query(f"WITH {_MERGED} SELECT doc_id, a, b FROM merged")
def merge_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all chunks as one sequence."""
    return _rows(_bounds(spark, sf_dir), "bounds").drop("pos")


@query(f"WITH {_MERGED}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM merged), odd AS (SELECT k.doc_id, k.a, k.b, x.t0, x.t1 FROM kept k JOIN x USING (doc_id) WHERE n % 2 = 1), l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), t0) AS prev FROM odd) SELECT doc_id, a, b FROM l UNION ALL SELECT doc_id, prev, a FROM l WHERE a > prev UNION ALL SELECT doc_id, max(b), max(t1) FROM l GROUP BY doc_id HAVING max(b) < max(t1)")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second bound taken away and the holes filled."""
    some = seq.settled(_bounds(spark, sf_dir), bounds=F.filter("bounds", lambda x, i: i % 2 == 0))
    return _rows(some.select("doc_id", seq.fill_gaps(F.col("bounds"), F.col("t0"), F.col("t1")).alias("r")), "r").drop("pos")


@query(
    f"WITH {_MERGED}, t AS (SELECT m.doc_id, m.a, m.b, string_agg(u.text, ' ' ORDER BY u.pos) AS text FROM merged m JOIN u ON u.doc_id = m.doc_id AND u.end_ms > m.a AND u.start_ms < m.b GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS segment_id, a, b, trim(text) AS text FROM t WHERE trim(text) <> ''"
)
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each segment, by overlap, numbered within its document."""
    d = _bounds(spark, sf_dir).select("doc_id", F.explode(seq.segments(F.col("utterances"), F.col("bounds"))).alias("s"))
    return d.select("doc_id", "s.*")


@query(f"WITH {_U}, {_SPANS} SELECT s.doc_id, s.k, s.a, s.b, u.pos, u.start_ms, u.end_ms FROM spans s JOIN u ON u.doc_id = s.doc_id AND u.end_ms > s.a AND u.start_ms < s.b")
def overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap join on exploded tables."""
    d = _spans(spark, sf_dir)
    u = _rows(d).drop("text")
    s = _rows(d, "spans").withColumnRenamed("pos", "k")
    return overlap_join(u, s, "doc_id")


@query("SELECT doc_id, (doc_id - 1) // 20 AS batch_id, (doc_id - 1) % 20 AS idx FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twenty by position."""
    return cl.batch_columns(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") - 1).alias("pos"))).select("doc_id", "batch_id", "idx")


@query("SELECT (doc_id - 1) // 20 AS batch_id, sha256(concat_ws('|', 'model', 'prompt', string_agg(concat_ws('::', coalesce(creator_label, ''), doc_id::VARCHAR, sha256(coalesce(text, ''))), '|' ORDER BY doc_id))) AS key FROM documents GROUP BY 1")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of the batches."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), F.col("creator_label").alias("video_url"), F.col("text").alias("segment_transcript"), (F.col("doc_id") - 1).alias("pos"))
    return cl.batch_keys(cl.batch_columns(d), "model", "prompt")


def _codebook(spark: SparkSession, sf_dir: str, name: str = "codebook") -> DataFrame:
    # Fixed tables of a few rows; their order is that of label and definition.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("label").asc_nulls_first(), F.col("definition").asc_nulls_first())
    return table(spark, sf_dir, name).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


_ORDERED = "row_number() OVER (ORDER BY label NULLS FIRST, definition NULLS FIRST) - 1 AS pos"


@query(
    f"""WITH s AS (SELECT coalesce(codebook_label, '{OTHER}') AS label, segment_duration_seconds AS seconds, left({_strip("segment_transcript")}, 300) AS sample, row_number() OVER (PARTITION BY coalesce(codebook_label, '{OTHER}') ORDER BY video_url, segment_id, labeled_at, segment_transcript) AS r FROM labeled_segments),
g AS (SELECT label, count(*) AS n, round(sum(seconds::DECIMAL(18,3)), 1)::DOUBLE AS t, max(CASE WHEN r = 1 THEN sample END) AS s1, max(CASE WHEN r = 2 THEN sample END) AS s2, max(CASE WHEN r = 3 THEN sample END) AS s3 FROM s GROUP BY label)
SELECT c.label, coalesce(n, 0) AS n_segments, coalesce(t, 0) AS total_runtime_seconds, coalesce(s1, '') AS sample_1, coalesce(s2, '') AS sample_2, coalesce(s3, '') AS sample_3 FROM codebook c LEFT JOIN g ON g.label = c.label"""
)
def codebook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, runtime and samples by label, with the labels that have none."""
    s = table(spark, sf_dir, "labeled_segments").withColumn("pos", F.struct("video_url", "segment_id", "labeled_at", "segment_transcript"))
    return label_summary(s, _codebook(spark, sf_dir), OTHER)


_SENTIMENT = lambda word: f"CASE WHEN contains(lower(segment_transcript), '{word}') THEN CASE segment_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'odd' END ELSE 'not_discussed' END"
_TOPIC_WORDS = ("wages", "rents", "prices", "bank", "tariffs", "bonds")
_PICK = lambda n: f"max(CASE WHEN r = {n} THEN sample END)"


@query(
    f"""WITH e AS (SELECT * FROM labeled_segments WHERE codebook_label = 'Economy'), q AS ({" UNION ALL ".join(f"SELECT {i} AS pos, '{w}' AS slug, {_SENTIMENT(w)} AS sentiment, * FROM e" for i, w in enumerate(_TOPIC_WORDS))}),
d AS (SELECT *, left({_strip("segment_transcript")}, 300) AS sample, row_number() OVER (PARTITION BY slug ORDER BY video_url, segment_id, labeled_at, segment_transcript) AS r FROM q WHERE sentiment IN ('positive', 'negative', 'neutral')),
g AS (SELECT slug, count(*) AS n, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS m, count(*) FILTER (sentiment = 'neutral') AS z, round(sum(coalesce(segment_duration_seconds, 0)::DECIMAL(18,3)), 1)::DOUBLE AS t, {_PICK(1)} AS s1, {_PICK(2)} AS s2, {_PICK(3)} AS s3 FROM d GROUP BY slug)
SELECT w.slug AS subtopic, coalesce(n, 0) AS n_segments_discussed, CASE WHEN (SELECT count(*) FROM e) > 0 THEN round(100 * coalesce(n, 0) / (SELECT count(*) FROM e), 2) ELSE 0 END AS pct_of_filtered, coalesce(p, 0) AS n_positive, coalesce(m, 0) AS n_negative, coalesce(z, 0) AS n_neutral, coalesce(t, 0) AS total_runtime_seconds_discussed, coalesce(s1, '') AS sample_1, coalesce(s2, '') AS sample_2, coalesce(s3, '') AS sample_3
FROM (SELECT unnest([{", ".join(f"'{w}'" for w in _TOPIC_WORDS)}]) AS slug) w LEFT JOIN g ON g.slug = w.slug"""
)
def subtopics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiments by subtopic over the segments of one topic; a sentiment outside the list doesn't count."""
    s = table(spark, sf_dir, "labeled_segments").filter("codebook_label = 'Economy'").withColumn("pos", F.struct("video_url", "segment_id", "labeled_at", "segment_transcript"))
    turn = F.element_at(F.array(*[F.lit(x) for x in ("positive", "negative", "neutral", "odd")]), F.pmod("segment_id", F.lit(4)).cast("int") + 1)
    said = lambda w: F.when(F.lower("segment_transcript").contains(w), turn).otherwise("not_discussed")
    s = s.withColumn("sentiments", F.create_map(*[x for w in _TOPIC_WORDS for x in (F.lit(w), said(w))]))
    return subtopic_summary(s, spark.createDataFrame([(i, w) for i, w in enumerate(_TOPIC_WORDS)], "pos long, slug string"))


_SLUG = lambda c: rf"regexp_replace(regexp_replace(lower({_strip(c)}), '[^a-z0-9]+', '_', 'g'), '^_+|_+\z', '', 'g')"


@query(f"WITH s AS (SELECT {_SLUG('label')} AS slug, definition, {_ORDERED} FROM subtopics) SELECT slug, min(pos) AS pos, max_by(coalesce(definition, ''), pos) AS definition FROM s WHERE slug <> '' GROUP BY slug")
def subtopic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtopics whose slugs collide, as one."""
    return slugged(_codebook(spark, sf_dir, "subtopics")).select("slug", "pos", "definition")


_SPELLINGS = "l AS (SELECT codebook_label AS label, NULL::VARCHAR AS definition, min(row_no) AS pos FROM (SELECT codebook_label, row_number() OVER (ORDER BY codebook_label) - 1 AS row_no FROM (SELECT DISTINCT codebook_label FROM labeled_segments WHERE codebook_label IS NOT NULL)) GROUP BY 1)"


@query(f"WITH {_SPELLINGS}, k AS (SELECT pos, {_strip('label')} AS label, lower({_strip('label')}) AS key FROM l WHERE {_strip('label')} <> ''), f AS (SELECT key, min(pos) AS pos, min_by(label, pos) AS label FROM k GROUP BY key) SELECT key, pos, label FROM f UNION ALL SELECT lower('{OTHER}'), (SELECT coalesce(max(pos), -1) + 1 FROM f), '{OTHER}' WHERE NOT EXISTS (SELECT 1 FROM f WHERE key IN ('other / not listed', 'other', 'not listed', 'none', 'n/a'))")
def label_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels in use, those that differ in case only as one, with the label for the rest if there is none."""
    names = table(spark, sf_dir, "labeled_segments").filter("codebook_label is not null").select(F.col("codebook_label").alias("label")).distinct()
    # A row a spelling; what is ordered is the vocabulary, not the segments.
    pos = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("long")
    return with_other(first_spellings(names.withColumns({"pos": pos, "definition": F.lit(None).cast("string")}))).select("key", "pos", "label")


@query(f"WITH d AS (SELECT lower({_strip('label')}) AS key, CASE WHEN contains(label, 'o') THEN '' ELSE upper(definition) END AS definition FROM codebook WHERE length(label) > 5) SELECT c.label, CASE WHEN d.key IS NOT NULL THEN d.definition ELSE c.definition END AS definition FROM codebook c LEFT JOIN d ON d.key = lower({_strip('c.label')})")
def definition_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of another table, blank ones too, in place of the codebook's."""
    book = table(spark, sf_dir, "codebook").withColumn("key", label_key(F.col("label")))
    other = book.filter(F.length("label") > 5).select("key", F.when(F.col("label").contains("o"), "").otherwise(F.upper("definition")).alias("definition"))
    return override(book, other).select("label", "definition")


@query(f"SELECT c.label, length(c.definition) AS n_chars, count(l.video_url) AS n_segments FROM labeled_segments l JOIN codebook c ON lower({_strip('c.label')}) = lower({_strip('l.codebook_label')}) GROUP BY ALL")
def labels_without_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined with the codebook without regard to case and padding, counted before they are joined."""
    n = table(spark, sf_dir, "labeled_segments").groupBy(label_key(F.col("codebook_label")).alias("key")).agg(F.count("video_url").alias("n"))
    book = table(spark, sf_dir, "codebook").withColumn("key", label_key(F.col("label")))
    return n.join(book, "key").groupBy("label", F.length("definition").alias("n_chars")).agg(F.sum("n").alias("n_segments"))


@query(f"SELECT s.video_url, s.segment_id, coalesce(l.label, '{OTHER}') AS codebook_label FROM (SELECT DISTINCT video_url, segment_id FROM segments_review) s LEFT JOIN (SELECT video_url, segment_id, min(codebook_label) AS label FROM labeled_segments GROUP BY ALL) l ON l.video_url = s.video_url AND l.segment_id = s.segment_id")
def labels_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its recorded label, the fallback where there is none."""
    keys = ["video_url", "segment_id"]
    replies = table(spark, sf_dir, "labeled_segments").groupBy(*keys).agg(F.min("codebook_label").alias("codebook_label"))
    return cl.fill_missing(table(spark, sf_dir, "segments_review").select(*keys).distinct(), replies, keys, "codebook_label", OTHER)


@query(f"SELECT video_url, segment_id, left(segment_transcript, 300) AS preview, left(segment_transcript, 700) AS prompt, regexp_replace({_strip(f'segment_transcript')}, '{_WS}+', ' ', 'g') AS flat, sha256(segment_transcript) AS hash FROM labeled_segments")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with previews, prompt texts, spacing made even, and hashes."""
    t = F.col("segment_transcript")
    return spread(table(spark, sf_dir, "labeled_segments").select("video_url", "segment_id", "segment_transcript")).select("video_url", "segment_id", preview(t).alias("preview"), cl.prompt_text(t).alias("prompt"), collapse(t).alias("flat"), F.sha2(t, 256).alias("hash"))


@query("SELECT DISTINCT label, " + _SLUG("label") + " AS slug FROM (SELECT label FROM codebook UNION ALL SELECT label FROM subtopics UNION ALL SELECT creator_label FROM videos) WHERE label IS NOT NULL")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of labels and creators."""
    names = table(spark, sf_dir, "codebook").select("label").union(table(spark, sf_dir, "subtopics").select("label")).union(table(spark, sf_dir, "videos").select("creator_label"))
    return names.filter("label is not null").distinct().select("label", slug(F.col("label")).alias("slug"))


# What DuckDB needs to read records and words: times of a JSON value, spaces made even, entities.
_PART = lambda v, i: f"regexp_extract({v}, '^{_CLOCK_RE}$', {i})"
_CLOCK = lambda v: f"CASE WHEN regexp_full_match({v}, '{_CLOCK_RE}') THEN ((coalesce(try_cast({_PART(v, 1)} AS BIGINT), 0) * 60 + try_cast({_PART(v, 2)} AS BIGINT)) * 60 + try_cast({_PART(v, 3)} AS BIGINT)) * 1000 + try_cast(rpad(left({_PART(v, 4)}, 3), 3, '0') AS BIGINT) END"
_CLOCK_RE = r"(?:(\d+):)?(\d+):(\d+)(?:\.(\d*))?"
_TIME = lambda name, unit: (
    f"""CASE WHEN json_type(r, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc((r->>'$.{name}')::DOUBLE * {unit})::BIGINT WHEN json_type(r, '$.{name}') = 'VARCHAR' THEN CASE WHEN contains(r->>'$.{name}', ':') THEN {_CLOCK(f"replace(trim(r->>'$.{name}'), ',', '.')")}
WHEN trim(r->>'$.{name}') LIKE '%ms' THEN trunc(try_cast(left(trim(r->>'$.{name}'), -2) AS DOUBLE))::BIGINT WHEN trim(r->>'$.{name}') LIKE '%s' THEN trunc(try_cast(left(trim(r->>'$.{name}'), -1) AS DOUBLE) * 1000)::BIGINT ELSE trunc(try_cast(trim(r->>'$.{name}') AS DOUBLE) * {unit})::BIGINT END END"""
)
_FIELD = lambda which: "coalesce(" + ", ".join(_TIME(name, unit) for names, unit in zip(TIME_FIELDS[which], (1, 1000)) for name in names) + ")"
_ENTITIES = lambda v: f"replace(replace(replace(replace(replace(replace(replace({v}, '&nbsp;', ' '), '&#x27;', ''''), '&#39;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_FLAT = lambda v: _strip(f"regexp_replace({_ENTITIES(v)}, '{_WS}+', ' ', 'g')")


@query(
    f"""WITH j AS (SELECT row_id, unnest(json_extract({_strip("transcript")}, '$[*]')) AS r, generate_subscripts(json_extract({_strip("transcript")}, '$[*]'), 1) - 1 AS pos FROM videos WHERE starts_with({_strip("transcript")}, '[') AND json_valid({_strip("transcript")})),
t AS (SELECT row_id, pos, {_FIELD("start")} AS s, {_FIELD("end")} AS e, {_FIELD("length")} AS n, CASE WHEN json_type(r) = 'OBJECT' THEN coalesce({", ".join(f"nullif({_FLAT(f"r->>'$.{k}'")}, '')" for k in TEXT_FIELDS)}, '') ELSE {_FLAT("r->>'$'")} END AS text FROM j)
SELECT row_id, pos, s AS start_ms, coalesce(e, CASE WHEN n IS NOT NULL THEN s + greatest(1, n) END) AS end_ms, text FROM t WHERE text <> ''"""
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of JSON transcripts with their times as far as given, in whatever fields and units."""

    def fn(_: None, ids: list, texts: list) -> list:
        items = [(i, k, a, b, t) for i, x in zip(ids, texts) for k, (a, b, t) in enumerate(record_items(x.strip())) if t]
        return [list(c) for c in zip(*items)] or [[], [], [], [], []]

    rows = spread(table(spark, sf_dir, "videos").select("row_id", "transcript")).filter(F.col("transcript").contains("["))
    return map_rows(rows, "row_id long, pos int, start_ms long, end_ms long, text string", fn)


_WORD = r"<(\d{1,2}:\d{2}:\d{2}\.\d+)>(?:<c>)?([^<]*)(?:</c>)?"


@query(
    f"""WITH RECURSIVE v AS (SELECT row_id, coalesce(CASE WHEN abs(try_cast(trim(duration_seconds) AS DOUBLE)) <= 1e9 THEN try_cast(trim(duration_seconds) AS DOUBLE) END, 0) AS seconds, regexp_extract_all(transcript, '{_WORD}', 1) AS ats, regexp_extract_all(transcript, '{_WORD}', 2) AS raws FROM videos WHERE regexp_matches(transcript, '{_WORD}')),
w AS (SELECT row_id, seconds, unnest(ats) AS raw_at, {_strip(_ENTITIES("unnest(raws)"))} AS word, generate_subscripts(ats, 1) AS k FROM v),
d AS (SELECT row_id, seconds, {_CLOCK("raw_at")} AS ms, word, min(k) AS k FROM w WHERE word <> '' GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k) AS n FROM d),
g AS (SELECT row_id, n, ms AS anchor FROM o WHERE n = 1 UNION ALL SELECT o.row_id, o.n, CASE WHEN o.ms - g.anchor >= 5000 THEN o.ms ELSE g.anchor END FROM g JOIN o ON o.row_id = g.row_id AND o.n = g.n + 1),
b AS (SELECT o.*, g.anchor, CASE WHEN lag(g.anchor) OVER p IS DISTINCT FROM g.anchor THEN 1 ELSE 0 END AS fresh, last_value(o.ms) OVER (PARTITION BY o.row_id ORDER BY o.n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM o JOIN g ON g.row_id = o.row_id AND g.n = o.n WINDOW p AS (PARTITION BY o.row_id ORDER BY o.n)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY row_id ORDER BY n) AS block FROM b),
s AS (SELECT row_id, block, min(anchor) AS start_ms, greatest(trunc(max(seconds) * 1000)::BIGINT, max(latest) + 1000) AS last, {_strip("regexp_replace(string_agg(word, ' ' ORDER BY n), '" + _WS + "+', ' ', 'g')")} AS text FROM i GROUP BY row_id, block)
SELECT row_id, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER (PARTITION BY row_id ORDER BY block), last)) AS end_ms, text FROM s"""
)
def vtt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions timed word by word, in groups of five seconds."""

    def fn(_: None, ids: list, texts: list, seconds: list) -> list:
        items = [(i, *u) for i, x, s in zip(ids, texts, seconds) for u in from_word_tags(x.strip(), s or 0.0)]
        return [list(c) for c in zip(*items)] or [[], [], [], []]

    videos = spread(table(spark, sf_dir, "videos").select("row_id", "transcript", "duration_seconds")).filter(F.col("transcript").contains("<"))
    return map_rows(videos.select("row_id", "transcript", seconds_of(videos, "duration_seconds").alias("seconds")), "row_id long, start_ms long, end_ms long, text string", fn)


_UNSHOWN = lambda v: "regexp_replace(" * (len(UNSHOWN) + 1) + v + ", '(?s)<!--.*?-->', ' ', 'g')" + "".join(rf", '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')" for tag in sorted(UNSHOWN))


@query(rf"SELECT row_id, {_FLAT("regexp_replace(" + _UNSHOWN("transcript") + ", '<[^>]*>', ' ', 'g')")} AS text FROM videos WHERE regexp_matches(transcript, '^\s*<[a-zA-Z!]')")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages among the transcripts show."""
    pages = spread(table(spark, sf_dir, "videos").select("row_id", "transcript")).filter(F.col("transcript").rlike(r"^\s*<[a-zA-Z!]")).select("row_id", "transcript")
    return map_rows(pages, "row_id long, text string", lambda _, ids, texts: [ids, [page_text(t) for t in texts]])


@query(f"WITH l AS (SELECT label, definition, {_ORDERED} FROM (SELECT label, definition FROM subtopics UNION ALL SELECT upper(label), definition || '!' FROM subtopics UNION ALL SELECT label, definition FROM codebook)), k AS (SELECT pos, {_strip('label')} AS label, lower({_strip('label')}) AS key, nullif({_strip('definition')}, '') AS definition FROM l WHERE {_strip('label')} <> '') SELECT key, min_by(label, pos) AS label, min_by(definition, pos) FILTER (definition IS NOT NULL) AS definition FROM k GROUP BY key")
def first_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that recur in other cases, with the first spelling and the first definition that isn't blank."""
    both = lambda name: table(spark, sf_dir, name).select("label", "definition")
    rows = both("subtopics").union(both("subtopics").select(F.upper("label"), F.concat("definition", F.lit("!")))).union(both("codebook"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("label").asc_nulls_first(), F.col("definition").asc_nulls_first())
    return first_spellings(rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))).select("key", "label", "definition")


@query("SELECT video_url, segment_id, title, creator_label, upload_date, timecode_in, timecode_out, segment_duration_seconds, topic, left(segment_transcript, 300) AS segment_transcript_preview, segment_transcript FROM segments_review")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the columns of the review file."""
    segments = spread(table(spark, sf_dir, "segments_review")).drop("segment_transcript_preview").withColumn("more", F.lit(1))
    return files.review_rows(segments)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT row_id::VARCHAR AS row_id, nullif(source_url, '') AS source_url, nullif(transcript, '') AS transcript, nullif(title, '') AS title, nullif(creator_label, '') AS creator_label, nullif(duration_seconds, '') AS duration_seconds FROM videos")
def videos_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos written to CSV and read back; an empty field is read as null."""
    path = _folder(spark)
    files.write_csv(spread(table(spark, sf_dir, "videos").select("row_id", "source_url", "transcript", "title", "creator_label", "duration_seconds")), path)
    return read_csv(spark, path)


@query(f"SELECT {_strip('label')} AS label, nullif({_strip('definition')}, '') AS definition FROM codebook WHERE coalesce({_strip('label')}, '') <> ''")
def codebook_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codebook written to a file and read as one."""
    path = _folder(spark) + ".csv"
    files.write_csv(table(spark, sf_dir, "codebook"), path, single=True)
    return read_labels(spark, path).select("label", "definition")


@query("SELECT DISTINCT video_url FROM segments_review WHERE video_url IS NOT NULL AND segment_id % 2 = 0")
def processed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in two files of segments that earlier runs wrote."""
    paths = [_folder(spark) + ".json" for _ in range(2)]
    for k, path in enumerate(paths):
        files.write_json_array(spread(table(spark, sf_dir, "segments_review")).filter(F.col("segment_id") % 4 == 2 * k), path)
    return processed_urls(spark, paths)


@query(f"SELECT video_url, segment_id, 'cached' AS status FROM segments_review WHERE coalesce({_strip('video_url')}, '') <> '' AND coalesce({_strip('segment_transcript')}, '') <> ''")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments classified twice; the second time every answer comes from the cache."""
    segments = with_position(valid_segments(spread(table(spark, sf_dir, "segments_review"))).select("video_url", "segment_id", "segment_transcript"))
    book = [(r.label, r.definition) for r in _codebook(spark, sf_dir).orderBy("pos").limit(pipelines.MOST_LABELS).collect()]
    cache = cl.AnswerCache(spark, _folder(spark))
    ask = lambda: cl.classify(segments, Heuristic(), cl.label_prompt(book, OTHER), cl.label_schema([x for x, _ in book]), cache)
    ask()
    return ask().select("video_url", "segment_id", "status")


_TIMING_TAGS = r"<\d{1,2}:\d{2}:\d{2}\.\d+>|</?c>"
_SHOWN = rf"CASE WHEN starts_with({_strip('transcript')}, '<') THEN regexp_replace({_UNSHOWN('transcript')}, '<[^>]*>', ' ', 'g') ELSE regexp_replace(transcript, '{_TIMING_TAGS}', ' ', 'g') END"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({_strip(rf"regexp_replace(regexp_replace(CASE WHEN starts_with({_strip('transcript')}, '<') THEN {_ENTITIES('shown')} ELSE shown END, '{_TIMING_TAGS}', ' ', 'g'), '{_WS}+', ' ', 'g')")}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(
    rf"""WITH v AS (SELECT row_id, transcript, {_SHOWN} AS shown, coalesce(CASE WHEN abs(try_cast(trim(duration_seconds) AS DOUBLE)) <= 1e9 THEN try_cast(trim(duration_seconds) AS DOUBLE) END, 0) AS seconds FROM videos
WHERE coalesce({_strip("transcript")}, '') <> '' AND NOT contains(transcript, '{NO_CAPTIONS}') AND NOT regexp_matches(transcript, '{_WORD}') AND NOT (starts_with({_strip("transcript")}, '[') AND json_valid({_strip("transcript")}) AND {_strip("transcript")} <> '[]')),
s AS (SELECT row_id, CASE WHEN starts_with({_strip("transcript")}, '<') THEN 'page' ELSE 'text' END AS form, {_SENTENCES} AS parts, seconds FROM v),
n AS (SELECT *, len(parts) AS n, greatest(trunc(seconds * 1000)::BIGINT, len(parts) * 1000) AS total FROM s WHERE len(parts) > 0),
u AS (SELECT row_id, form, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos, n, total, greatest(1, total // n) AS step FROM n)
SELECT row_id, form, pos, pos * step AS start_ms, CASE WHEN pos = n - 1 THEN total ELSE (pos + 1) * step END AS end_ms, text FROM u"""
)
def text_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of plain texts and of pages as utterances spread over the duration."""
    read = utterances(spread(table(spark, sf_dir, "videos").select("row_id", "transcript", "duration_seconds")), ["row_id"]).filter(F.col("form").isin("text", "page"))
    return read.select("row_id", "form", F.posexplode("utterances").alias("pos", "u")).select("row_id", "form", "pos", "u.*")


@query(f"SELECT video_url, segment_id, CASE WHEN codebook_label IN (SELECT label FROM codebook) THEN codebook_label ELSE '{OTHER}' END AS codebook_label FROM labeled_segments")
def labels_from_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read off recorded answers; what is missing or not in the codebook becomes the fallback."""
    names = [r.label for r in _codebook(spark, sf_dir).orderBy("pos").limit(pipelines.MOST_LABELS).collect()]
    answered = table(spark, sf_dir, "labeled_segments").select("video_url", "segment_id", F.to_json(F.struct(F.col("codebook_label").alias("label"))).alias("answer"))
    return cl.with_labels(answered, names, OTHER)


@query("SELECT video_url, segment_id, CASE WHEN segment_id % 3 = 0 THEN 'positive' ELSE 'not_discussed' END AS wages, CASE WHEN segment_id % 2 = 0 THEN 'neutral' ELSE 'not_discussed' END AS rents FROM labeled_segments")
def sentiments_from_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiments read off recorded answers, in which some are missing, null or no sentiment."""
    wages = F.when(F.col("segment_id") % 3 == 0, "positive").when(F.col("segment_id") % 3 == 1, "odd")
    rents = F.when(F.col("segment_id") % 2 == 0, "neutral")
    answered = table(spark, sf_dir, "labeled_segments").select("video_url", "segment_id", F.to_json(F.struct(wages.alias("wages"), rents.alias("rents"), F.lit(1).alias("more"))).alias("answer"))
    return cl.with_sentiments(answered, ["wages", "rents"]).drop("sentiments")


@query()
def transcript_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transcripts in whatever form as timed utterances; no SQL, as forms are mixed within one transcript."""
    read = utterances(spread(table(spark, sf_dir, "videos").select("row_id", "transcript", "duration_seconds")), ["row_id"])
    return read.select("row_id", "form", F.posexplode("utterances").alias("pos", "u")).select("row_id", "form", "pos", "u.*")


@query()
def segmented_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All videos through the first stage, with the offline model; no SQL."""
    return pipelines.segment_videos(spread(table(spark, sf_dir, "videos")), Heuristic())


@query()
def labelled_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments through the second stage, with the offline model; no SQL."""
    segments = with_position(valid_segments(spread(table(spark, sf_dir, "segments_review"))).select("video_url", "segment_id", "segment_transcript", "segment_duration_seconds"))
    labelled, _ = pipelines.label_segments(segments, _codebook(spark, sf_dir), Heuristic())
    return labelled.select("video_url", "segment_id", "codebook_label", "status")

