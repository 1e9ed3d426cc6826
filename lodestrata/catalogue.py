"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import gf256, text
from lodestrata.operators import media, queue, records
from lodestrata.sources import armor, captures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _body():
    return F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))


def _entries(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.sha2(_body(), 256).alias("hash"))


@query("""
WITH e AS (SELECT user_id AS stream, event_id AS seq, concat_ws('|', event_type, user_id::VARCHAR, event_id::VARCHAR) AS body FROM events),
r AS (SELECT stream, seq, sha256(CASE WHEN seq % 11 = 0 THEN body || 'x' ELSE body END) AS got FROM e WHERE seq % 7 <> 0)
SELECT e.stream, count(*) FILTER (WHERE got = sha256(body)) AS verified, count(*) FILTER (WHERE got <> sha256(body)) AS mismatched, count(*) FILTER (WHERE got IS NULL) AS missing,
 count(*) FILTER (WHERE got <> sha256(body)) > 0 AS failed FROM e LEFT JOIN r ON e.stream = r.stream AND e.seq = r.seq GROUP BY e.stream""")
def verify_entries(spark, d):
    """Checkpoint entries against arrived records, some lost (every 7th) and some altered (every 11th)."""
    body = F.when(F.col("event_id") % 11 == 0, F.concat(_body(), F.lit("x"))).otherwise(_body())
    arrived = table(spark, d, "events").where(F.col("event_id") % 7 != 0).select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.sha2(body, 256).alias("hash"))
    return records.verify_entries(_entries(spark, d), arrived)


@query("""
WITH e AS (SELECT user_id AS stream, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 64 AS ck, event_id AS seq, unhex(sha256(concat_ws('|', event_type, user_id::VARCHAR, event_id::VARCHAR))) AS hash FROM events),
c AS (SELECT stream, ck, count(*) AS n, list(unhex(printf('%02x%02x%02x%02x00000000', seq % 256, seq // 256 % 256, seq // 65536 % 256, seq // 16777216 % 256)) || hash ORDER BY seq) AS parts FROM e GROUP BY stream, ck),
b AS (SELECT stream, ck, n, list_reduce(parts, lambda x, y: x || y) AS entries FROM c),
d AS (SELECT stream, sum(n)::BIGINT AS records, count(*) AS checkpoints, list(entries ORDER BY ck) AS l FROM b GROUP BY stream)
SELECT stream, records, checkpoints, hex(list_reduce(l, lambda p, x: unhex(sha256('sstr-v0 checkpoint'::BLOB || p || x)), unhex(sha256(encode('sstr-v0 genesis' || stream::VARCHAR))))).lower() AS digest FROM d""")
def hash_chain(spark, d):
    """The checkpoint chain of each stream, its records hashed as entries."""
    return records.hash_chain(_entries(spark, d))


@query("SELECT seq FROM (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events WHERE event_id % 3 <> 0))) AS seq) WHERE seq NOT IN (SELECT event_id FROM events WHERE event_id % 3 <> 0)")
def missing_seq(spark, d):
    return records.missing(table(spark, d, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("seq")))


@query("SELECT min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS size FROM (SELECT event_id AS seq, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE event_type IN ('error', 'view')) GROUP BY g")
def loss_islands(spark, d):
    return records.islands(table(spark, d, "events").where("event_type in ('error', 'view')").select(F.col("event_id").alias("seq")))


@query("""
WITH r AS (SELECT event_id AS id, event_id * 100 AS a, event_id * 100 + 100 AS b FROM events), x AS (SELECT event_id * 100 + event_id % 7 * 13 AS s, event_id * 100 + event_id % 7 * 13 + 150 AS e FROM events WHERE event_id % 50 = 0)
SELECT id, s, greatest(a, s) AS lo, least(b, e) AS hi FROM r JOIN x ON a < e AND s < b""")
def erasure_overlap(spark, d):
    ev = table(spark, d, "events")
    at = F.col("event_id") * 100
    start = at + F.col("event_id") % 7 * 13
    out = records.overlaps(ev.select(F.col("event_id").alias("id"), at.alias("a"), (at + 100).alias("b")), ev.where("event_id % 50 = 0").select(start.alias("s"), (start + 150).alias("e")))
    return out.select("id", "s", F.greatest("a", "s").alias("lo"), F.least("b", "e").alias("hi"))


_EXP, _LOG = gf256.EXP[:255].tolist(), gf256.LOG.tolist()


@query(f"""
SELECT grp, bit_xor(byte) AS p, bit_xor(CASE WHEN byte = 0 THEN 0 ELSE ({_EXP})[(({_LOG})[byte + 1] + place) % 255 + 1] END)::BIGINT AS q
FROM (SELECT event_id // 16 AS grp, event_id % 16 AS place, event_id * 7919 % 256 AS byte FROM events) GROUP BY grp""")
def parity_pq(spark, d):
    return records.parity_bytes(table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 256).alias("byte")))


@query("""
SELECT doc_id, place::INT AS place, length(chunk) AS size, sha256(chunk) AS sha FROM (
 SELECT doc_id, place, substring(text, place * 512 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 511) // 512)) AS place FROM documents))""")
def chunk_documents(spark, d):
    out = records.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 512)
    return out.select(F.col("id").alias("doc_id"), "place", F.length("chunk").cast("long").alias("size"), F.sha2("chunk", 256).alias("sha"))


@query("SELECT stream, seq, (t_us - first_value(t_us) OVER (PARTITION BY stream ORDER BY seq)) // 4 AS due_us FROM (SELECT user_id AS stream, event_id AS seq, epoch_us(ts) AS t_us FROM events)")
def pacing(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return records.pacing(ev, 4)


@query("""
SELECT stream, seq, "offset", body FROM (SELECT user_id % 50 AS stream, event_id // 3 AS seq, event_id AS "offset", CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS body,
 row_number() OVER (PARTITION BY user_id % 50, event_id // 3 ORDER BY event_id % 4 = 0, event_id) AS rn FROM events) WHERE rn = 1""")
def first_copies(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 50).alias("stream"), F.floor(F.col("event_id") / 3).alias("seq"), F.col("event_id").alias("offset"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("body"))
    return records.first_copies(ev)


_STATUS = {"click": "queued", "view": "retry", "purchase": "retry-cookies", "error": "failed", "signup": "done"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
_QUEUE_SQL = f"(SELECT user_id AS owner, 'u' || event_id AS url, {_CASE} AS status, event_id % 3 AS attempts, event_id % 7 = 0 AS cookie_tried, ts AS added, event_id AS pos FROM events)"
# written out, not from the operator's list
_ORD = "CASE status WHEN 'downloading' THEN 0 WHEN 'cookies' THEN 1 WHEN 'retry-cookies' THEN 2 WHEN 'checking' THEN 3 WHEN 'queued' THEN 4 WHEN 'retry' THEN 5 WHEN 'done' THEN 6 WHEN 'failed' THEN 7 WHEN 'rejected' THEN 8 ELSE 3 END"


def _queue(spark, d):
    return table(spark, d, "events").selectExpr("user_id as owner", "concat('u', event_id) as url", f"{_CASE} as status", "event_id % 3 as attempts", "event_id % 7 = 0 as cookie_tried", "ts as added", "event_id as pos")


@query(f"SELECT status, count(*) AS n, {_ORD} AS ord FROM {_QUEUE_SQL} GROUP BY status")
def status_counts(spark, d):
    return queue.status_counts(_queue(spark, d))


@query(f"SELECT owner, url, status, row_number() OVER (PARTITION BY owner ORDER BY {_ORD}, added, pos)::INT AS place FROM {_QUEUE_SQL}")
def queue_order(spark, d):
    return queue.listed(_queue(spark, d)).select("owner", "url", "status", "place")


@query(f"""
SELECT owner, url, pos, 'downloading' AS status, attempts + 1 AS attempts, cookie_tried OR status = 'retry-cookies' AS cookie_tried FROM (
 SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE status WHEN 'retry-cookies' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, pos) AS rn FROM {_QUEUE_SQL} WHERE status IN ('retry-cookies', 'queued', 'retry')) WHERE rn = 1""")
def claim_next(spark, d):
    return queue.claim(_queue(spark, d))


@query("SELECT 'u' || (event_id % 997) AS url, min(event_id) AS pos, 'checking' AS status FROM events WHERE event_id % 2 = 1 AND 'u' || (event_id % 997) NOT IN (SELECT 'u' || (event_id % 499) FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def enqueue_new(spark, d):
    ev = table(spark, d, "events")
    old = ev.where("event_id % 2 = 0").selectExpr("concat('u', event_id % 499) as url")
    return queue.enqueue(old, ev.where("event_id % 2 = 1").selectExpr("concat('u', event_id % 997) as url", "event_id as pos"))


@query(f"SELECT url, status FROM {_QUEUE_SQL} WHERE status NOT IN ('done', 'failed', 'rejected')")
def forget_clear(spark, d):
    return queue.cleared(_queue(spark, d)).select("url", "status")


@query(f"""
SELECT status, tried, titled, CASE WHEN status = 'downloading' THEN status WHEN status = 'cookies' OR tried THEN 'retry-cookies' WHEN NOT titled THEN 'checking' ELSE 'queued' END AS after
FROM (SELECT unnest({queue.ORDER}) AS status), (SELECT unnest([true, false]) AS tried), (SELECT unnest([true, false]) AS titled)""")
def retry_transition(spark, d):
    rows = [(s, a, b) for s in queue.ORDER for a in (True, False) for b in (True, False)]
    df = spark.createDataFrame(rows, "status string, tried boolean, titled boolean")
    return df.withColumn("after", queue.after_retry(F.col("status"), F.col("tried"), F.col("titled")))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND NOT tried THEN 'cookies' WHEN attempts < 2 AND NOT tried THEN 'retry' ELSE 'failed' END AS after
FROM (SELECT event_id, event_type, event_id % 5 = 0 AS tried, event_id % 4 AS attempts FROM events)""")
def failure_transition(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", queue.after_failure(F.col("event_type") == "error", F.col("event_id") % 5 == 0, F.col("event_id") % 4).alias("after"))


@query("(SELECT event_id AS id FROM events WHERE event_id % 37 = 0 EXCEPT SELECT event_id FROM events WHERE event_id % 5 = 0) UNION ALL (SELECT event_id FROM events WHERE event_id % 5 = 0 EXCEPT SELECT event_id FROM events WHERE event_id % 37 = 0)")
def membership_toggle(spark, d):
    ev = table(spark, d, "events")
    of = lambda step: ev.where(F.col("event_id") % step == 0).select(F.col("event_id").alias("id")).distinct()
    return queue.toggled(of(37), of(5))


@query("""
SELECT series, pos, value FROM (SELECT user_id AS series, event_id AS pos, value, lag(value) OVER w AS prev, lead(value) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE pos > 0 AND (prev IS NULL OR prev <= value) AND (next IS NULL OR next < value)""")
def replay_peaks(spark, d):
    return media.peaks(table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("pos"), "value"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, string_split(text, chr(10)) AS a FROM documents),
f AS (SELECT doc_id, line_no, regexp_replace(a[line_no + 1], '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM l),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM f WHERE line <> '')
SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, ' ' ORDER BY line_no)) AS sha FROM k WHERE before IS NULL OR before <> line GROUP BY doc_id""")
def caption_dedup(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return media.caption_text(lines).select(F.col("id").alias("doc_id"), "n_lines", F.sha2("text", 256).alias("sha"))


_PARENT = "CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN 'gone' ELSE conv_id || '-' || (turn // 2) END"


@query(f"""
WITH c AS (SELECT conv_id AS video, conv_id || '-' || turn AS id, {_PARENT} AS parent FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
j AS (SELECT c.*, p.id AS there, p.parent AS above FROM c LEFT JOIN c p ON c.video = p.video AND c.parent = p.id)
SELECT j.video, j.id, CASE WHEN j.there IS NULL THEN 'root' WHEN q.id IS NULL THEN 'reply' ELSE 'deeper' END AS kind FROM j LEFT JOIN c q ON j.video = q.video AND j.above = q.id""")
def thread(spark, d):
    """Every turn as a comment; a turn that a conversation has twice is one comment, a null turn is no comment's answer."""
    rows = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    return media.thread(rows.selectExpr("conv_id as video", "concat(conv_id, '-', turn) as id", "CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN 'gone' ELSE concat(conv_id, '-', turn div 2) END as parent"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS talk_sha256, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def ordered_agg(spark, d):
    """Whole conversations as one text each."""
    turn = F.struct("turn", "role", "text", F.concat("role", F.lit(": "), "text").alias("x"))
    talk = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["x"]), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(talk, 256).alias("talk_sha256"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS bare FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("bare"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, ' [\n\t]+', ' ', 'g'), '[\n\t]+ ', ' ', 'g'), '[\n\t]+', ' ', 'g'), ' ')) AS sha FROM documents")
def one_line(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.one_line(F.col("text")), 256).alias("sha"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS links FROM pages""")
def extract_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ").alias("links"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""
SELECT key, arg_max(value, weight * 1000 + line_no) AS value, arg_max(source, weight * 1000 + line_no) AS source FROM (VALUES
 ('FOLDER', '/a', 'defaults', 0, 1), ('FOLDER', '/b', 'media', 1, 1), ('FOLDER', '/c', 'media', 1, 2), ('OUTPUT', 'mp4', 'defaults', 0, 2), ('WARM', 'no', 'own', 2, 1), ('WARM', 'yes', 'media', 1, 9)) t(key, value, source, weight, line_no) GROUP BY key""")
def settings_in_force(spark, d):
    rows = [("FOLDER", "/a", "defaults", 0, 1), ("FOLDER", "/b", "media", 1, 1), ("FOLDER", "/c", "media", 1, 2), ("OUTPUT", "mp4", "defaults", 0, 2), ("WARM", "no", "own", 2, 1), ("WARM", "yes", "media", 1, 9)]
    return media.in_force(spark.createDataFrame(rows, "key string, value string, source string, weight int, line_no int"))


@query("SELECT source, line_no FROM (SELECT source, doc_id AS line_no, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 5")
def log_tail(spark, d):
    return media.tail(table(spark, d, "documents").select("source", F.col("doc_id").alias("line_no")), 5)


@query("""
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS secs,
 format('{:,}', n) AS thousands FROM (SELECT o_orderkey, o_orderkey % 9000 AS s, o_orderkey * 1237 AS n FROM orders)""")
def number_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.fmt_secs(F.col("o_orderkey") % 9000).alias("secs"), text.commas(F.col("o_orderkey") * 1237).alias("thousands"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 30) AS BIGINT) AS slot, min(event_id) AS event_id FROM events GROUP BY ALL")
def progress_buckets(spark, d):
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 30_000_000).cast("long")
    return table(spark, d, "events").groupBy("user_id", slot.alias("slot")).agg(F.min("event_id").alias("event_id"))


@query("SELECT outcome, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'done' END AS outcome, n_chars AS bytes FROM documents) GROUP BY outcome")
def export_tally(spark, d):
    outcome = F.when(F.col("doc_id") % 10 == 0, "failed").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("done")
    return table(spark, d, "documents").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


_CRC = "[" + ", ".join(str(x) for x in records.crc_table()) + "]"


@query(f"""
WITH p AS (SELECT doc_id, encode(text) AS b, unnest(range(0, octet_length(encode(text)), 45)) AS o FROM documents),
h AS (SELECT doc_id, 'S' || printf('%09x', o) || ':' || rtrim(replace(replace(base64(b[o + 1 : o + 45]), '+', '-'), '/', '_'), '=') AS head FROM p)
SELECT doc_id, head || ':' || printf('%08x', xor(list_reduce(list_transform(range(1, length(head) + 1), lambda i: ord(head[i])::BIGINT), lambda c, x: xor(c >> 8, ({_CRC})[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)) AS line FROM h""")
def armor_lines(spark, d):
    """Each text's bytes in pieces of 45, each an armor line at its offset in the text; an empty or null text has none."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(armor.pieces(F.col("text").cast("binary"))).alias("p"))
    return lines.select("doc_id", text.armor_line(F.col("p.offset"), F.col("p.bytes")).alias("line"))


@query("""
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.1f} MiB', n / 1048576.0::DOUBLE) ELSE format('{:.1f} GiB', n / 1073741824.0::DOUBLE) END AS shown
FROM (SELECT o_orderkey, o_orderkey * 997 AS n FROM orders)""")
def size_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.fmt_size(F.col("o_orderkey") * 997).alias("shown"))


@query("SELECT doc_id, CAST((strlen(text) + 65535) // 65536 AS BIGINT) AS records, sha256(text) AS sha FROM documents")
def capture_repair(spark, d):
    """Every text as a damaged capture, mended: the payload is the text again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return captures.survives(docs).withColumnRenamed("id", "doc_id")
