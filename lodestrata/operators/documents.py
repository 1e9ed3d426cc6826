"""Documents about a video: its notes, its discussion, its tag file, and what a capture's header tells of it.

`meta` is a row with a column for each field that is known (see FIELDS); a null or empty one is left out of the
document. Times are shown in the session's zone. Defined results: without a title the url stands for it; comments
whose parent isn't in the list are roots; repeated comments are printed each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import wrapping

# Fields of a video's information that the documents use, the counts among them with their names, and the fields about the file.
FIELDS = "webpage_url string, webpage_url_domain string, extractor_key string, license string, title string, uploader string, uploader_id string, uploader_url string, channel string, channel_id string, channel_url string, channel_follower_count double, duration double, timestamp double, upload_date string, description string, view_count double, like_count double, dislike_count double, repost_count double, comment_count double, tags array<string>, categories array<string>, language string, location string, chapters array<struct<start_time:double,end_time:double,title:string>>, heatmap array<struct<start_time:double,end_time:double,value:double>>, live_status string, availability string, age_limit double, media_type string, thumbnail string, resolution string, vcodec string, acodec string, fps double, subtitles map<string,string>"
COUNTS = [("Views", "view_count"), ("Likes", "like_count"), ("Downvotes", "dislike_count"), ("Reposts", "repost_count"), ("Replies", "comment_count"), ("Followers", "channel_follower_count")]
FORMAT_FIELDS = ["resolution", "vcodec", "acodec", "fps"]


def _told(x: Column) -> Column:
    return F.when(x != "", x)


def _row(name: str, value: Column) -> Column:
    """A line of the notes, null where there is nothing to say."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"  {name + ':':<11} "), value, F.lit("\n")))


def _section(title: Column, rows: list[Column]) -> Column:
    body = F.concat_ws("", *rows)
    return F.when(body != "", F.concat(title, body, F.lit("\n"))).otherwise(F.lit(""))


def author_of(m) -> Column:
    return F.coalesce(_told(m("uploader")), _told(m("channel")))


def where_of(m) -> Column:
    """Where it was posted, by the site's own field for that."""
    site = F.coalesce(m("extractor_key"), F.lit(""))
    other = F.when(F.coalesce(author_of(m), F.lit("unknown")) != m("channel"), _told(m("channel")))
    group = F.concat(F.lit("r/"), F.regexp_replace(_told(m("channel_id")), r"\A(?:r/)+", ""))
    handle = F.concat(F.lit("@"), F.ltrim(_told(m("uploader_id")), F.lit("@")))
    return F.when(site == "Reddit", group).when(site == "Twitter", handle).otherwise(other)


def most_replayed(heatmap: Column, duration: Column) -> Column:
    """The middles of up to three highest peaks, highest first, each a twentieth of the duration from those before; the opening is none."""
    points = F.filter(heatmap, lambda p: p["start_time"].isNotNull() & p["end_time"].isNotNull() & p["value"].isNotNull())
    last = F.size(points) - 1

    def is_peak(p: Column, i: Column) -> Column:
        left, right = F.get(points, i - 1), F.get(points, i + 1)
        return (p["start_time"] > 0) & ((i == 0) | (left["value"] <= p["value"])) & ((i == last) | (right["value"] < p["value"]))

    ranked = F.transform(F.filter(points, is_peak), lambda p, i: F.struct((-p["value"]).alias("v"), i.alias("i"), ((p["start_time"] + p["end_time"]) / 2).alias("t")))
    gap = F.coalesce(duration, F.lit(0.0)) / 20

    def taken(acc: Column, p: Column) -> Column:
        free = (F.size(acc) < 3) & F.forall(acc, lambda t: F.abs(t - p["t"]) >= gap)
        return F.when(free, F.concat(acc, F.array(p["t"]))).otherwise(acc)

    return F.aggregate(F.array_sort(ranked), F.array().cast("array<double>"), taken)


def notes_head(m, url: Column, now: Column, captions: Column | None = None, video: Column | None = None) -> Column:
    """Title, notes, counts, tags and chapters; m gives a field's Column by name."""
    title, author = F.coalesce(_told(m("title")), url), F.coalesce(author_of(m), F.lit("unknown"))
    live = F.when(m("live_status").isin("was_live", "post_live"), F.lit("recorded from a live stream")).when(m("live_status") == "is_live", F.lit("live while it was downloaded"))
    age = F.when(m("age_limit") != 0, F.concat(T.number_text(m("age_limit")), F.lit("+")))
    kinds = F.array_join(F.filter(m("categories"), lambda c: c != ""), ", ")
    handle = F.when((F.coalesce(m("extractor_key"), F.lit("")) != "Twitter") & F.startswith(m("uploader_id"), F.lit("@")), m("uploader_id"))
    film = F.lit("none downloaded") if video is None else F.coalesce(_told(video), F.lit("none downloaded"))
    rows = [
        _row("Title", title), _row("Author", author), _row("Handle", handle), _row("Where", where_of(m)), _row("Site", _told(m("webpage_url_domain"))),
        _row("URL", F.coalesce(_told(m("webpage_url")), url)), _row("Channel", F.coalesce(_told(m("channel_url")), _told(m("uploader_url")))),
        _row("Published", T.published(m("timestamp"), m("upload_date"))), _row("Downloaded", T.when(now)), _row("Duration", F.when(m("duration") != 0, T.fmt_secs(m("duration")))),
        _row("Language", _told(m("language"))), _row("Category", _told(kinds)), _row("Location", _told(m("location"))), _row("Live", live),
        _row("Kind", F.when(~m("media_type").isin("video", "livestream"), _told(m("media_type")))), _row("Visibility", F.when(m("availability") != "public", _told(m("availability")))),
        _row("Age limit", age), _row("License", F.coalesce(_told(m("license")), F.lit("not stated"))), _row("Video", film),
        _row("Format", T.format_line(m("resolution"), m("vcodec"), m("acodec"), m("fps"))), _row("Thumbnail", _told(m("thumbnail"))),
    ]
    if captions is not None:
        theirs = F.coalesce(F.map_contains_key(m("subtitles"), captions), F.lit(False))
        source = F.when(theirs, F.lit("written by the uploader")).otherwise(F.lit("automatic: YouTube's speech recognition, not verbatim"))
        langs = F.filter(F.map_keys(m("subtitles")), lambda k: k != "live_chat")
        more = (F.size(langs) > 1) | (F.size(langs) == 1) & (F.get(langs, F.lit(0)) != captions)
        rows += [_row("Captions", F.concat(captions, F.lit(", "), source)), _row("Subtitles", F.when(more, F.concat(F.array_join(langs, ", "), F.lit(", by the uploader"))))]
    peaks = most_replayed(m("heatmap"), m("duration"))
    replayed = F.when(F.size(peaks) > 0, F.concat(F.array_join(F.transform(peaks, T.fmt_secs), ", "), F.lit("  (most first)")))
    counts = [_row(name, F.when(m(k).isNotNull(), T.commas(m(k)))) for name, k in COUNTS] + [_row("Replayed", replayed)]
    tags = F.array_join(F.filter(m("tags"), lambda t: t != ""), ", ")
    tag_lines = F.array_join(F.transform(wrapping.wrap(F.coalesce(tags, F.lit("")), 74), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "")
    told = F.filter(m("chapters"), lambda c: c["start_time"].isNotNull() & c["title"].isNotNull())
    wide = F.array_max(F.transform(told, lambda c: F.length(T.fmt_secs(c["start_time"]))))
    chapters = F.array_join(F.transform(told, lambda c: F.concat(F.lit("  "), F.lpad(T.fmt_secs(c["start_time"]), wide, F.lit(" ")), F.lit("  "), c["title"], F.lit("\n"))), "")
    parts = [F.concat(title, F.lit("\n\nNotes\n"), F.concat_ws("", *rows), F.lit("\n")), _section(F.concat(F.lit("Stats  (read "), T.when(now), F.lit(")\n")), counts), _section(F.lit("Tags\n"), [tag_lines]), _section(F.lit("Chapters\n"), [chapters])]
    return F.concat(*parts)


def notes(m, url: Column, now: Column, captions: Column | None = None, video: Column | None = None) -> Column:
    """The head, the description, and with captions the heading of the transcript."""
    about = T.py_strip(F.coalesce(m("description"), F.lit("")))
    told = F.when(about != "", F.concat(F.lit("Description\n"), about, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(notes_head(m, url, now, captions, video), told, F.lit("") if captions is None else F.when(captions.isNotNull(), F.lit("Transcript\n")).otherwise(F.lit("")))


def tag_file(m, comment: Column) -> Column:
    """The tags and chapters in the form that a media tool reads."""
    lists = lambda k: _told(F.array_join(F.filter(m(k), lambda x: x != ""), ", "))
    tags = [("title", _told(m("title"))), ("artist", author_of(m)), ("date", _told(m("upload_date"))), ("genre", lists("categories")), ("description", _told(m("description"))), ("synopsis", _told(m("description"))), ("keywords", lists("tags")), ("copyright", _told(m("license"))), ("comment", T.py_strip(comment))]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), T.ff_escape(v), F.lit("\n"))) for k, v in tags]
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")

    def chapter(c: Column) -> Column:
        end = F.coalesce(c["end_time"], m("duration"), c["start_time"])
        return F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms(c["start_time"]), F.lit("\nEND="), ms(end), F.lit("\ntitle="), T.ff_escape(c["title"]), F.lit("\n"))

    told = F.filter(m("chapters"), lambda c: c["start_time"].isNotNull() & c["title"].isNotNull())
    return F.concat(F.lit(";FFMETADATA1\n"), F.concat_ws("", *lines), F.coalesce(F.array_join(F.transform(told, chapter), ""), F.lit("")))


def capture_fields(m, url: Column) -> Column:
    """What a capture's header tells of the download in it: source, license, note, where, duration, channel_url, language, location."""
    note = F.when(author_of(m).isNotNull(), F.concat(m("title"), F.lit(" by "), author_of(m))).otherwise(m("title"))
    return F.struct(F.coalesce(_told(m("webpage_url")), url).alias("source"), _told(m("license")).alias("license"), F.when(_told(m("title")).isNotNull(), note).alias("note"), F.when(author_of(m).isNotNull() | m("extractor_key").isin("Reddit", "Twitter"), where_of(m)).alias("where"), F.when(m("duration") != 0, m("duration")).alias("duration"), F.coalesce(_told(m("channel_url")), _told(m("uploader_url"))).alias("channel_url"), _told(m("language")).alias("language"), _told(m("location")).alias("location"))


def comment_head(author: Column, author_id: Column, timestamp: Column, pinned: Column, likes: Column) -> Column:
    """A comment's line: who, when, whether it is pinned, its likes."""
    name = F.ltrim(F.coalesce(author, F.lit("")), F.lit("@"))
    own = F.ltrim(F.coalesce(author_id, F.lit("")), F.lit("@"))
    id_ = F.when((own != "") & (own != name), F.concat(F.lit("("), author_id, F.lit(")")))
    day = F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM-dd")
    return F.concat_ws("  ", F.concat(F.lit("@"), F.when(name == "", F.lit("unknown")).otherwise(name)), id_, day, F.when(pinned, F.lit("* pinned")), F.when(likes > 0, F.concat(T.commas(likes), F.lit(" likes"))))


def discussion(comments: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(video, text) from comments (video, pos, id, parent, author, author_id, timestamp, is_pinned, like_count, text): each root with the replies to it.

    Deeper replies aren't printed. totals (video, total): how many there are in all. Lines are made for each comment before they are put together, so one task holds a video's text alone.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    head = comment_head(*(F.col(c) for c in ("author", "author_id", "timestamp", "is_pinned", "like_count")))
    own = comments.withColumns({"head": head, "wide": wrapping.wrap(said, 74), "narrow": wrapping.wrap(said, 70), "parent": F.coalesce("parent", F.lit("")), "id": F.coalesce("id", F.lit(""))})
    joined = lambda lines, lead: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(lead), x, F.lit("\n"))), "")
    ids = own.where("id <> ''").select("video", F.col("id").alias("parent"), F.col("pos").alias("root_pos"))
    replies = own.join(ids, ["video", "parent"])
    known = ids.select("video", "parent").distinct().withColumn("there", F.lit(True))
    roots = own.join(known, ["video", "parent"], "left").where("there is null or parent = 'root' or parent = ''")
    first = roots.select("video", F.col("pos").alias("root_pos"), F.lit(-1).cast("long").alias("at"), F.concat(F.lit("\n  "), F.col("head"), F.lit("\n"), joined(F.col("wide"), "    ")).alias("lines"))
    below = replies.join(roots.select("video", F.col("pos").alias("root_pos")), ["video", "root_pos"], "left_semi")
    second = below.select("video", "root_pos", F.col("pos").cast("long").alias("at"), F.concat(F.lit("    |  "), F.col("head"), F.lit("\n"), joined(F.col("narrow"), "    |    ")).alias("lines"))
    body = first.unionByName(second).groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("root_pos", "at", "lines"))), lambda x: x["lines"]), "").alias("body"))
    shown = comments.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    every = shown.join(totals, "video", "left") if totals is not None else shown.withColumn("total", F.lit(None).cast("long"))
    count = F.concat(T.commas(F.col("n")), F.when(F.col("total") > F.col("n"), F.concat(F.lit(" of "), T.commas(F.col("total")))).otherwise(F.lit("")))
    return every.join(body, "video", "left").select("video", F.concat(F.lit("Discussion  ("), count, F.lit(")\n"), F.coalesce("body", F.lit(""))).alias("text"))


def caption_choice(files: DataFrame) -> DataFrame:
    """Of each video's caption files (video, name) the one with the shortest name, then the first by bytes."""
    return files.groupBy("video").agg(F.min_by("name", F.struct(F.length("name"), F.col("name").cast("binary"))).alias("name"))


def siblings(files: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, name) of the files (dir, name) beside a stem (dir, stem): names that begin with the stem and a dot."""
    dotted = files.withColumn("stems", F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda i: F.substring_index(F.col("name"), ".", i)))
    each = dotted.select("dir", "name", F.explode("stems").alias("stem")).where("stem <> name and (not startswith(name, '.') or startswith(stem, '.'))")
    return each.join(stems.select("dir", "stem").distinct(), ["dir", "stem"]).select("dir", "stem", "name").distinct()
