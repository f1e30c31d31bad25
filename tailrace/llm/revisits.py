"""Not-modified revisit records resolved to the latest earlier full response of their URL.

Records have record_id, url, captured (long), kind (`response` or `revisit`), etag, last_modified,
headers (map of lower-case names) and digest. A revisit takes the response with the same canonical
URL and the largest captured below its own (of several at that moment, the largest record_id). It is
resolved if the validators agree: the entity tags if the revisit has one (compared weakly), else the
dates of the last change. A resolved revisit has the response's digest and headers, replaced or
extended by its own as far as a 304 response may update them.

The as-of join splits every URL's records in time slices of equal length: within a slice a window
finds the latest response, across slices a small one carries the last response of earlier slices. So
no task orders more than one slice of one URL. Only ids and times are ordered; headers join later,
and bodies never move.

Outcomes: resolved, no_earlier_response (also for a null or empty URL or a null time),
validator_mismatch, no_validator. Rows of other kinds are ignored. Repeated response ids count once
(the smallest row); repeated revisits are resolved each. An empty table gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Header fields that a 304 response does not update in the stored response.
NOT_UPDATED = (
    "connection content-encoding content-length content-md5 content-range content-type digest etag"
    " keep-alive proxy-authenticate proxy-connection trailer transfer-encoding upgrade"
).split()
SLICES = 4_096
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)\??(.*)$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, query sorted and
    without tracking fields, no scheme, no fragment. What is no absolute URL is only trimmed."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host, path, query = (F.regexp_extract(bare, URL, i) for i in (1, 2, 3))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r":(80|443)$", "")
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^utm_")))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    whole = F.concat(host, F.regexp_replace(path, "/+$", ""), query)
    return F.when(bare.rlike(URL), whole).when(bare != "", bare)


def tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def latest_response(records: DataFrame) -> DataFrame:
    """Revisits of `records` (record_id, place, captured, kind, ...) with response_id. place: canonical URL."""
    low, high = records.agg(F.min("captured"), F.max("captured")).first()
    span = 1 if low is None else high - low + 1
    slice_ = F.floor((F.col("captured") - F.lit(low or 0)) * F.lit(float(SLICES)) / F.lit(span))
    # Rows without a URL or a time match nothing; each gets a place of its own, so none is hot.
    lost = F.col("place").isNull() | F.col("captured").isNull()
    alone = F.concat(F.lit("\0"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    rows = records.withColumns({"__key": F.when(lost, alone).otherwise(F.col("place")), "__slice": slice_, "__lost": lost})
    answer = F.when(~F.col("__lost") & (F.col("kind") == "response"), F.struct("captured", "record_id"))
    rows = rows.withColumn("__answer", answer)
    inside = W.partitionBy("__key", "__slice").orderBy("captured").rangeBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("__key", "__slice").agg(F.max("__answer").alias("__last"))
    carried = carried.withColumn("__last", F.max("__last").over(across)).where("__last is not null")
    found = rows.withColumn("__inside", F.max("__answer").over(inside)).where("kind = 'revisit'")
    found = found.join(carried, ["__key", "__slice"], "left")
    found = found.withColumn("response_id", F.coalesce("__inside.record_id", "__last.record_id"))
    found = found.withColumn("response_id", F.when(~F.col("__lost"), F.col("response_id")))
    return found.select(*records.columns, "response_id")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured, response_id, outcome, digest, headers.
    response_id is the latest earlier response also where validators disagree."""
    own = ("record_id", "captured", "etag", "last_modified", "headers")
    records = records.select(*own, "kind", "digest", canonical_url(F.col("url")).alias("place"))
    found = latest_response(records.select(*own, "kind", "place"))
    details = F.struct(
        F.array_sort(F.map_entries("headers")).alias("entries"),
        tag(F.col("etag")).alias("etag"),
        F.trim("last_modified").alias("last_modified"),
        "digest",
    )
    responses = records.where("kind = 'response'").groupBy(F.col("record_id").alias("response_id"))
    rows = found.join(responses.agg(F.min(details).alias("full")), "response_id", "left")
    mine, dated = tag(F.col("etag")), F.trim("last_modified")
    agree = F.when(mine.isNotNull(), mine == F.col("full.etag")).otherwise(dated == F.col("full.last_modified"))
    outcome = (
        F.when(F.col("response_id").isNull(), "no_earlier_response")
        .when(mine.isNull() & dated.isNull(), "no_validator")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    rows = rows.withColumn("outcome", outcome)
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(NOT_UPDATED))
    stored = F.map_from_entries(F.coalesce("full.entries", F.array().cast("array<struct<key:string,value:string>>")))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(update, k))
    resolved = F.col("outcome") == "resolved"
    return rows.select(
        "record_id",
        F.col("place").alias("canonical_url"),
        "captured",
        "response_id",
        "outcome",
        F.when(resolved, F.col("full.digest")).alias("digest"),
        F.when(resolved, F.map_concat(kept, update)).alias("headers"),
    )


def with_bodies(resolved: DataFrame, responses: DataFrame, body: str) -> DataFrame:
    """Resolved revisits with the body of their response. responses: record_id and body, ids unique."""
    bodies = responses.select(F.col("record_id").alias("response_id"), body)
    return resolved.where("outcome = 'resolved'").join(bodies, "response_id")


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl that met every page once and asked again for it later.

    The page gives a response at its id as time, and a revisit 1,000 moments later, or 1,000 earlier
    for every 13th. Every 7th revisit has another tag, every 11th no tag, every 77th no validator."""
    tag_ = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    changed = F.expr("concat('day ', page_id div 100)")
    number = F.col("page_id")
    shared = pages.withColumns({"tag_": tag_, "changed": changed, "digest": F.md5("html")})
    response = shared.select(
        (number * 2).alias("record_id"),
        "url",
        number.alias("captured"),
        F.lit("response").alias("kind"),
        F.col("tag_").alias("etag"),
        F.col("changed").alias("last_modified"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.octet_length("html").cast("string"),
            F.lit("date"), F.concat(F.lit("moment "), number.cast("string")),
        ).alias("headers"),
        "digest",
    )
    sent = F.when(number % 7 == 0, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag_")))
    moment = number + F.when(number % 13 == 0, -1000).otherwise(1000)
    revisit = shared.select(
        (number * 2 + 1).alias("record_id"),
        "url",
        moment.alias("captured"),
        F.lit("revisit").alias("kind"),
        F.when(number % 11 != 0, sent).alias("etag"),
        F.when(number % 77 != 0, F.col("changed")).alias("last_modified"),
        F.create_map(
            F.lit("content-length"), F.lit("0"),
            F.lit("date"), F.concat(F.lit("moment "), moment.cast("string")),
            F.lit("x-cache"), F.lit("hit"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)
