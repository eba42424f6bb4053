"""Histories of browsers: joins over the tables that browsers keep. Times are microseconds since 1601 (one family) or 1970 (the other)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import bits, texts, times
from tracewright.operators.joins import zipped
from tracewright.operators.reshape import map_rows, paths, tree_rows


def search_terms(terms: DataFrame, urls: DataFrame) -> DataFrame:
    """(term, url, site, visited) of each searched word, latest first. Words whose page is unknown are left out."""
    u = urls.select(F.col("id").alias("url_id"), "url", "last_visit_time")
    joined = terms.select("url_id", "term").join(u, "url_id")
    shown = joined.select("term", "url", texts.search_site(F.col("url")).alias("site"), times.browser_time(F.col("last_visit_time").cast("string")).alias("visited"), "last_visit_time")
    return shown.orderBy(F.desc("last_visit_time"), "term", "url").drop("last_visit_time")


def visit_history(visits: DataFrame, urls: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, url, title, from_url, segment, core, qualifiers, visited, duration); what is missing is the empty string."""
    u = urls.select(F.col("id").alias("url"), F.col("url").alias("address"), "title")
    origin = visits.select(F.col("id").alias("from_visit"), F.col("url").alias("_from")).join(u.select(F.col("url").alias("_from"), F.col("address").alias("from_url")), "_from", "left").drop("_from")
    s = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment"))
    joined = visits.join(u, "url", "left").join(origin, "from_visit", "left").join(s, "segment_id", "left")
    none = F.lit("")
    kind = bits.transition(F.col("transition").cast("bigint"))
    return joined.select(
        "id", F.coalesce("address", none).alias("url"), F.coalesce("title", none).alias("title"), F.coalesce("from_url", none).alias("from_url"), F.coalesce("segment", none).alias("segment"),
        kind["core"].alias("core"), kind["qualifiers"].alias("qualifiers"), times.browser_time(F.col("visit_time").cast("string")).alias("visited"),
        times.duration_text(F.floor(F.col("visit_duration") / 1_000_000)).alias("duration"),
    )


def place_history(visits: DataFrame, places: DataFrame) -> DataFrame:
    """(id, url, title, from_url, kind, visited) of the other family; an unknown origin keeps its raw id."""
    p = places.select(F.col("id").alias("place_id"), "url", "title")
    origin = visits.select(F.col("id").alias("from_visit"), F.col("place_id").alias("_p")).join(p.select(F.col("place_id").alias("_p"), F.col("url").alias("_from")), "_p", "left").drop("_p")
    joined = visits.join(p, "place_id", "left").join(origin, "from_visit", "left")
    return joined.select("id", "url", "title", F.coalesce("_from", F.col("from_visit").cast("string")).alias("from_url"), bits.decoded(F.col("visit_type").cast("bigint"), bits.VISIT_TYPES).alias("kind"), times.unix_by_length(F.col("visit_date").cast("string")).alias("visited"))


def icons(mapping: DataFrame, favicons: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(page_url, url, width, height) of each icon's bitmaps; pages without an icon keep nulls."""
    f = favicons.select(F.col("id").alias("icon_id"), "url").join(bitmaps.select("icon_id", "width", "height"), "icon_id")
    return mapping.select("page_url", "icon_id").join(f, "icon_id", "left").drop("icon_id")


def icon_lists(favicons: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, url, page_urls): each icon with the sorted list of its distinct pages, which is empty for icons of no page.

    The pairs are made distinct first, so that equal ones are combined before the shuffle.
    """
    pages = mapping.select(F.col("icon_id").alias("id"), "page_url").distinct().groupBy("id").agg(F.sort_array(F.collect_list("page_url")).alias("page_urls"))
    return favicons.select("id", "url").join(pages, "id", "left").withColumn("page_urls", F.coalesce("page_urls", F.array().cast("array<string>")))


def required_settings(settings: DataFrame, names: list[str]) -> DataFrame:
    """One row a profile with a column for each of ``names``; a profile that lacks one ends the query with an error that says which."""
    wide = settings.groupBy("profile").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
    missing = lambda n: F.raise_error(F.concat(F.lit(f"setting {n} is missing in profile "), F.col("profile").cast("string"))).cast("string")
    return wide.select("profile", *(F.coalesce(F.col(n), missing(n)).alias(n) for n in names))


def downloads(targets: DataFrame, details: DataFrame) -> DataFrame:
    """(place_id, n, target, detail): where a place has as many targets as details they are paired by position, else all that share it are."""
    counted = lambda f, c: f.groupBy("place_id").agg(F.count(F.lit(1)).alias(c))
    same = counted(targets, "a").join(counted(details, "b"), "place_id").filter("a = b").select("place_id")
    by_position = zipped(targets.join(same, "place_id"), details.join(same, "place_id"), [F.col("target_id")], [F.col("detail_id")], ["place_id"])
    by_place = targets.join(same, "place_id", "left_anti").join(details, "place_id")
    columns = ["place_id", "target", "detail"]
    return by_position.select(*columns).unionByName(by_place.select(*columns))


def bookmarks(profiles: DataFrame, json: str) -> DataFrame:
    """(profile, path, name, depth) of the nodes under the bookmark bar of each profile's JSON."""
    bars = profiles.withColumn("_bar", F.get_json_object(json, "$.roots"))
    return tree_rows(bars, ["profile"], "_bar", "children", "name", "bookmark_bar")


def bookmark_paths(rows: DataFrame) -> DataFrame:
    """(id, path) of bookmarks that name their parents."""
    return paths(rows, "id", "parent", "title")


def site_settings(profiles: DataFrame, json: str, where: str) -> DataFrame:
    """(profile, key, value) of the entries of the object at the JSON path ``where`` of each profile's preferences."""
    return map_rows(profiles.withColumn("_o", F.get_json_object(json, where)), ["profile"], "_o")


def cookies(frame: DataFrame) -> DataFrame:
    """(host, name, same_site): columns that older databases lack come out empty."""
    same = F.col("samesite") if "samesite" in frame.columns else F.lit("")
    return frame.select(F.col("host_key").alias("host"), "name", same.cast("string").alias("same_site"))
