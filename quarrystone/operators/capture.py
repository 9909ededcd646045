"""Captured traffic and its upkeep: which requests count, what can be reused, what comes next, and counters that must close."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions import urls
from quarrystone.functions.classify import rules

#: Bounds of retries, bytes up to which a baseline file is copied, and of pages in a plan.
RETRY_BOUNDS, COPY_BYTES, MOST_PAGES = (1, 10), 64 << 20, 20_000


def payloads(files: DataFrame, prefixes: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """Payload files (path, content) whose name begins with an allowed prefix and names an allowed endpoint between its
    first two double underscores; equal contents become one record, at the path that sorts first."""
    name = F.element_at(F.split("path", "/"), -1)
    label = F.get(F.split(name, "__"), 1)
    begins = reduce(Column.__or__, [name.startswith(p) for p in prefixes])
    allowed = files.withColumn("label", label).filter(begins & F.col("label").isin(*labels))
    first = F.min(F.struct("path", "label"))
    return (
        allowed.groupBy(F.sha2("content", 256).alias("sha256"))
        .agg(first.alias("first"), F.count("*").alias("n"))
        .select("sha256", "first.path", "first.label", (F.col("n") - 1).alias("duplicates"))
    )


def with_natural_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """natural_rank inside each group, with runs of digits compared as numbers."""
    return rows.withColumn("natural_rank", F.row_number().over(Window.partitionBy(group).orderBy(natural_key(F.col(value)), value)))


def natural_key(text: Column) -> Column:
    """A text that sorts as text does, but for runs of digits, which sort as numbers: each carries its length ahead."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    sized = lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.concat(F.lpad(F.length(bare(p)).cast("string"), 4, "0"), bare(p))).otherwise(p)
    return F.array_join(F.transform(parts, sized), "")


def repair_order(entries: DataFrame, open_states: tuple[str, ...], most_attempts: int) -> DataFrame:
    """Entries that wait for a repair, numbered: fewest attempts first, then the longest untouched; the ceiling is held within
    bounds.  Attempts are few, so numbers come from a count for each and a rank inside (attempts, hour)."""
    low, high = RETRY_BOUNDS
    waiting = entries.filter(F.col("state").isin(*open_states) & (F.col("attempts") < max(low, min(high, most_attempts))))
    dealt = waiting.withColumn("_hour", F.date_trunc("hour", "updated_at"))
    before = Window.orderBy("attempts", "_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("attempts", "_hour").agg(F.count("*").alias("_n")).select(
        "attempts", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    inside = F.row_number().over(Window.partitionBy("attempts", "_hour").orderBy("updated_at", "entry"))
    numbered = dealt.withColumn("_i", inside).join(offsets, ["attempts", "_hour"])
    return numbered.withColumn("place", F.col("_o") + F.col("_i")).drop("_hour", "_o", "_i")


def page_plan(listings: DataFrame, total: str, page_size: str, most: int = MOST_PAGES) -> DataFrame:
    """One row for each page that a listing with so many rows needs; a listing without rows still has its first page."""
    pages = F.least(F.greatest(F.ceil(F.col(total) / F.greatest(F.col(page_size), F.lit(1))), F.lit(1)), F.lit(most)).cast("int")
    return listings.select("*", F.explode(F.sequence(F.lit(1), pages)).alias("page"))


def template_of(requests: DataFrame, group: str, template: str, total: str) -> DataFrame:
    """The request template of each group that announces the most rows; of equals, the one that sorts first."""
    best = F.min(F.struct((-F.col(total)).alias("less"), F.col(template).alias("template")))
    return requests.groupBy(group).agg(best.alias("b")).select(group, F.col("b.template").alias("template"), (-F.col("b.less")).alias("total"))


def hash_index(objects: DataFrame, explicit: DataFrame) -> DataFrame:
    """sha256 to path: of objects (sha256, path) the path that sorts first; an explicit entry (sha256, path, position) overrides
    it, the last one written."""
    found = objects.groupBy("sha256").agg(F.min("path").alias("_object"))
    told = explicit.groupBy("sha256").agg(F.max_by("path", "position").alias("_told"))
    return found.join(told, "sha256", "full").select(
        "sha256", F.coalesce("_told", "_object").alias("path"), F.when(F.col("_told").isNotNull(), "index").otherwise("object").alias("origin")
    )


def reuse(responses: DataFrame, index: DataFrame, sources: DataFrame) -> DataFrame:
    """decision for responses (response_id, sha256, source_identity): bytes that the index (sha256) knows are reused; a source that
    once gave verified bytes with a success code (source_identity, status, size, verified) needs no download; the rest is stored."""
    known = index.select("sha256").distinct().withColumn("_known", F.lit(True))
    good = sources.filter((F.col("status").between(200, 299)) & (F.col("size") > 0) & F.col("verified")).select("source_identity").distinct().withColumn("_good", F.lit(True))
    joined = responses.join(known, "sha256", "left").join(good, "source_identity", "left")
    return joined.select("response_id", F.when(F.col("_known"), "reuse_bytes").when(F.col("_good"), "skip_download").otherwise("store").alias("decision"))


def listing_changes(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of folders (folder, name): whose listing is as before, by a fingerprint of sorted names, and the names to scan anew in the others."""
    mark = lambda df: df.groupBy("folder").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("name")), "\n"), 256).alias("fingerprint"), F.countDistinct("name").alias("names"))
    a, b = mark(now), mark(before).select("folder", F.col("fingerprint").alias("_before"))
    states = a.join(b, "folder", "left").select(
        "folder", "names", F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("fingerprint"), "cached").otherwise("changed").alias("state")
    )
    fresh = now.select("folder", "name").distinct().join(before.select("folder", "name"), ["folder", "name"], "left_anti")
    return states, fresh


def frozen(files: DataFrame, expected: DataFrame) -> DataFrame:
    """How baseline files (rel, sha256, bytes) are held: bound by hash if they are what expected (rel, sha256) says, copied too up to a size."""
    e = expected.select("rel", F.col("sha256").alias("_expected"))
    joined = files.join(e, "rel", "full")
    state = rules(
        (F.col("sha256").isNull(), "missing"), (F.col("_expected").isNull(), "unlisted"), (F.col("sha256") != F.col("_expected"), "hash_mismatch"),
        (F.col("bytes") <= COPY_BYTES, "copied"), otherwise="bound_by_hash",
    )
    return joined.select("rel", state.alias("state"))


def related_resources(texts: DataFrame, key: str, text: str, denied: tuple[str, ...] = ()) -> DataFrame:
    """The urls of a text by their identity, the first of each, without those on denied hosts."""
    found = texts.select(key, F.posexplode(urls.urls_in(F.coalesce(F.col(text), F.lit("")))).alias("place", "url"))
    allowed = found.filter(~urls.on_hosts(F.col("url"), denied)) if denied else found
    first = F.min(F.struct("place", "url"))
    return allowed.groupBy(key, urls.identity(F.col("url")).alias("identity")).agg(first.alias("f")).select(
        key, "identity", F.col("f.url").alias("url"), F.col("f.place").cast("long").alias("place")
    )


def attempts(rows: DataFrame, group: str, status: str) -> DataFrame:
    """Counters of each group: available and deleted must make up the attempted, and nothing may stay unavailable."""
    state = F.col(status)
    counted = rows.groupBy(group).agg(
        F.count("*").alias("attempted"), F.count_if(state == "available").alias("available"), F.count_if(state == "deleted").alias("deleted"),
        F.count_if(state == "unavailable").alias("unavailable")
    )
    return counted.withColumn("closed", (F.col("available") + F.col("deleted") == F.col("attempted")) & (F.col("unavailable") == 0))


def session_counters(rows: DataFrame, session: str, sequence: str, sha: str) -> DataFrame:
    """Of each session: rows, how many brought new bytes, how many repeat bytes that any earlier row brought, and its sequence bounds."""
    firsts = rows.groupBy(sha).agg(F.min(F.struct(sequence, session)).alias("_f")).select(F.col(f"_f.{session}").alias(session)).groupBy(session).agg(F.count("*").alias("new_objects"))
    counted = rows.groupBy(session).agg(F.count("*").alias("rows"), F.min(sequence).alias("first_sequence"), F.max(sequence).alias("last_sequence"))
    joined = counted.join(firsts, session, "left").withColumn("new_objects", F.coalesce("new_objects", F.lit(0)).cast("long"))
    return joined.withColumn("deduplicated", F.col("rows") - F.col("new_objects"))


def advance(events: DataFrame, key: str, time: str, waited: int, stopping: Column) -> DataFrame:
    """What follows each event of a key: stop where it says so, advance if nothing else comes for the seconds to wait, else ignore."""
    after = F.lead(F.unix_micros(F.col(time).cast("timestamp"))).over(Window.partitionBy(key).orderBy(time, "event_id"))
    gap = after - F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("decision", rules((stopping, "stop"), (gap.isNull() | (gap >= waited * 1_000_000), "advance"), otherwise="ignore"))


def written_back(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks (task_id, state) after results (task_id, ok, error_code, output_sha256): only running tasks take one; results of unknown tasks are told apart."""
    r = results.withColumn("_r", F.lit(True))
    joined = tasks.join(r, "task_id", "full")
    takes = (F.col("state") == "running") & F.col("_r")
    state = rules(
        (F.col("state").isNull(), "unknown_task"), (takes & F.col("ok"), "completed"), (takes & F.col("error_code").startswith("SOURCE_"), "source_gap"),
        (takes, "failed"), otherwise=F.col("state")
    )
    return joined.select(
        "task_id", state.alias("state"), F.when(takes & ~F.col("ok"), F.col("error_code")).alias("error_code"),
        F.when(takes & F.col("ok"), F.col("output_sha256")).alias("output_sha256")
    )


def boxes_in_cells(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """box_id, cell_id, how: of the cells of its page the smallest that holds the box's centre, else the one it overlaps most.

    Boxes and cells carry page, x0, y0, x1, y1; they meet by page only, which bounds both."""
    c = cells.select("page", "cell_id", *(F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")))
    joined = boxes.join(c, "page", "left")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("c_x0") <= x) & (x <= F.col("c_x1")) & (F.col("c_y0") <= y) & (y <= F.col("c_y1"))
    area = (F.col("c_x1") - F.col("c_x0")) * (F.col("c_y1") - F.col("c_y0"))
    side = lambda a: F.greatest(F.least(a + "1", f"c_{a}1") - F.greatest(a + "0", f"c_{a}0"), F.lit(0))
    overlap = side("x") * side("y")
    best = F.min(F.when(inside, F.struct(F.lit(0).alias("rank"), area.cast("double").alias("size"), "cell_id")).when(
        overlap > 0, F.struct(F.lit(1).alias("rank"), (-overlap).cast("double").alias("size"), "cell_id")
    ))
    found = joined.groupBy("box_id").agg(best.alias("b"))
    return found.select(
        "box_id", F.col("b.cell_id").alias("cell_id"), rules((F.col("b.rank") == 0, "centre"), (F.col("b.rank") == 1, "overlap"), otherwise="none").alias("how")
    )


def matched_sources(messages: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Messages with the one source each must have: how many there are, and what follows."""
    n = sources.groupBy(key).agg(F.count("*").alias("sources"))
    joined = messages.select(key).distinct().join(n, key, "left").withColumn("sources", F.coalesce("sources", F.lit(0)).cast("long"))
    return joined.withColumn("match", rules((F.col("sources") == 0, "missing"), (F.col("sources") > 1, "duplicate"), otherwise="matched"))


def section_records(summaries: DataFrame, key: str, body: str) -> DataFrame:
    """Records of the top-level sections of JSON objects: one for each item of a list, one for any other value; an empty list keeps one row."""
    sections = summaries.select(key, F.explode(F.from_json(body, "map<string,string>")).alias("section", "value"))
    items = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>"))
    listed = sections.withColumn("_items", items)
    lists = listed.filter(F.col("_items").isNotNull()).select(key, "section", F.posexplode_outer("_items").alias("item_index", "item"))
    lists = lists.withColumn("value", F.coalesce("item", F.when(F.col("item_index").isNull(), F.lit("[]")))).drop("item")
    single = listed.filter(F.col("_items").isNull()).select(key, "section", F.lit(None).cast("int").alias("item_index"), "value")
    return lists.unionByName(single)


def resource_facts(found: DataFrame, url: str, position: str) -> DataFrame:
    """What nested objects say of each url: filename, mime and size, each by the last object that says it."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c)
    return found.groupBy(url).agg(last("filename"), last("mime"), last("size"))


def attachment_names(mails: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """The distinct names that lists of attachments (url, name) give each url identity, sorted; the lists of one mail are read together."""
    every = mails.select(key, F.explode(F.concat(*(F.coalesce(F.col(c), F.array()) for c in lists))).alias("a"))
    named = every.filter(F.trim("a.name") != "").groupBy(urls.identity(F.col("a.url")).alias("identity"))
    return named.agg(F.array_join(F.sort_array(F.collect_set("a.name")), "|").alias("names"), F.countDistinct(key).alias("mails"))
