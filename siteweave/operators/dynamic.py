"""Dynamic loading over recorded snapshots: page_snapshots(url, trigger_id, step, html); a click or scroll is the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions import text, urls
from siteweave.scratch import written

#: Steps a trigger type may take (fixed values).
LIMITS = {"Pagination": 10, "Load More": 20, "Tabs": 1, "Accordions": 1, "Expanders": 1}
MOST_SCROLLS, MOST_STILL, MOST_ATTEMPTS, SLACK = 10, 3, 15, 10
GROWING = ("link_count", "product_count", "card_count", "list_item_count")


def snapshot_links(snapshots: DataFrame) -> DataFrame:
    """(page_url, trigger_id, step, pos, url) of the accepted anchors of each snapshot."""
    rows = snapshots.select(F.col("url").alias("page_url"), "trigger_id", "step", F.posexplode(text.hrefs(F.col("html"))).alias("pos", "href"))
    rows = rows.filter(urls.link_scheme_ok(F.col("href"))).withColumn("url", urls.resolve(F.col("page_url"), F.col("href")))
    return rows.filter(urls.same_domain(F.col("url"), F.col("page_url"))).drop("href")


def dispatched(triggers: DataFrame) -> DataFrame:
    """Triggers of a known type with the steps they may take."""
    allowed = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    return triggers.withColumn("step_limit", F.try_element_at(allowed, F.col("trigger_type"))).filter("step_limit is not null")


def exhausted(links: DataFrame, triggers: DataFrame, known: DataFrame) -> DataFrame:
    """(page_url, trigger_id, step, url): links new at a step, up to the first step without any and the type's limit.

    links of snapshot_links; triggers(page_url, trigger_id, trigger_type); known(page_url, url) are found already.
    """
    reach = dispatched(triggers).select("page_url", "trigger_id", "step_limit")
    fresh = links.filter("step > 0").join(known.select("page_url", "url"), ["page_url", "url"], "left_anti")
    first = fresh.groupBy("page_url", "trigger_id", "url").agg(F.min("step").alias("step")).join(reach, ["page_url", "trigger_id"]).filter("step <= step_limit")
    order = Window.partitionBy("page_url", "trigger_id").orderBy("step")
    return first.withColumn("run", F.dense_rank().over(order)).filter("run = step").select("page_url", "trigger_id", "step", "url")


def session(links: DataFrame, triggers: DataFrame, known: DataFrame, most_triggers: int = 20) -> DataFrame:
    """All triggers of every page in the order of their ids; what one finds is known to the next. A page of more than most_triggers raises.

    Links and triggers are written once; round n takes the n-th trigger of every page.
    """
    nth = F.row_number().over(Window.partitionBy("page_url").orderBy("trigger_id"))
    ranked = written(dispatched(triggers).drop("step_limit").withColumn("nth", nth))
    most = ranked.agg(F.max("nth")).first()[0] or 0
    if most > most_triggers:
        raise ValueError(f"more than {most_triggers} triggers on a page")
    fresh = links.filter("step > 0").join(known.select("page_url", "url").distinct(), ["page_url", "url"], "left_anti")
    left = written(fresh.join(ranked.select("page_url", "trigger_id", "nth"), ["page_url", "trigger_id"]))
    out = None
    for n in range(1, most + 1):
        # what the rounds before found is taken off this round's links only
        own = left.filter(F.col("nth") == n)
        got = written(exhausted(own, ranked.filter(F.col("nth") == n), (out if out is not None else left.limit(0)).select("page_url", "url")))
        out = got if out is None else out.union(got)
    return out if out is not None else exhausted(links, triggers, known).limit(0)


def at_bottom(top: Column, client: Column, height: Column) -> Column:
    return top + client >= height - SLACK


def scrollable(overflow: Column, client: Column, height: Column) -> Column:
    return overflow.isin("auto", "scroll") & (height > client)


def changed(new: Column, old: Column) -> Column:
    """Any growing metric of a struct is larger."""
    out = F.lit(False)
    for m in GROWING:
        out = out | (new[m] > old[m])
    return out


def scrolled(steps: DataFrame, *keys: str) -> DataFrame:
    """keys, scrolls done, growths (steps that changed the content), last_step: a container's scrolls until 10, 3 without change, or the bottom without change.

    steps(keys, step, GROWING metrics, scroll_top, client_height, scroll_height); step 0 is the start. The fold over a
    container's at most 11 first steps is exact also where metrics shrink between.
    """
    metrics = F.struct(*GROWING)
    row = F.struct("step", metrics.alias("m"), at_bottom(F.col("scroll_top"), F.col("client_height"), F.col("scroll_height")).alias("bottom"))
    packed = steps.filter(F.col("step") <= MOST_SCROLLS).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def fold(acc: Column, x: Column) -> Column:
        grew = changed(x["m"], acc["m"])
        still = F.when(grew, 0).otherwise(acc["still"] + 1)
        moved = F.struct(
            F.when(grew, x["m"]).otherwise(acc["m"]).alias("m"), still.alias("still"), (acc["scrolls"] + 1).alias("scrolls"), F.when(grew, F.concat(acc["growths"], F.array(x["step"]))).otherwise(acc["growths"]).alias("growths"), ((still >= MOST_STILL) | (x["bottom"] & (still > 0))).alias("stop")
        )
        return F.when(acc["stop"], acc).otherwise(moved)

    start = F.struct(F.element_at("rows", 1)["m"].alias("m"), F.lit(0).alias("still"), F.lit(0).alias("scrolls"), F.array().cast("array<int>").alias("growths"), F.lit(False).alias("stop"))
    end = F.aggregate(F.slice("rows", 2, MOST_SCROLLS), start, fold)
    return packed.withColumn("end", end).select(*keys, F.col("end.scrolls").alias("scrolls"), F.col("end.growths").alias("growths"))


def budgeted(containers: DataFrame, *keys: str) -> DataFrame:
    """Containers (keys, rank, links) that are still tried: links found before, or 1 each, are within 15 attempts."""
    before = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.greatest(F.col("links"), F.lit(1))).over(before), F.lit(0))
    return containers.withColumn("spent", spent.cast("long")).filter(F.col("spent") < MOST_ATTEMPTS)


def resolved_elements(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, id, element, rule): the first element that a target's id, text, first class or label finds, in this order of rules.

    targets(page_id, id, tag_name, text_content, class_names, element_id, aria_label); elements(page_id, element, same fields).
    Both sides have rows for every page: files of few compressed bytes may not make one of them a broadcast, which the driver holds whole.
    """
    t, e = targets.hint("merge").alias("t"), elements.alias("e")
    tag = F.col("t.tag_name") == F.col("e.tag_name")
    first_class = F.element_at(F.split("t.class_names", " "), 1)
    rules = [
        (F.col("t.element_id") != "") & (F.col("t.element_id") == F.col("e.element_id")),
        (F.col("t.text_content") != "") & tag & F.col("e.text_content").contains(F.col("t.text_content")),
        (F.col("t.class_names") != "") & tag & F.array_contains(F.split("e.class_names", " "), first_class),
        (F.col("t.aria_label") != "") & (F.col("t.aria_label") == F.col("e.aria_label")),
    ]
    rank = F.lit(None).cast("int")
    for k, hit in reversed(list(enumerate(rules))):
        rank = F.when(hit, k).otherwise(rank)
    rows = t.join(e, F.col("t.page_id") == F.col("e.page_id")).select("t.page_id", "t.id", F.col("e.element").alias("element"), rank.alias("rule")).filter("rule is not null")
    w = Window.partitionBy("page_id", "id").orderBy("rule", "element")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
