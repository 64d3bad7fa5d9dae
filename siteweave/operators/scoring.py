"""Scores from model replies: extraction, validation, retry, joining back to links, prompt payloads.

Replies are data: a table of recorded attempts (replay), or rule scores as columns; a live scorer can be plugged in with ``Scorer``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions import text

NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|BOOLEAN)$"
WHOLE = r"^(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN)$"


#: Texts of the prompts (own wording; the reply format is fixed).
SYSTEM_PROMPT = "You rate the links of a web page by how likely they lead to product pages. You answer with JSON and nothing else."
INSTRUCTION = "Rate each link from 0 to 10: under 1 never leads to a product, 1 to 4 hardly, 4 to 8 is on the way, 8 to 9 probably is one, 9 and more is a product page, whose name you give."
STRUCTURE = 'Answer with a JSON array with one object for each link: [{"id": 0, "score": 7.5}, {"id": 1, "score": 9.5, "productName": "Name"}].'
#: Path parts that the offline rules know, with the score in thousandths of what follows them; the first that fits counts.
RULES = ((r"/(?:p|product|products|item|items|dp)/[^/?]+", 9200), (r"/(?:b|c|category|categories|collection|collections|shop|catalog|brand|brands)(?:/|$)", 7000), (r"/(?:login|account|cart|checkout|privacy|terms|imprint|contact|about|help|jobs)(?:/|$)", 500))
OTHERWISE = 4000


def rules(links: DataFrame) -> DataFrame:
    """links(url, title, ...) with milli and product_name by the offline rules: no model, no network, one projection."""
    path, milli = F.lower(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)), F.lit(OTHERWISE)
    for pattern, score in reversed(RULES):
        milli = F.when(path.rlike(pattern), score).otherwise(milli)
    return links.withColumn("milli", milli.cast("int")).withColumn("product_name", F.when(F.col("milli") >= 9000, F.nullif(text.strip(F.col("title")), F.lit(""))))


def prompt(links: list[dict]) -> str:
    """Instruction for a scorer: the links' id, relative_path, title and description as JSON."""
    import json

    kept = [{k: x.get(k) for k in ("id", "relative_path", "title", "description")} for x in links]
    return f"{INSTRUCTION}\n\n{json.dumps(kept, ensure_ascii=False)}"


def system_prompt(path: str | None = None) -> str:
    """The system prompt in a file, else SYSTEM_PROMPT."""
    try:
        return open(path, encoding="utf-8").read() if path else SYSTEM_PROMPT
    except OSError:
        return SYSTEM_PROMPT


def ask(scorer: Scorer, links: list[dict], system: str = SYSTEM_PROMPT, attempts: int = 4) -> list[tuple[int, int, int, str]]:
    """A live scorer's replies to the links of one page, as rows (key 0, attempt, expected_count, reply) for ``with_retry``; a call that raises counts as an attempt without answer."""
    rows = []
    for attempt in range(1, attempts + 1):
        try:
            reply = scorer.send(system, prompt(links), STRUCTURE)
        except Exception:
            reply = ""
        rows.append((0, attempt, len(links), reply))
        if reply:
            break
    return rows


class Scorer(Protocol):
    """Anything that answers prompts: one reply text per (system, instruction, structure)."""

    def send(self, system: str, instruction: str, structure: str | None = None, max_tokens: int = 4000) -> str: ...


def array_part(reply: Column) -> Column:
    """From the first [ to the last ], or null."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit(""))


def object_part(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def elements(replies: DataFrame, *keys: str) -> DataFrame:
    """keys, place, item (VARIANT), for the elements of the array in each reply that is one."""
    parsed = replies.withColumn("__v", F.try_parse_json(array_part(F.col("reply")))).filter(F.schema_of_variant("__v").startswith("ARRAY"))
    view = parsed.select(*keys, "__v")
    return view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("__v").outer()).select(F.col("pos").alias("place"), F.col("value").alias("item"))).select(*keys, "place", "item")


def parsed_scores(replies: DataFrame, *keys: str) -> DataFrame:
    """Per reply with an array: scores of the ids 0 .. expected_count - 1, the last of equal ids, 0 where missing, and whether all are numbers.

    keys, id, score, product_name, valid (of the whole reply).
    """
    kind = F.schema_of_variant(F.try_variant_get("item", "$.id", "variant"))
    items = elements(replies, *keys).filter(F.schema_of_variant("item").startswith("OBJECT") & kind.rlike(WHOLE)).withColumn("id", F.try_variant_get("item", "$.id", "int"))
    last = Window.partitionBy(*keys, "id").orderBy(F.desc("place"))
    kept = items.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select(*keys, "id", "item")
    wanted = replies.filter(F.schema_of_variant(F.try_parse_json(array_part(F.col("reply")))).startswith("ARRAY")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("expected_count") - 1)).alias("id"))
    rows = wanted.join(kept, [*keys, "id"], "left")
    score_kind = F.schema_of_variant(F.try_variant_get("item", "$.score", "variant"))
    good = F.col("item").isNull() | F.coalesce(score_kind.rlike(NUMBER), F.lit(False))
    every = Window.partitionBy(*keys)
    return rows.select(
        *keys,
        "id",
        F.when(F.col("item").isNull(), 0.0).otherwise(F.try_variant_get("item", "$.score", "double")).alias("score"),
        F.try_variant_get("item", "$.productName", "string").alias("product_name"),
        F.min(good).over(every).alias("valid"),
    )


def with_retry(replies: DataFrame, key: str, attempts: int = 4) -> DataFrame:
    """Per key the scores of its first valid attempt, else 0 for every id. replies(key, attempt, expected_count, reply)."""
    tried = replies.filter(F.col("attempt") <= attempts)
    scores = parsed_scores(tried, key, "attempt").filter("valid")
    first = scores.groupBy(key).agg(F.min("attempt").alias("attempt"))
    chosen = scores.join(first, [key, "attempt"]).select(key, "id", "score", "product_name", "attempt")
    ids = tried.groupBy(key).agg(F.max("expected_count").alias("n")).select(key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("id"))
    return ids.join(chosen, [key, "id"], "left").select(key, "id", F.coalesce("score", F.lit(0.0)).alias("score"), "product_name", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def join_scores(links: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """links(key, id, ...) with the score of their id, else of their place in the reply, else 0. scores(key, place, id, score, product_name)."""
    w = Window.partitionBy(key, "id").orderBy("place")
    by_id = scores.filter("id is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(key, "id", F.col("score").alias("s1"), F.col("product_name").alias("p1"), F.lit(True).alias("hit1"))
    by_place = scores.select(key, F.col("place").alias("id"), F.col("score").alias("s2"), F.col("product_name").alias("p2"), F.lit(True).alias("hit2"))
    rows = links.join(by_id, [key, "id"], "left").join(by_place, [key, "id"], "left")
    source = F.when(F.col("hit1"), "id").when(F.col("hit2"), "position").otherwise("default")
    pick = lambda a, b, d: F.when(F.col("hit1"), F.col(a)).when(F.col("hit2"), F.col(b)).otherwise(d)
    return rows.select(*links.columns, pick("s1", "s2", F.lit(0.0)).alias("score"), pick("p1", "p2", F.lit(None)).alias("product_name"), source.alias("score_source"))


def verdicts(replies: DataFrame) -> DataFrame:
    """(url, product_name) of replies(url, reply) that confirm a product page and name it."""
    v = F.try_parse_json(object_part(F.col("reply")))
    rows = replies.withColumn("v", v).select("url", F.try_variant_get("v", "$.isProductPage", "boolean").alias("flag"), F.try_variant_get("v", "$.productName", "string").alias("name"))
    return rows.filter("flag and name <> ''").select("url", text.strip(F.col("name")).alias("product_name"))


def triggers(replies: DataFrame) -> DataFrame:
    """(page_id, id, trigger_type) of replies(page_id, reply): entries with an id other than -1 and a type."""
    rows = elements(replies, "page_id").select("page_id", F.try_variant_get("item", "$.id", "int").alias("id"), F.try_variant_get("item", "$.triggerType", "string").alias("trigger_type"))
    return rows.filter("id <> -1 and trigger_type <> ''")


def cleaned(replies: DataFrame) -> DataFrame:
    """(case_id, place, product_name, url) of replies(case_id, reply) that are arrays of complete objects, code fences allowed."""
    body = text.strip(F.col("reply"))
    for fence in (r"^```json", r"^```", r"```$"):
        body = F.regexp_replace(body, fence, "")
    parsed = replies.withColumn("__v", F.try_parse_json(text.strip(body))).filter(F.schema_of_variant("__v").startswith("ARRAY"))
    view = parsed.select("case_id", "__v")
    rows = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("__v").outer()).select(F.col("pos").alias("place"), F.col("value").alias("item")))
    has = lambda name: F.try_variant_get("item", f"$.{name}", "variant").isNotNull()
    good = F.min(F.schema_of_variant("item").startswith("OBJECT") & has("productName") & has("url")).over(Window.partitionBy("case_id"))
    get = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    return rows.select("case_id", "place", get("productName").alias("product_name"), get("url").alias("url"), good.alias("good")).filter("good").drop("good")


#: Where a provider's answer is (fixed formats).
ANSWER_PATHS = {"anthropic": "$.content[0].text", "openai": "$.choices[0].message.content", "google": "$.candidates[0].content.parts[0].text"}
DEFAULT_PROVIDER = "anthropic"


def provider(asked: Column) -> Column:
    """The provider asked for or the default; an unknown one fails the query."""
    name = F.coalesce(F.nullif(asked, F.lit("")), F.lit(DEFAULT_PROVIDER))
    return F.when(name.isin(*ANSWER_PATHS), name).otherwise(F.raise_error(F.concat(F.lit("no such provider: "), name)))


def unwrapped(name: Column, body: Column) -> Column:
    out = F.lit(None).cast("string")
    for p, where in ANSWER_PATHS.items():
        out = F.when(name == p, F.get_json_object(body, where)).otherwise(out)
    return out


def assembled(name: Column, system: Column, instruction: Column, structure: Column) -> Column:
    """The messages a provider gets, as JSON: (role, text) in order."""
    both = F.concat(instruction, F.coalesce(F.concat(F.lit("\n\n"), structure), F.lit("")))
    message = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("text"))
    separate = F.filter(F.array(message("system", system), message("user", instruction), message("user", structure)), lambda m: m["text"].isNotNull())
    single = F.array(message("user", F.concat(F.lit("System: "), system, F.lit("\n\nUser: "), both)))
    return F.to_json(F.when(name == "openai", separate).when(name == "google", single).otherwise(F.array(message("system", system), message("user", both))))
