"""Queries over recorded model replies, generated from the page and part tables so that every form of reply occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators import scoring
from siteweave.plans.registry import query
from siteweave.sources.tables import table

#: Replies by page_id % 8: what attempts 1 to 4 say; {n} is page_id % 9. Three scores are expected.
_GOOD = '[{"id":0,"score":{n}.5},{"id":1,"score":{n}},{"id":2,"score":9.5,"productName":"P{n}"}]'
_FORMS: list[list[str]] = [
    [_GOOD] * 4,
    ['Sure! [{"id":0,"score":{n}},{"id":2,"score":1.5}] Done.'] * 4,
    ['[{"id":1,"score":1},{"id":0,"score":2},{"id":1,"score":{n}.25},{"id":7,"score":3},{"id":"2","score":8},5]'] * 4,
    ["no list", "[not json]", _GOOD, "none"],
    ['[{"id":0,"score":"high"},{"id":1,"score":2},{"id":2,"score":3}]'] * 4,
    ["nothing at all"] * 4,
    ['[{"id":0},{"id":1,"score":1}]', '[{"id":0,"score":null}]', '{"id":0,"score":4}', _GOOD],
    ["[]"] * 4,
]
#: Scores (id 0, 1, 2) that a reply of each form gives when it parses: SQL of n, or None where it doesn't.
_GOOD_SCORES = ("n + 0.5", "n", "9.5")
_PARSED: dict[tuple[int, int], tuple[str, str, str] | None] = {
    **{(0, a): _GOOD_SCORES for a in range(1, 5)},
    **{(1, a): ("n", "0.0", "1.5") for a in range(1, 5)},
    **{(2, a): ("2.0", "n + 0.25", "0.0") for a in range(1, 5)},
    (3, 3): _GOOD_SCORES,
    (6, 4): _GOOD_SCORES,
    **{(7, a): ("0.0", "0.0", "0.0") for a in range(1, 5)},
}


def _replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.explode(F.lit([1, 2, 3, 4])).alias("attempt"))
    reply = F.lit("")
    for k, texts in enumerate(_FORMS):
        for a, t in enumerate(texts, 1):
            reply = F.when((F.col("page_id") % len(_FORMS) == k) & (F.col("attempt") == a), t).otherwise(reply)
    return rows.select("page_id", "attempt", F.lit(3).alias("expected_count"), F.replace(reply, F.lit("{n}"), (F.col("page_id") % 9).cast("string")).alias("reply"))


_P = f"(select page_id, page_id % 9 as n, page_id % {len(_FORMS)} as form, attempt from pages, (values (1), (2), (3), (4)) a(attempt))"


def _score_case() -> str:
    whens = "".join(f" when form = {k} and attempt = {a} then [{', '.join(f'({x})::double' for x in v)}]" for (k, a), v in _PARSED.items() if v)
    return f"case{whens} end"


_NAME = "case when id = 2 and (form = 0 or (form = 3 and attempt = 3) or (form = 6 and attempt = 4)) then 'P' || n end"
_BY_ID = f"(select *, ss[id + 1] as score, {_NAME} as product_name from (select *, {_score_case()} as ss from {_P}), (values (0), (1), (2)) i(id) where ss is not null)"


@query(f"select page_id, attempt, id, score, product_name from {_BY_ID}")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.parsed_scores(_replies(spark, d), "page_id", "attempt")
    return rows.filter("valid").select("page_id", "attempt", "id", "score", "product_name")


@query(f"""select page_id, attempt, not (form = 4 or (form = 6 and attempt in (1, 2))) as valid from {_P} where form in (0, 1, 2, 4, 7) or (form = 3 and attempt = 3) or (form = 6 and attempt <> 3)""")
def score_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.parsed_scores(_replies(spark, d), "page_id", "attempt")
    return rows.groupBy("page_id", "attempt").agg(F.bool_and("valid").alias("valid"))


@query(f"""with ok as (select page_id, min(attempt) as attempt from {_BY_ID} group by page_id)
select p.page_id, i.id, coalesce(s.score, 0.0) as score, s.product_name, coalesce(s.attempt, 0) as attempt
from pages p cross join (values (0), (1), (2)) i(id) left join ok using (page_id) left join {_BY_ID} s on s.page_id = p.page_id and s.attempt = ok.attempt and s.id = i.id""")
def score_retry(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_retry(_replies(spark, d), "page_id")


_VERDICTS = ['{"isProductPage": true, "productName": " Part {k} "}', 'I say {"isProductPage": false, "productName": "x"}', '{"isProductPage": true}', "no", '{"isProductPage": true, "productName": ""}', 'Yes: {"isProductPage": true, "productName": "Paint {k}"}.']


def _by_part(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), F.replace(F.element_at(F.lit(forms), (k % len(forms) + 1).cast("int")), F.lit("{k}"), k.cast("string")).alias("reply"))


@query("select 'https://s.test/p/' || p_partkey as url, case p_partkey % 6 when 0 then 'Part ' else 'Paint ' end || p_partkey as product_name from part where p_partkey % 6 in (0, 5)")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return scoring.verdicts(_by_part(spark, d, _VERDICTS).select(F.concat(F.lit("https://s.test/p/"), "k").alias("url"), "reply"))


_TRIGGERS = ['Found [{"id": 3, "triggerType": "Pagination"}, {"id": 7, "triggerType": "Load More"}]', "[]", '[{"id": -1, "triggerType": "Tabs"}, {"id": {k}, "triggerType": "Tabs"}]', "none", '[{"id": 2, "triggerType": ""}, {"id": 4}]']


@query("""select p_partkey as page_id, 3 as id, 'Pagination' as trigger_type from part where p_partkey % 5 = 0 union all select p_partkey, 7, 'Load More' from part where p_partkey % 5 = 0
union all select p_partkey, p_partkey::int, 'Tabs' from part where p_partkey % 5 = 2""")
def trigger_parse(spark: SparkSession, d: str) -> DataFrame:
    return scoring.triggers(_by_part(spark, d, _TRIGGERS).select(F.col("k").alias("page_id"), "reply"))


_FENCED = '```json\n[{"productName": "A{k}", "url": "https://s.test/{k}"}, {"productName": "B", "url": "u"}]\n```'
_CLEANERS = [_FENCED, '[{"productName": "C{k}", "url": "v"}]', '[{"productName": "D"}]', '{"productName": "E", "url": "w"}', "```\n[1, 2]\n```", "oops", '  ```[{"productName": "F", "url": "{k}", "more": 1}]```  ']


@query("""select p_partkey as case_id, 0 as place, 'A' || p_partkey as product_name, 'https://s.test/' || p_partkey as url from part where p_partkey % 7 = 0 union all select p_partkey, 1, 'B', 'u' from part where p_partkey % 7 = 0
union all select p_partkey, 0, 'C' || p_partkey, 'v' from part where p_partkey % 7 = 1 union all select p_partkey, 0, 'F', p_partkey::varchar from part where p_partkey % 7 = 6""")
def cleaner_parse(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cleaned(_by_part(spark, d, _CLEANERS).select(F.col("k").alias("case_id"), "reply"))


_PROVIDER = "(case p_partkey % 4 when 0 then 'openai' when 1 then 'google' when 2 then 'anthropic' end)"


def _provider() -> Column:
    k = F.col("p_partkey") % 4
    return F.when(k == 0, "openai").when(k == 1, "google").when(k == 2, "anthropic")


@query(f"select p_partkey, coalesce({_PROVIDER}, 'anthropic') as provider from part")
def provider_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scoring.provider(_provider()).alias("provider"))


@query(f"""select p_partkey, case {_PROVIDER}
  when 'openai' then '[{{"role":"system","text":"S"}},{{"role":"user","text":"Look at ' || p_partkey || '"}}' || case when p_partkey % 3 = 0 then ',{{"role":"user","text":"As JSON"}}' else '' end || ']'
  when 'google' then '[{{"role":"user","text":"System: S\\n\\nUser: Look at ' || p_partkey || case when p_partkey % 3 = 0 then '\\n\\nAs JSON' else '' end || '"}}]'
  else '[{{"role":"system","text":"S"}},{{"role":"user","text":"Look at ' || p_partkey || case when p_partkey % 3 = 0 then '\\n\\nAs JSON' else '' end || '"}}]' end as messages from part""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = scoring.provider(_provider())
    return table(spark, d, "part").select("p_partkey", scoring.assembled(name, F.lit("S"), F.concat(F.lit("Look at "), k), F.when(k % 3 == 0, "As JSON")).alias("messages"))


_BODIES = {"openai": '{"choices":[{"message":{"content":"o{k}"}}]}', "google": '{"candidates":[{"content":{"parts":[{"text":"g{k}"}]}}]}', "anthropic": '{"content":[{"text":"a{k}"}]}'}


@query(f"select p_partkey, case {_PROVIDER} when 'openai' then 'o' when 'google' then 'g' else 'a' end || p_partkey as answer from part")
def response_unwrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", scoring.provider(_provider()).alias("name"))
    body = F.lit("")
    for name, b in _BODIES.items():
        body = F.when(F.col("name") == name, b).otherwise(body)
    return rows.select("p_partkey", scoring.unwrapped(F.col("name"), F.replace(body, F.lit("{k}"), F.col("p_partkey").cast("string"))).alias("answer"))
