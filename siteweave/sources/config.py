"""Task settings: loading, defaults, names of result files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import urls

SCHEMA = "url string, delay double, max_pages int, output string, enable_dynamic_loading boolean, ai_provider string, ai_model string"


@dataclass(frozen=True)
class CrawlConfig:
    url: str
    delay: float = 1.0
    max_pages: int = 50
    output: str | None = None
    enable_dynamic_loading: bool = False
    ai_provider: str | None = None
    ai_model: str | None = None


@dataclass(frozen=True)
class ProviderConfig:
    """The scorer's service where a task names none (fixed values)."""

    ai_provider: str = "anthropic"
    ai_model: str | None = "claude-3-sonnet-20240229"


def load(path: str) -> CrawlConfig:
    """A task file. A missing file, bad JSON or a missing url raise."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise FileNotFoundError(f"no task file at {path}") from None
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    if not raw.get("url"):
        raise ValueError("a task needs a url")
    return CrawlConfig(**{k: raw[k] for k in CrawlConfig.__dataclass_fields__ if raw.get(k) is not None})


def load_provider(path: str) -> ProviderConfig:
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return ProviderConfig()
    return ProviderConfig(raw.get("ai_provider", ProviderConfig.ai_provider), raw.get("ai_model"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Many task files as a table; malformed ones fail the query."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)


def with_defaults(tasks: DataFrame) -> DataFrame:
    """Settings with defaults; a missing url fails the query."""
    url = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("url")).otherwise(F.raise_error(F.lit("a task needs a url")))
    return tasks.withColumns(
        {
            "url": url,
            "delay": F.coalesce(F.col("delay").cast("double"), F.lit(CrawlConfig.delay)),
            "max_pages": F.coalesce(F.col("max_pages").cast("int"), F.lit(CrawlConfig.max_pages)),
            "enable_dynamic_loading": F.coalesce("enable_dynamic_loading", F.lit(CrawlConfig.enable_dynamic_loading)),
        }
    )


def suffixed(name: Column, suffix: str) -> Column:
    """The suffix before the extension of the file name, if it has one."""
    return F.regexp_replace(name, r"^(.*?[^/])(\.[^./]*)?$", f"$1{suffix}$2")


def default_names(url: Column, output: Column) -> tuple[Column, Column]:
    """Names of the raw and the final result file (fixed formats)."""
    final = F.coalesce(output, F.concat(F.lit("ai_crawl_results_"), urls.file_token(urls.domain(url)), F.lit(".json")))
    return suffixed(final, "_raw"), final
