"""Model requests and replies as tables: prompts to send, validation of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T

# --- fixed values: words of messages that tell a limit ---
DAILY = ("daily limit", "per day", "daily")
RETRY = ("rate limit", "tokens per minute", "tpm", "too many requests")


def error_class(message: Column) -> Column:
    """Stop for the day, try again, or unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))

    def some(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.when(some(DAILY), "daily_limit").when(some(RETRY), "retry").otherwise("unknown")


def domain_replies(replies: DataFrame, domains: DataFrame) -> DataFrame:
    """(request_id, domain, confidence) of valid replies (request_id, reply): a known domain, 0 to 1."""
    parsed = F.from_json(T.json_payload(F.col("reply")), "domain string, confidence string")
    typed = replies.select("request_id", parsed.alias("j")).select("request_id", "j.domain", F.col("j.confidence").try_cast("double").alias("confidence"))
    return typed.filter(F.col("confidence").between(0, 1)).join(F.broadcast(domains.select("domain")), "domain", "left_semi").select("request_id", "domain", "confidence")


def domain_prompts(measures: DataFrame, domains: list[str]) -> DataFrame:
    """(request_id, prompt): which of the domains a measure belongs to."""
    listed = "\n".join(f"- {d}" for d in domains)
    prompt = F.format_string("Choose one domain for the measure below.\nDomains:\n%s\nMeasure: %s\nAnswer with JSON: {\"domain\": ..., \"confidence\": 0 to 1}", F.lit(listed), T.strip(F.col("measure")))
    return measures.select(T.request_id(F.col("measure")).alias("request_id"), prompt.alias("prompt"))


def batch_prompts(numbered: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(batch, prompt) of numbered pairs (batch, pair_no, measure1, measure2), a bounded batch each."""
    line = F.format_string("%d. A: %s | B: %s", F.col("pair_no"), F.col("measure1"), F.col("measure2"))
    pairs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pair_no", line.alias("line")))), lambda p: p["line"]), "\n")
    head = "Give the relation of each pair. Relations: " + ", ".join(relations) + '.\nAnswer with JSON: {"results": [{"pair_id": ..., "relation": ..., "confidence": ...}]}\n'
    return numbered.groupBy("batch").agg(F.concat(F.lit(head), pairs).alias("prompt"))


def pending(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a valid reply."""
    return requests.join(cache.select("request_id"), "request_id", "left_anti")


def append_replies(replies: DataFrame, path: str) -> None:
    """Add replies to a cache folder."""
    replies.withColumn("received", F.current_timestamp()).write.mode("append").parquet(path)
